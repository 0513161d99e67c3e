import base64
import gzip
import hashlib
import random

import pytest

from leadlake.llm import queries, warc


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    first = {}
    for i, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    seen, out = set(), []
    for i, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        again = h in seen or (h or "") in seen
        seen.add(h or "")
        out.append((i, len(b), sha(b), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


ROWS = [(3, "http://a.b/c d\n", "<p>x</p>"), (2, "http://a.b/ü", "<p>x</p>"), (9, None, None), (4, "", ""), (10, "u", "\r\n\r\nWARC/1.1\r\n\nhttp://x 0.0.0.0 20000101000000 text/html 5\n"), (11, "u", "é😀\x00"), (11, "u", "é😀\x00"), (None, "u", "é😀\x00"), (None, "u", "only here"), (12, "u", "y" * 3_000_000)]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, version):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "page_id long, url string, html string, offset int, archive string")
    arc, out = f"{tmp_path}/arc", f"{tmp_path}/warc"
    warc.write_arc(df, arc, version, archive_bytes=400)
    read = warc.read_arc(spark, arc).where("offset > 0").collect()
    assert {r.version for r in read} == {version} and all(r.error is None and r.http for r in read)
    assert sorted(warc.parts_of(bytes(r.block))[1].decode() for r in read) == sorted(h or "" for _, _, h in ROWS)
    assert warc.convert(spark, arc, out, archive_bytes=400).count() == 0
    back = warc.read_warc(spark, out).collect()
    assert all(r.error is None and r.digests_hold for r in back)
    got = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to_page is None else int(r.refers_to_page)) for r in back if r.record_type != "warcinfo"]
    assert sorted(got, key=repr) == expected([(i, h) for i, _, h in ROWS])
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back)
    for r in back:
        if r.record_type == "revisit":
            assert ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].payload_digest == r.payload_digest


def test_query_equals_plain_loop(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["", "same", f"own {i}", None, "ü" * rng.randint(0, 3)])) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op13_warc(spark, str(tmp_path)).collect()), key=repr) == expected([(i, h) for i, _, h in rows])


def test_least_bytes_and_shuffled_decisions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_arc(df, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", least_bytes=3)
    got = sorted((r.page_id, r.record_type, r.refers_to_page) for r in warc.read_warc(spark, f"{tmp_path}/warc").collect() if r.page_id)
    assert got == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("4", "revisit", "3")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op13_warc(spark, str(tmp_path)).count() == 0


V2_NAMES = warc.ARC_FIELDS[2]


def head(version, names):
    body = b"%d 0 Org\n%s\n" % (version, names)
    return b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n%s" % (len(body), body)


def test_records_by_declared_length_and_version():
    block = b"HTTP/1.0 200 OK\r\n\r\nhello"
    one = head(1, warc.ARC_FIELDS[1]) + b"\nhttp://x/a b 1.2.3.4 19961104142103 text/html %d\n%s\ndns:x 1.2.3.4 199611041421 text/dns 4\nabcd\n" % (len(block), block)
    got = list(warc.arc_records(one))
    assert [r["fields"]["url"] for r in got] == [b"filedesc://a.arc", b"http://x/a b", b"dns:x"]
    assert [r["block"] for r in got[1:]] == [block, b"abcd"] and all(r["version"] == 1 for r in got)
    two = head(2, V2_NAMES) + b"\nhttp://x/ 1.2.3.4 19961104142103 text/html 404 SUM - 120 a.arc 5\nhello"
    got = list(warc.arc_records(gzip.compress(two[:150]) + gzip.compress(two[150:])))
    assert got[1]["fields"]["result-code"] == b"404" and got[1]["fields"]["filename"] == b"a.arc" and got[1]["block"] == b"hello" and got[1]["version"] == 2


def test_broken_archives():
    assert [r["error"] for r in warc.arc_records(b"no archive\n")] == ["no file description"]
    assert [r["error"] for r in warc.arc_records(head(3, b"URL Archive-length"))] == ["unknown version or fields"]
    text = head(1, warc.ARC_FIELDS[1]) + b"\nnonsense\nmore nonsense\nhttp://x 1.2.3.4 19961104142103 text/plain 2\nok\nhttp://y 1.2.3.4 19961104142103 text/plain 99\ncut"
    got = list(warc.arc_records(text))
    assert [r.get("error") for r in got] == [None, "no header line", None, "shorter than declared"] and got[2]["block"] == b"ok"
    assert list(warc.arc_records(b"\n")) == []
    record = warc.warc_record("resource", {"Content-Type": "text/plain"}, b"abc")
    assert [r.get("error") for r in warc.warc_records(record + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")] == [None, "shorter than declared"]
    assert [r.get("error") for r in warc.warc_records(b"garbage")] == ["no record head"]


def test_types_and_times(spark, tmp_path):
    arc = f"{tmp_path}/arc"
    import os

    os.mkdir(arc)
    with gzip.open(f"{arc}/old.arc.gz", "wb") as f:
        f.write(head(1, warc.ARC_FIELDS[1]) + b"\ndns:x 1.2.3.4 199611041421 text/dns 4\nabcd\nhttp://x/ 1.2.3.4 19961104142103 text/html 24\nHTTP/1.0 200 OK\r\n\r\nhello\nbroken")
    bad = warc.convert(spark, arc, f"{tmp_path}/warc").collect()
    assert [r.error for r in bad] == ["no header line"]
    got = sorted((r.record_type, r.date, r.target_uri, r.payload_bytes, r.digests_hold) for r in warc.read_warc(spark, f"{tmp_path}/warc").collect() if r.record_type != "warcinfo")
    assert got == [("resource", "1996-11-04T14:21:00Z", "dns:x", 4, True), ("response", "1996-11-04T14:21:03Z", "http://x/", 5, True)]
