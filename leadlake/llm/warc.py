"""Legacy web archives (ARC versions 1 and 2) and their conversion to WARC 1.1.

An ARC file begins with a `filedesc://` record that names its version and the
fields of its header lines; every further record is one such line, then as many
bytes as the line declares.  The reader takes the fields from the file itself,
reads by declared lengths (never by looking for the next header) and reports
what it can't read as rows with an error, going on at the next header line whose
fields fit.  A WARC record is made of each: identifier (a name-based UUID of the
record's address, time, digest and place), time, type (the file description is
`warcinfo`, an HTTP response `response`, anything else `resource`), digests of
block and payload (SHA-1, base32), and of equal payloads that are not the first
a `revisit` without payload that refers to the first.

Archives are files that Spark's writers commit: one row is one archive of about
`ARCHIVE_BYTES`, so reading and writing hold one archive at a time; a record is
never cut.  Records are told apart by archive and offset; equal payloads by
SHA-256 and length.  Records travel to their decisions only when there are more
than `BROADCAST_REVISITS` revisits; else those are broadcast.

A null html is an empty payload, a null address `about:blank`; bytes that a
header line can't hold are percent-encoded.  The first of equal payloads is the
record of the smallest page id (nulls last, ids that are equal by archive and
offset).  Ids may be null or repeat: each row is a record.  A table without rows
makes archives without records, or none.  Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Bytes of one archive, before compression; one longer record has an archive of its own.
ARCHIVE_BYTES = 8_000_000
BROADCAST_REVISITS = 200_000
#: Parts into which the records of a frequent payload are dealt when they meet the first of them.
SALTS = 32
# fixed values of the formats
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, REFERS = "X-Page-Id", "X-Refers-To-Page-Id"

_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")
_DATE = re.compile(rb"\d{14}|\d{12}")


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def address(url: str | None) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "surrogatepass"))


def http_response(payload: bytes, page_id: str | None) -> bytes:
    own = b"" if page_id is None else f"{PAGE}: {page_id}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_head(name: str, date: str, version: int) -> bytes:
    body = b"%d 0 leadlake\n%s\n" % (version, ARC_FIELDS[version])
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s" % (name.encode(), date.encode(), b" 200 - - 0 " + name.encode() if version == 2 else b"", len(body), body)


def arc_record(url: bytes, date: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    more = b" 200 %s - %d %s" % (digest(block).encode(), offset, name.encode()) if version == 2 else b""
    return b"\n%s 0.0.0.0 %s text/html%s %d\n%s" % (url, date.encode(), more, len(block), block)


def opened(raw: bytes) -> bytes:
    """The archive's bytes, of one or more gzip members or plain."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out)


def _header(line: bytes, names: list[str]) -> dict[str, bytes] | None:
    """Fields of a header line, the address taking what is left of the others; null if they don't fit."""
    found = line.rstrip(b"\r").rsplit(b" ", len(names) - 1)
    if len(found) != len(names):
        return None
    out = dict(zip(names, found, strict=True))
    return out if out["archive-length"].isdigit() and _DATE.fullmatch(out["archive-date"]) else None


def arc_records(raw: bytes) -> Iterator[dict]:
    """offset, version, fields, block of each record of an archive, the file description first; or offset and error."""
    raw = opened(raw)
    if not raw.strip():
        return
    end = raw.find(b"\n")
    line = raw[: max(end, 0)]
    length = line.rpartition(b" ")[2]
    if not line.startswith(b"filedesc://") or not length.strip().isdigit():
        yield {"offset": 0, "error": "no file description"}
        return
    block = raw[end + 1 : end + 1 + int(length)]
    lines = block.split(b"\n")
    version, names = lines[0].partition(b" ")[0], (lines[1] if len(lines) > 1 else b"").decode("utf-8", "replace").lower().split()
    if version not in (b"1", b"2") or not {"url", "archive-date", "archive-length"} <= set(names) or names[0] != "url":
        yield {"offset": 0, "error": "unknown version or fields"}
        return
    # the file description's own line has the fields of version 1 in either version
    date = line.split(b" ")
    yield {"offset": 0, "version": int(version), "fields": {"url": date[0], "ip-address": date[1], "archive-date": date[2] if len(date) > 2 else b"", "content-type": b"text/plain"}, "block": block}
    at, lost = end + 1 + int(length), False
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.find(b"\n", at)
        fields = _header(raw[at : end if end >= 0 else len(raw)], names)
        size = int(fields["archive-length"]) if fields else 0
        if fields is None or end < 0 or end + 1 + size > len(raw):
            if not lost:
                yield {"offset": at, "error": "no header line" if fields is None else "shorter than declared"}
            lost, at = True, end + 1 if end >= 0 else len(raw)
            continue
        yield {"offset": at, "version": int(version), "fields": fields, "block": raw[end + 1 : end + 1 + size]}
        lost, at = False, end + 1 + size


def parts_of(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head (with its blank line), payload and header fields of an HTTP block; a block that is none is payload."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, {}
    pairs = (x.partition(b":") for x in block[:cut].split(b"\r\n")[1:])
    return block[: cut + 4], block[cut + 4 :], {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in pairs}


def warc_date(date: bytes) -> str:
    """An ARC time (14 or 12 digits) as ISO 8601; the epoch where it is none."""
    d = date.decode("latin-1") if _DATE.fullmatch(date) else "19700101000000"
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: bytes, date: str, payload_digest: str, archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url.decode("latin-1")} {date} {payload_digest} {archive} {offset}')}>"


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_records(raw: bytes) -> Iterator[dict]:
    """offset, fields (by lower-case name), block of each record, or offset and error."""
    raw = opened(raw)
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at : max(end, at)].split(b"\r\n")
        fields = {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if not lines[0].startswith(b"WARC/1.") or not size.isdigit() or end + 4 + int(size) > len(raw):
            yield {"offset": at, "error": "no record head" if not size.isdigit() else "shorter than declared"}
            return
        yield {"offset": at, "fields": fields, "block": raw[end + 4 : end + 4 + int(size)]}
        at = end + 4 + int(size)


def _batches(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _save(archives: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own (the writer ends it with a newline)."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _one(archive: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["archive"])


def write_arc(pages: DataFrame, path: str, version: int | None = None, date: str = "20000101000000", page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Every page as an HTTP response in ARC files of a version; without one, tasks take both in turn."""
    rows = pages.select(F.col(page_id).cast("string"), F.col(url).cast("string"), F.col(html).cast("string"))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        kind = version or 1 + task % 2
        name = f"pages-{task:06d}-{n:06d}.arc"
        held, size = [arc_head(name, date, kind)], 0
        size = len(held[0])
        for batch in batches:
            for b in _batches(batch):
                for page, at, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.fill_null(b.column(2).cast(pa.binary()), b"").to_pylist(), strict=True):
                    record = arc_record(address(at), date, http_response(payload, page), kind, name, size)
                    if len(held) > 1 and size + len(record) > archive_bytes:
                        yield _one(held)
                        n += 1
                        name = f"pages-{task:06d}-{n:06d}.arc"
                        held = [arc_head(name, date, kind)]
                        size = len(held[0])
                        record = arc_record(address(at), date, http_response(payload, page), kind, name, size)
                    held.append(record)
                    size += len(record)
        if len(held) > 1:
            yield _one(held)

    _save(rows.mapInArrow(run, "archive binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _arc_rows(spark: SparkSession, path: str, block: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in _batches(batch, 1):
                file, held, size = b.column(0)[0].as_py(), [], 0
                for r in arc_records(b.column(1)[0].as_py()):
                    f, content = r.get("fields", {}), r.get("block")
                    head, payload, http = parts_of(content or b"")
                    known = content is not None
                    own = [file, r["offset"], r.get("error"), r.get("version"), *(f[k].decode("latin-1") if k in f else None for k in ("url", "ip-address", "archive-date", "content-type")), http.get(PAGE.lower()), bool(head), len(payload) if known else None, hashlib.sha256(payload).hexdigest() if known else None, digest(payload) if known else None]
                    held.append([*own, content] if block else own)
                    size += len(content or b"") if block else 0
                    if size > 1_000_000 or len(held) >= 2000:
                        yield _table(held, kind)
                        held, size = [], 0
                if held:
                    yield _table(held, kind)

    kind = ARC + [("block", pa.binary())] * block
    return _files(spark, path).mapInArrow(run, ", ".join(f"{k} {_SQL[t]}" for k, t in kind))


ARC = [("path", pa.string()), ("offset", pa.int64()), ("error", pa.string()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("page_id", pa.string()), ("http", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload_digest", pa.string())]
WARC = [("path", pa.string()), ("offset", pa.int64()), ("error", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digests_hold", pa.bool_()), ("refers_to_id", pa.string()), ("page_id", pa.string()), ("refers_to_page", pa.string())]
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}


def _table(rows: list[list], kind: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, (_, t) in zip(zip(*rows, strict=True), kind, strict=True)], [k for k, _ in kind])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the ARC files in a folder: place, header fields, payload digests, and the block; rows with an error have no fields."""
    return _arc_rows(spark, path, True)


def revisits(records: DataFrame, least_bytes: int) -> DataFrame:
    """path, offset of the records whose payload an earlier one has, with the first's page, address, digest and place."""
    known = records.where((F.col("offset") > 0) & F.col("error").isNull() & (F.col("payload_bytes") >= least_bytes))
    number = F.col("page_id").try_cast("decimal(38,0)")
    rank = F.struct(F.col("page_id").isNull().alias("none"), number.isNull().alias("name"), number.alias("number"), "page_id", "path", "offset", "url", "date", "payload_digest")
    light = known.select("path", "offset", "payload_sha256", "payload_bytes", rank.alias("own"), F.pmod(F.xxhash64("path", "offset"), F.lit(SALTS)).alias("salt"))
    first = light.groupBy("payload_sha256", "payload_bytes").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    met = light.join(first, ["payload_sha256", "payload_bytes", "salt"]).where("path <> first.path OR offset <> first.offset")
    return met.select("path", "offset", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("page_id", "path", "offset", "url", "date", "payload_digest")))


def _archive_name(path: str) -> str:
    return path.rpartition("/")[2]


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write WARC files of all records of the ARC files in a folder; returns the rows that could not be read (path, offset, error)."""
    index = written(_arc_rows(spark, arc_path, False), "arc-index")
    again = written(revisits(index, least_bytes), "revisits")
    small = again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    records = _arc_rows(spark, arc_path, True).where(F.col("error").isNull())
    met = records.join(F.broadcast(again) if small else again, ["path", "offset"], "left")
    names = ["path", "offset", "url", "ip", "date", "content_type", "page_id", "http", "payload_digest", "first_page_id", "first_path", "first_offset", "first_url", "first_date", "first_payload_digest", "block"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for b in _batches(batch):
                for r in b.to_pylist():
                    record = _converted(r)
                    if held and size + len(record) > archive_bytes:
                        yield _one([*held[:-1], held[-1][:-1]])  # the writer adds the last newline
                        held, size = [], 0
                    held.append(record)
                    size += len(record)
        if held:
            yield _one([*held[:-1], held[-1][:-1]])

    _save(met.select(*names).mapInArrow(run, "archive binary"), warc_path)
    return index.where(F.col("error").isNotNull()).select("path", "offset", "error")


def _converted(r: dict) -> bytes:
    """The WARC record of a record of ARC, with what its payload's first record is if that is another."""
    url, date = r["url"].encode("latin-1"), warc_date(r["date"].encode("latin-1"))
    own = {"WARC-Record-ID": record_id(url, date, r["payload_digest"], _archive_name(r["path"]), r["offset"]), "WARC-Date": date}
    if r["url"].startswith("filedesc://"):
        return warc_record("warcinfo", own | {"WARC-Filename": r["url"].removeprefix("filedesc://"), "Content-Type": "text/plain"}, r["block"])
    own |= {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"] if r["ip"] not in (None, "-", "0.0.0.0") else None, "WARC-Payload-Digest": f"sha1:{r['payload_digest']}"}
    own["Content-Type"] = "application/http; msgtype=response" if r["http"] else r["content_type"]
    if r["first_path"] is None:
        return warc_record("response" if r["http"] else "resource", own, r["block"])
    first, day = r["first_url"].encode("latin-1"), warc_date(r["first_date"].encode("latin-1"))
    own |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(first, day, r["first_payload_digest"], _archive_name(r["first_path"]), r["first_offset"]), "WARC-Refers-To-Target-URI": r["first_url"], "WARC-Refers-To-Date": day, REFERS: r["first_page_id"]}
    return warc_record("revisit", own, parts_of(r["block"])[0])


def read_warc(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    """One row a record of the WARC files in a folder; of revisits, digest and size are the full payload's."""
    kind = WARC + [("block", pa.binary())] * block

    def run(batches):
        for batch in batches:
            for b in _batches(batch, 1):
                file, held, size = b.column(0)[0].as_py(), [], 0
                for r in warc_records(b.column(1)[0].as_py()):
                    f, content = r.get("fields", {}), r.get("block")
                    head, payload, http = parts_of(content or b"")
                    own, again = f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("warc-type") == "revisit"
                    whole = http.get("content-length", "") if again else str(len(payload))
                    holds = content is not None and f.get("warc-block-digest") == f"sha1:{digest(content)}" and (again or not own or own == digest(payload))
                    row = [file, r["offset"], r.get("error"), f.get("warc-record-id"), f.get("warc-type"), f.get("warc-date"), f.get("warc-target-uri"), own or None, int(whole) if content is not None and whole.isdigit() else None, holds, f.get("warc-refers-to"), http.get(PAGE.lower()), f.get(REFERS.lower())]
                    held.append([*row, content] if block else row)
                    size += len(content or b"") if block else 0
                    if size > 1_000_000 or len(held) >= 2000:
                        yield _table(held, kind)
                        held, size = [], 0
                if held:
                    yield _table(held, kind)

    return _files(spark, path).mapInArrow(run, ", ".join(f"{k} {_SQL[t]}" for k, t in kind))
