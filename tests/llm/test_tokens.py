import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from leadlake.llm import packing, pretoken, tokencount
from leadlake.llm.queries import tokenizer_path

PATH = tokenizer_path()
ALPHABET = " \n\t'ab1Zé.,!stre vmldñß0٣　 日本ー́🙂​\x1c\x85٠²"
ODD = ["", " ", "'s it's 'select 'll", "a  b   c\n\n d", "<|endoftext|> x", "x" * 3000, "don't  \n\n  'T 're", "ａ"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(some, path=PATH):
    whole = pretoken.tokenizer(path)
    return [whole.encode(t or "", add_special_tokens=False).ids for t in some]


def test_ids_equal_the_library():
    some = texts(1)
    want = library(some)
    for entries in (0, 50, 10_000):
        assert [x.tolist() for x in packing.encode_batch(some, PATH, pretoken.frequent(texts(2), PATH, entries, True))] == want
        assert tokencount.count_batch(some, PATH, pretoken.frequent(texts(2), PATH, entries, False)).tolist() == [len(w) for w in want]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("blind", [False, True])
def test_words_of_one_hash_keep_their_own_ids(monkeypatch, blind):
    # a polynomial modulo 2^64 cannot tell these words from their complements
    some = [t for n in (1024, 2048) for t in (thue_morse(n), thue_morse(n, "b", "a"))]
    some += [" ".join(some), f"x {some[0]} y", f"x {some[1]} y"]
    start, end, _, cp, _ = pretoken.split(some[:2])
    h = pretoken.RunHasher(cp)(start, end)
    assert h[0] != h[1]
    if blind:  # all pre-tokens of one length share a hash
        monkeypatch.setattr(pretoken, "RunHasher", lambda cp: lambda start, end: (end - start).astype(np.uint64))
    want = library(some)
    assert want[0] != want[1]
    for order in (some, some[::-1]):
        for each in (False, True):
            pretoken._lookups.clear()
            groups = [[t] for t in order] if each else [order]
            ids = [x.tolist() for g in groups for x in packing.encode_batch(g, PATH)]
            assert ids == (want if order is some else want[::-1])
            assert [n for g in groups for n in tokencount.count_batch(g, PATH).tolist()] == [len(x) for x in ids]
    table = pretoken.frequent([some[0]], PATH, 10, True)
    assert [x.tolist() for x in packing.encode_batch(some, PATH, table)] == want


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    some = ["".join(rng.choice(ALPHABET + "     abc abc") for _ in range(5000)) for _ in range(4)] + ["x" * 3000, "a b " * 900, "\U0001f642 a\u0301 b " * 300, " " * 2000 + "a b"]
    want = library(some)
    cut = lambda t: segments(t, 200)
    segments = pretoken.segments
    monkeypatch.setattr(pretoken, "segments", cut)
    pieces, owner = cut(some)
    assert len(pieces) > 60 and ["".join(p for p, o in zip(pieces, owner) if o == i) for i in range(len(some))] == some
    assert [x.tolist() for x in packing.encode_batch(some, PATH)] == want
    assert tokencount.count_batch(some, PATH).tolist() == [len(w) for w in want]


def test_small_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(pretoken, "CACHE_ENTRIES", 5)
    some = texts(3, 60)
    want = library(some)
    pretoken._lookups.clear()
    assert [tokencount.count_batch([t], PATH)[0] for t in some] == [len(w) for w in want]
    assert [packing.encode_batch([t], PATH)[0].tolist() for t in some] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = tokenizer_path(name)
    some = ["Hello world", "", "naïve café"]
    got = tokencount.count_batch(some, path).tolist()
    if path.endswith(".model"):
        assert got == [len(pretoken.sentence_model(path).encode(t)) for t in some]
    else:
        assert got == [len(x) for x in library(some, path)]


def test_token_counts(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(texts(4, 30))] + [(None, "a b", "n", 1), (7, None, None, None), (7, "a b", "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int")
    whole = pretoken.tokenizer(PATH)
    want = sorted(((i, len((t or "").encode()), len(ids := whole.encode(t or "", add_special_tokens=False).ids), len(ids) > 20) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in tokencount.token_counts(df, PATH, limit=20).collect()), key=str) == want
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def plain_first_fit(sizes, capacity):
    rooms, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, room in enumerate(rooms):
            if room >= sizes[i]:
                break
        else:
            b = len(rooms)
            rooms.append(capacity)
        out[i] = (b, capacity - rooms[b])
        rooms[b] -= sizes[i]
    return out


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 100, n)
        seq, offset = packing.first_fit_decreasing(sizes, 100)
        assert list(zip(seq.tolist(), offset.tolist())) == plain_first_fit(sizes.tolist(), 100)


def test_packing_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(6, 120))] + [(5000, "word " * 700, "x"), (5001, None, None), (None, "last", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(df, PATH, capacity=128, group_pieces=32).collect()
    whole = pretoken.tokenizer(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(rows)
    for i, t, _ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len({s >> 32 for s in by_seq}) > 2
    used = sum(r.length for r in got)
    assert used / (128 * len(by_seq)) > 0.85
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_repeated_rows_spread_over_groups(spark):
    df = spark.range(600).selectExpr("CAST(NULL AS LONG) AS doc_id", "'' AS text")
    got = packing.pack(df, PATH, capacity=16, group_pieces=50).groupBy("sequence_id").count().collect()
    groups = Counter()
    for r in got:
        groups[r.sequence_id >> 32] += r["count"]
    assert sum(groups.values()) == 600 and len(groups) == 12 and max(groups.values()) < 120


def test_repeated_rows_are_packed_once_each(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    got = packing.pack(df, PATH, capacity=16).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
