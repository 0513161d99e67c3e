import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from leadlake.llm import queries, runs


def brute(w, least_words=6, least_times=4):
    """(start, period, end) of all runs, by trying every place and period."""
    n, out = len(w), []
    for s in range(n):
        for q in range(1, n // least_times + 1):
            if s and s - 1 + q < n and w[s - 1] == w[s - 1 + q]:
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            x = w[s : e + q]
            if len(x) >= max(least_words, least_times * q) and all(any(x[i] != x[i + k] for i in range(len(x) - k)) for k in range(1, q)):
                out.append((s, q, e + q))
    return sorted(out)


def some_words(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 30, 80, 160]), rng.choice([1, 2, 3, 10])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        want = [(d, *r) for d, t in enumerate(texts) for r in brute(t)]
        assert [tuple(x) for x in runs.runs([np.array(t, np.int64) for t in texts], 10).tolist()] == want


def test_pieces_of_the_grid_change_nothing(monkeypatch):
    rng = random.Random(6)
    texts = [np.array(some_words(rng), np.int64) for _ in range(40)]
    whole = runs.runs(texts, 10)
    monkeypatch.setattr(runs, "GRID", 7)
    assert (runs.runs(texts, 10) == whole).all()


def test_extensions_equal_plain_comparison():
    rng = random.Random(7)
    word, owner, begin = runs._laid([np.array([rng.randrange(2) for _ in range(90)] * 3, np.int64), np.array([0] * 200, np.int64)], 2)
    e = runs.Extensions(word, owner)
    pairs = [sorted(rng.sample(range(b, b + n), 2)) for b, n in ((1, 270), (272, 200)) for _ in range(400)]
    i, j = np.array(pairs).T
    near, reached = e.near(i, j)
    got = near.copy()
    got[reached] += e.far(i[reached] + near[reached], j[reached] + near[reached])
    for a, b, n in zip(i, j, got, strict=True):
        k = 0
        while word[a + k] == word[b + k]:
            k += 1
        assert n == k


def test_cover_reaches_every_pair_of_places():
    for i in range(runs.T):
        for j in range(runs.T):
            assert {(i + runs._SHIFT[i, j]) % runs.T, (j + runs._SHIFT[i, j]) % runs.T} <= set(runs.COVER)


def test_a_very_long_text():
    n = 120_000
    rng = random.Random(8)
    head = [rng.randrange(50) for _ in range(n)]
    body = [rng.randrange(50) for _ in range(7001)]
    text = np.array(head + [body[i % 7001] for i in range(5 * 7001 + 3)] + [1] * 9, np.int64)
    found = runs.runs([text], 50)
    assert any(q == 7001 and e - s >= 5 * 7001 + 3 for _, s, q, e in found.tolist())
    assert any(q == 1 and e - s >= 9 for _, s, q, e in found.tolist())


ROWS = [(0, "a b " * 9), (1, None), (2, ""), (3, " \t\n "), (None, "x x x x x x x"), (5, "x\x0bx\x0cx\rx\tx x y z w"), (6, "one two three"), (6, "one two three"), (21, "k " * 400)]


def test_documents_with_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(i, t, 7, [1]) for i, t in ROWS], "doc_id long, text string, n_words int, runs array<int>")
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[0] == [(18, [(0, 18, 2)], "a b")]
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[None] == [(7, [(0, 7, 1)], "x")]
    assert got[5] == [(8, [(0, 6, 1)], "x y z w")]
    assert got[6] == [(3, [], "one two three")] * 2
    assert runs.periodic_runs(df.limit(0)).count() == 0


def digests(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [(s, e - s, q) for s, q, e in brute(w)]
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("documents"))
    rng = random.Random(9)
    text = lambda i: rng.choice([" ", "\n", " \t"]).join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.choice([0, 3, 20, 70])))
    rows = [(i, text(i)) for i in range(300)] + [(7, "a a a a a a b b b b b b"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    return root, rows


def test_query_equals_brute_force(spark, folder):
    root, rows = folder
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, root).collect()), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    assert got == sorted((digests(i, t) for i, t in rows), key=repr)
