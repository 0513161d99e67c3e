import random
import re
from collections import Counter

import numpy as np
import pytest

from leadlake.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold, longest=5, most=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    inside = {(lang, p[i:j], a) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
    out = {}
    for (lang, p), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if (lang, p, a) not in inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


def some_rows(seed, n=260):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(12)] + ["ä", "Ä", "x y", "\x00", "é😀"]
    fixed = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(6)]
    rows = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 8)):
            text += rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(words) for _ in range(3)]
            text.append(rng.choice(["", "", ".", ", ", "\n", "\x0b", "?!"]))
        rows.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(text)))
    return rows + [("en", None), (None, ""), ("de", ".,;"), ("en", "a a a a a a " * 40), ("de", "b b b b b b b.")]


def frame(spark, rows):
    return spark.createDataFrame([(i if i % 9 else None, t, lang, 1, "q") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, rank int, phrase string").repartition(3)


@pytest.mark.parametrize("threshold, most, shards", [(12, 2000, 3), (30, 5, 2)])
def test_collocations_equal_brute_force(spark, threshold, most, shards):
    rows = some_rows(threshold)
    got = phrases.collocations(frame(spark, rows), threshold, 5, most, shards).drop("k")
    assert sorted(map(tuple, got.collect())) == brute(rows, threshold, 5, most)


def test_counts_do_not_depend_on_the_table_of_reached_phrases(spark):
    rows = some_rows(3, 150)
    got = phrases.collocations(frame(spark, rows), 10, 4, 2000, 3, slots=4).drop("k")
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 4)


@pytest.mark.parametrize("slots", [64, 1024])
def test_a_phrase_whose_parts_share_slots_is_not_begun_before_its_words_are(spark, slots):
    rows = some_rows(3, 400)
    got = phrases.collocations(frame(spark, rows), 10, 5, 2000, 3, slots=slots).drop("k")
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_empty_table_and_table_without_frequent_phrases(spark):
    df = frame(spark, [("en", "a b c"), ("en", "a b")])
    assert phrases.collocations(df, 100).count() == 0
    assert phrases.collocations(df.limit(0), 100).count() == 0


def test_a_phrase_begins_after_its_parts_have_reached_the_threshold():
    reached = np.full(phrases.SLOTS, phrases.NEVER, np.uint8)
    got = phrases.scan(["a b c"], ["en"], reached, 0, 3, 5)
    assert [g[0] for g in got[1:]] == [1] and got[1][3].tolist() == [1, 1, 1]
    words = {w: h for w, h in zip("abc", phrases.scan(["a", "b", "c"], ["en"] * 3, reached, 0, 3, 1)[1][2][np.argsort(phrases.scan(["a", "b", "c"], ["en"] * 3, reached, 0, 3, 1)[1][4])], strict=True)}
    for w, since in (("a", 0), ("b", 2)):
        reached[phrases.slot(np.array([words[w]], np.uint64))] = since
    for now in range(8):
        found = {g[0]: g for g in phrases.scan(["a b c"], ["en"], reached, now, 3, 5)[1:]}
        assert (1 in found) == (now < 3)
        assert (2 in found) == (3 <= now < 6)  # `a b` alone: c has not reached it
        if 2 in found:
            assert found[2][1].tolist() == [3] and found[2][3].tolist() == [1]


def test_products_over_64_bits_are_exact(spark):
    found = spark.createDataFrame([("en", "x y", 2, 3 * 10**12), ("en", "x", 1, 7 * 10**12 + 1), ("en", "y", 1, 3 * 10**12 + 7)], "lang string, phrase string, length int, a long")
    import leadlake.llm.phrases as module

    n = 9 * 10**13
    size = spark.createDataFrame([("en", n)], "lang string, n long")
    kept = module.frequent
    module.frequent = lambda *a: (found, size)
    try:
        row = module.collocations(found).first()
    finally:
        module.frequent = kept
    assert row.score == 1000 * 3 * 10**12 * n // ((7 * 10**12 + 1) * (3 * 10**12 + 7))
