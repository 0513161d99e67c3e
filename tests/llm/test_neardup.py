import random
from collections import Counter

import numpy as np
from leadlake.llm import neardup as nd


def bag(text):
    import re

    w = re.findall(r"\w+", text.lower())
    if not w:
        return Counter([text]) if text else Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain_classes(rows):
    bags = [bag(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8 - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None)) for i in own]
    return out


def corpus(seed, groups=12, each=40, length=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 7)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, length))]
        for _ in range(rng.randint(1, each)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += ["x y x y x y x y " * 30, "x y x y x y x y " * 27, "a " * 300, "a " * 270, "a " * 100, "!!!", "!!!", "", "", "one two", "One, two."]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_signature_estimates_weighted_jaccard():
    texts = ["a b c d e " * 8 + "f g h i j k l m n", "a b c d e " * 5 + "f g h i j k l m n", "q " * 50 + "r s t u v w", "q " * 35 + "r s t u v w"]
    key, weight, doc = nd.bags(texts)
    sig = nd.signatures(key, weight, doc, 4, 4000)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        assert abs((sig[i] == sig[j]).mean() - jaccard(bag(texts[i]), bag(texts[j]))) < 0.04


def test_signature_does_not_depend_on_neighbours():
    texts = ["a b c d e f g h", "k " * 90, "l m n o p q r s t " * 9]
    alone = np.concatenate([nd.signatures(*nd.bags([t]), 1) for t in texts])
    assert (alone == nd.signatures(*nd.bags(texts), 3)).all()


def test_classes_equal_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in nd.near_duplicates(df).collect()]
    assert sorted(got) == sorted(plain_classes(rows))


def test_large_loose_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rows = corpus(2, groups=2, each=160, length=45)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == sorted(plain_classes(rows))


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f!"), (2, None), (3, ""), (None, None), (4, "z y x w v u")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, content long, own_row long, root long")
    got = Counter(map(tuple, nd.near_duplicates(df).collect()))
    assert got == Counter([(1, 1), (1, 1), (None, 1), (2, 2), (3, 3), (None, None), (4, 4)])
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "a b c d e f"), (2, None), (3, ""), (None, None), (4, "z y x w v u")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).count() == 0
    assert nd.keep_one(df).count() == 0


def test_long_regular_words_are_told_apart(spark):
    morse = lambda a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(1024))
    df = spark.createDataFrame([(1, morse("a", "b")), (2, morse("b", "a")), (3, morse("a", "b"))], "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == [(1, 1), (2, 2), (3, 1)]


def test_all_planted_edits_at_the_threshold_are_found(spark):
    # copies with replaced words, so that similarities lie on both sides of 0.8
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 200))]
        own = list(base)
        for _ in range(rng.randint(1, len(base) // 25)):
            own[rng.randrange(len(own))] = word()
        rows += [" ".join(base), " ".join(own)]
    rows = list(enumerate(rows))
    links = [jaccard(bag(rows[i][1]), bag(rows[i + 1][1])) for i in range(0, len(rows), 2)]
    assert sum(x >= 0.8 for x in links) > 20 and sum(x < 0.8 for x in links) > 10
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df).collect())) == sorted(plain_classes(rows))
