import math
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from leadlake.llm import mixing, topk


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.0, 0.5]) for _ in range(rng.choice([20, 20, 20, 12]))], 0) for i in range(400)]
    rows += [(1000 + i, [0.25] * 20, 1) for i in range(30)] + [(2000, None, 0), (2001, [1.0, None], 0), (2002, [math.nan] * 20, 0), (2003, [math.inf] * 20, 0), (2004, [], 0), (None, [1.0] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    asked = df.where("vec_id % 20 = 0")
    good = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, topk.top_k(asked, df).collect())) == sorted(want)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.rank, r.vec_id) for r in topk.top_k(df.where("vec_id = 100"), df).collect()) == [(1, 1), (2, 2)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_repeated_queries_count_once(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    asked = df.where("vec_id = 100")
    got = sorted((r.rank, r.vec_id) for r in topk.top_k(asked.unionByName(asked), df).collect())
    assert got == [(1, 1), (2, 1), (3, 2)]


def poisson(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while u > c:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_equals_plain_inversion_and_sql(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(i, f"t{i}", rng.choice(["a"] * 30 + ["b"] * 5 + ["c", None]), i % 3, "keep") for i in range(900)] + [(1, "t1", "a", 0, "keep"), (None, None, "b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, mix_key string").withColumns({"draws": F.lit("x"), "doc": F.lit(1), "mix_copy": F.lit(5)})
    got = mixing.mix(df)
    counts = Counter(r[2] for r in rows)
    h = lambda s: (int(hashlib.md5(s.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    want = Counter()
    for r in rows:
        rate = len(rows) / len(counts) / counts[r[2]]
        draws = max(1, math.ceil(rate / mixing.CHUNK_RATE))
        for d in range(1, draws + 1):
            ident = "null" if r[0] is None else str(r[0])
            want[r[0], r[2]] += poisson(h(f"{ident}:{d}:0"), rate / draws)
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +want
    documents = df.select("doc_id", "text", "source", "n_chars").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.sql(mixing.sql(columns="doc_id, source")).fetchall()
    assert Counter(map(str, sql)) == Counter(str((r.doc_id, r.source, r.mix_copy, r.mix_order)) for r in got.collect())
    share = Counter(r.source for r in got.collect())
    assert all(abs(n / sum(share.values()) - 1 / len(counts)) < 0.08 for n in share.values())


def test_mixing_targets_and_empty(spark):
    df = spark.createDataFrame([(i, "x", "a" if i % 2 else None) for i in range(400)], "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix(df, targets={"a": 3.0, "zzz": 1.0}, size=2.0).collect())
    assert set(got) == {"a"} and 500 < got["a"] < 700
    assert mixing.mix(df.limit(0)).count() == 0


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([(1, "x", "a")] + [(i, "x", "b") for i in range(2, 300)], "doc_id long, text string, source string")
    copies = [r.mix_copy for r in mixing.mix(df).where("source = 'a'").collect()]
    assert len(copies) == len(set(copies)) and 100 < len(copies) < 200
