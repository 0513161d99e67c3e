"""Survivorship in order of arrival against a plain loop, as a job and as a stream, whatever the batches."""

import os
import random

import pytest

from leadlake.operators.arrival import first_arrivals, lead_keys
from leadlake.plans import pipelines
from leadlake.streaming import ingest

KEYS = ["a", "b", "c"]


def loop(rows):
    seen, kept = set(), []
    for seq, *keys in sorted(rows):
        own = {(i, k) for i, k in enumerate(keys) if k is not None}
        if not own & seen:
            seen |= own
            kept.append(seq)
    return kept


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "seq long, a string, b string, c string, kind string").repartition(3)


def got(df):
    return sorted(r[0] for r in df.collect())


def chain(n):
    """Each row shares one key with the one before, by turns of the three kinds."""
    rows = []
    for i in range(n):
        keys = [None] * 3
        keys[i % 3] = f"k{i}"
        keys[(i + 1) % 3] = f"k{i + 1}"
        rows.append((i, *keys))
    return rows


@pytest.mark.parametrize("finish", [0, 5, 50_000])
def test_rounds_equal_the_loop(spark, finish):
    rng = random.Random(finish)
    key = lambda k: rng.choice([None, f"{rng.randrange(k)}"])
    rows = [(i, key(30), key(60), key(4)) for i in range(300)] + [(1000 + i, "hot", None, None) for i in range(200)]
    assert got(first_arrivals(table(spark, rows), KEYS, "seq", finish=finish)) == loop(rows)


def test_chains_and_empty_tables(spark):
    rows = chain(11)
    assert loop(rows) == list(range(0, 11, 2))
    assert got(first_arrivals(table(spark, rows), KEYS, "seq", finish=0)) == loop(rows)
    assert got(first_arrivals(table(spark, rows).limit(0), KEYS, "seq")) == []
    seen = spark.createDataFrame([(0, "k0"), (2, "k2")], "kind int, key string")
    assert got(first_arrivals(table(spark, rows), KEYS, "seq", seen, finish=0)) == loop([r for r in rows if r[0] not in (0, 1, 2)])


LEAD = "lead_id string, ingest_seq long, company_name string, website string, location string, place_id string, email string, contact_name string, ai_score int"


def some_leads(n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(str(i), i, pick("Acme", " acme ", f"Firm {rng.randrange(9)}"), pick(None, "", "http://www.a.org/", "https://a.org", f"b{rng.randrange(20)}.org"), pick("Woking", "Woking, GU1", None), pick(None, " ", "p1", f"p{rng.randrange(30)}"), pick(None, "x@y.org"), pick(None, "Emma Jones"), rng.randrange(10)) for i in range(n)]


def keys(r):
    web = (r[3] or "").lower().replace("http://", "").replace("https://", "").replace("www.", "").rstrip("/") or None
    name, place = (r[2] or "").lower().strip(), (r[4] or "").lower().strip()
    return (r[1], (r[5] or "").strip() or None, web, f"{name}|{place}" if name and place else None)


def test_town_is_ingested_in_order_of_arrival(spark):
    known, new = some_leads(12, 1), [(r[0], r[1] + 100, *r[2:]) for r in some_leads(150, 2)]
    df = lambda rows: spark.createDataFrame(rows, LEAD)
    want = set(loop([(i - 1000, *k) for i, *k in map(keys, known)] + [keys(r) for r in new if (r[4] or "").startswith("Woking")]))
    # known rows all count, also those that share keys among themselves
    seen = {(i, k) for r in known for i, k in enumerate(keys(r)[1:]) if k}
    fresh = [keys(r) for r in new if (r[4] or "").startswith("Woking") and not any((i, k) in seen for i, k in enumerate(keys(r)[1:]))]
    want = set(loop(fresh))
    out = pipelines.ingest_town(leads_dup=df(new), existing=df(known)).collect()
    assert {r.lead_id for r in out} == {r[0] for r in new if r[1] in want and r[6] and r[7]}


@pytest.mark.parametrize("at_once", [1, 2, None])
def test_stream_is_the_loop_wherever_batches_are_cut(spark, tmp_path, at_once):
    rows = some_leads(120, 3)
    base = f"file://{tmp_path}"
    for i in range(4):  # files in order of arrival
        path = f"{tmp_path}/in/{i}"
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], LEAD).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.rename(f"{path}/{part}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = lambda: ingest.files(spark, f"{base}/in", spark.createDataFrame([], LEAD).schema, "[0-9].parquet", at_once)
    ingest.incremental_ingest(stream(), f"{base}/out", f"{base}/state", buckets=4, same=lead_keys()).awaitTermination()
    read = lambda: sorted(r.ingest_seq for r in spark.read.parquet(f"{base}/out").collect())
    assert read() == loop(map(keys, rows))
    # a further file after a restart, all of whose rows are known
    spark.createDataFrame([(f"n{r[0]}", r[1] + 1000, *r[2:]) for r in rows if any(keys(r)[1:])], LEAD).coalesce(1).write.parquet(f"{tmp_path}/more")
    part = next(f for f in os.listdir(f"{tmp_path}/more") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/more/{part}", f"{tmp_path}/in/9.parquet")
    ingest.incremental_ingest(stream(), f"{base}/out", f"{base}/state", buckets=4, same=lead_keys()).awaitTermination()
    assert read() == loop(list(map(keys, rows)) + [(r[1] + 1000, *keys(r)[1:]) for r in rows if any(keys(r)[1:])])
