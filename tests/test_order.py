"""Order numbers, quotas by day and counters of a written job against plain loops."""

import random

from leadlake.functions.dialect import SPARK
from leadlake.operators import quotas, reports, sets
from leadlake.operators.numbering import numbered
from leadlake.plans import tables
from pyspark.sql import functions as F


def test_numbers_are_gap_free_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), i, "x") for i in range(3000)] + [(None, 5000, "y"), (7, 6000, "z"), (7, 6000, "z")]
    df = spark.createDataFrame(rows, "v long, w long, seq string").repartition(7)
    got = sorted((r.seq, r.v, r.w) for r in numbered(df, ["v", "w"]).collect())
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))
    assert [g[1:] for g in got] == sorted(((v, w) for v, w, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(df.limit(0), ["v"]).count() == 0
    plan = numbered(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "AdaptiveSparkPlan" in plan


def test_known_leads_come_first(spark):
    lead = lambda *ids: spark.createDataFrame([(str(i), i) for i in ids], "lead_id string, ingest_seq long")
    got = sorted((r.seq, r.lead_id, r.part) for r in sets.union_existing_new(existing=lead(9, 4), newcomers=lead(1, 7)).collect())
    assert got == [(1, "4", 0), (2, "9", 0), (3, "1", 1), (4, "7", 1)]


def loop(rows, days, calls, micros, layers, used, spent):
    out, waiting = {}, sorted(rows)
    for day in range(days):
        n, money, own, later = (used, spent, {}, []) if day == 0 else (0, 0, {}, [])
        for seq, layer, price in waiting:
            if n >= calls or money >= micros or own.get(layer, 0) >= layers.get(layer, calls):
                later.append((seq, layer, price))
                continue
            out[seq] = day
            n, money = n + 1, money + price
            own[layer] = own.get(layer, 0) + 1
        waiting = later
    return out


def test_quotas_over_days_equal_the_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["domain", "places", "model", "other"]), rng.choice([0, 150, 19_000, 60_000])) for i in range(700)]
    df = spark.createDataFrame([(f"l{i}", *r) for i, r in enumerate(rows)], "lead_id string, ingest_seq long, layer string, micros long").repartition(5)
    usage = spark.createDataFrame([("2024-01-02 10:00:00", 1)] * 7 + [("2024-01-03 10:00:00", 1)] * 9, "ts string, calls long").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "calls")
    for calls, micros, layers in ((500, 2_000_000, quotas.LAYER_CALLS), (40, 10**9, {}), (10**6, 10**12, {"model": 3})):
        got = {r.lead_id: r.day for r in quotas.allocate_quota({"calls": calls, "micros": micros, "layers": layers}, requests=df, usage=usage).collect()}
        want = loop(rows, 3, calls, micros, layers, 7, 7 * quotas.CALL_MICROS)
        assert got == {f"l{i}": want.get(i) for i in range(700)}
    assert quotas.allocate_quota(requests=df.limit(0), usage=usage.limit(0)).count() == 0


def test_counters_equal_the_written_rows(spark, tmp_path):
    leads = tables.view(spark, "/root/testdata/sf0.001", "leads")
    got = {r.metric: r.value for r in reports.run_metrics({"path": f"file://{tmp_path}/run"}, leads=leads).collect()}
    back = spark.read.parquet(f"file://{tmp_path}/run")
    want = back.agg(*(F.expr(e).cast("double").alias(n) for n, e in reports.counters(SPARK).items())).first().asDict()
    assert got == want and got["leads"] == leads.count()
