"""Quotas: requests are granted in order, day by day, under several limits at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import quote
from .core import job

#: Calls a day in all and by layer, and money a day in millionths of a dollar.
DAY_CALLS, DAY_MICROS = 500, 2_000_000
LAYER_CALLS = {"domain": 30, "places": 60, "model": 40}
#: Price of a call that the usage table does not price, in millionths of a dollar.
CALL_MICROS = 19_000


def granted(rows: pd.DataFrame, days: int, calls: int, micros: int, layers: dict[str, int], used: int, spent: int) -> pd.DataFrame:
    """(ingest_seq, day) of the requests that are granted, in order: a request is granted while the day's calls, its layer's calls and the money before it are under their limits."""
    out, waiting = [], list(rows.sort_values("ingest_seq")[["ingest_seq", "layer", "micros"]].itertuples(index=False))
    for day in range(days):
        n, money, by_layer, later = (used, spent, {}, []) if day == 0 else (0, 0, {}, [])
        for r in waiting:
            if n < calls and money < micros and by_layer.get(r.layer, 0) < layers.get(r.layer, calls):
                n, money = n + 1, money + r.micros
                by_layer[r.layer] = by_layer.get(r.layer, 0) + 1
                out.append((r.ingest_seq, day))
            else:
                later.append(r)
        waiting = later
    return pd.DataFrame(out, columns=["ingest_seq", "day"])


def _quota_sql(d, first: str = "2024-01-02", days: int = 3) -> str:
    """The plain loop over days and requests, for comparison."""
    caps = " ".join(f"WHEN {quote(k)} THEN {n}" for k, n in LAYER_CALLS.items())
    return f"""SELECT * FROM (WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY ingest_seq) AS i, ingest_seq, layer, micros, CASE layer {caps} ELSE {DAY_CALLS} END AS layer_cap FROM requests),
        u AS (SELECT count(*) AS calls, coalesce(sum(calls), 0) * {CALL_MICROS} AS money FROM usage WHERE CAST(ts AS DATE) = DATE '{first}'),
        w AS (SELECT 0 AS day, 0::BIGINT AS i, u.calls::BIGINT AS n, u.money::BIGINT AS money, []::VARCHAR[] AS used_layers, []::BIGINT[] AS taken, NULL::BIGINT AS seq FROM u
            UNION ALL SELECT s.day, s.i, s.n + s.ok::INT, s.money + CASE WHEN s.ok THEN s.micros ELSE 0 END, CASE WHEN s.ok THEN list_append(s.used_layers, s.layer) ELSE s.used_layers END, CASE WHEN s.ok THEN list_append(s.taken, s.ingest_seq) ELSE s.taken END, CASE WHEN s.ok THEN s.ingest_seq END
            FROM (SELECT v.day, o.i, v.n, v.money, v.used_layers, v.taken, o.micros, o.layer, o.ingest_seq, NOT list_contains(v.taken, o.ingest_seq) AND v.n < {DAY_CALLS} AND v.money < {DAY_MICROS} AND len(list_filter(v.used_layers, lambda x: x = o.layer)) < o.layer_cap AS ok
                FROM (SELECT CASE WHEN i = (SELECT count(*) FROM o) THEN day + 1 ELSE day END AS day, CASE WHEN i = (SELECT count(*) FROM o) THEN 1 ELSE i + 1 END AS next_i, CASE WHEN i = (SELECT count(*) FROM o) THEN 0 ELSE n END AS n,
                    CASE WHEN i = (SELECT count(*) FROM o) THEN 0 ELSE money END AS money, CASE WHEN i = (SELECT count(*) FROM o) THEN []::VARCHAR[] ELSE used_layers END AS used_layers, taken FROM w) v JOIN o ON o.i = v.next_i WHERE v.day < {days}) s)
        SELECT r.lead_id, r.layer, w.day::INT AS day FROM requests r LEFT JOIN w ON w.seq = r.ingest_seq) q"""


@job("W11", "requests", "usage", plain=_quota_sql)
def allocate_quota(requests: DataFrame, usage: DataFrame, first: str = "2024-01-02", days: int = 3, calls: int = DAY_CALLS, micros: int = DAY_MICROS, layers: dict[str, int] | None = None) -> DataFrame:
    """Requests with the day (from 0) on which each is granted; null for those that still wait after the last.

    Limits are the day's calls, the calls of each layer and the day's money; the
    first day begins with what the usage table has for it.  What is not granted
    waits for the next day, in order.  On one day no layer is granted more than its
    limit, so only its first `days` times limit requests can be granted at all:
    each task sends no more of a layer, and one small table of them is dealt out in
    order.  A layer without a limit of its own has the day's.  Requests need an
    order number of their own; an empty table gives none.
    """
    layers = LAYER_CALLS if layers is None else layers
    cap = F.lit(calls)
    for name, n in layers.items():
        cap = F.when(F.col("layer") == name, F.lit(n)).otherwise(cap)
    known = usage.where(F.col("ts").cast("date") == F.lit(first).cast("date")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).first()
    place = F.row_number().over(Window.partitionBy("layer").orderBy("ingest_seq"))
    most = max([calls, *layers.values()]) * days
    head = requests.select("ingest_seq", "layer", "micros").withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= cap * days)
    deal = lambda rows: granted(rows, days, calls, micros, layers, known["n"], known["calls"] * CALL_MICROS)
    taken = head.select("ingest_seq", "layer", "micros", F.lit(0).alias("own_group")).groupBy("own_group").applyInPandas(deal, "ingest_seq long, day int")
    return requests.join(F.broadcast(taken), "ingest_seq", "left").select("lead_id", "layer", "day")
