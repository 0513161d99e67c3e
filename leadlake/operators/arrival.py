"""Survivorship in order of arrival over several keys: a row stays if no earlier row that stays shares a key with it.

The sequential rule is worked out in rounds.  Of all rows not yet decided, those
that come first in each of their key groups stay, and what shares a key with them
goes; this is repeated until nothing is left.  A key group is reduced to its first
row by an aggregate before it is looked at, so a key that many rows share costs one
row a task, and each round works on what the last one left.  Chains (b shares a key
with a, c another with b, ...) take a round for every second link; the last
`FINISH` rows are decided by one pass in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.keys import blank, name_key, name_location_key, website_key
from ..sources.store import erase, written

#: Undecided rows up to which one task decides them all (three short keys each).
FINISH = 50_000


def lead_keys(d=SPARK) -> dict[str, str]:
    """The keys by which leads are the same: place, website, name with location; null where a part is missing."""
    return {"own_place": blank("place_id"), "own_site": website_key(d, "website"), "own_name": name_location_key("company_name", "location")}


def ingest_keys(d=SPARK) -> dict[str, str]:
    """Those of incremental ingestion: place, website, and the name alone."""
    return lead_keys(d) | {"own_name": f"nullif({name_key('company_name')}, '')"}


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    seen: set = set()
    kept = []
    for seq, *keys in rows.sort_values("seq").itertuples(index=False):
        own = {(i, k) for i, k in enumerate(keys) if k is not None}
        if seen.isdisjoint(own):
            seen |= own
            kept.append(seq)
    return pd.DataFrame({"seq": kept})


def _unseen(rows: DataFrame, seen: DataFrame, names: list[str]) -> DataFrame:
    """Rows without a key of `seen` (kind, key)."""
    for i, name in enumerate(names):
        own = seen.where(F.col("kind") == i).select(F.col("key").alias(name))
        rows = rows.join(own, name, "left_anti")
    return rows


def exploded(rows: DataFrame, names: list[str], *kept: str) -> DataFrame:
    """(kept..., kind, key) of every non-null key; kind is the key's place in `names`."""
    each = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(n).alias("key")) for i, n in enumerate(names)))
    return rows.select(*kept, F.explode(each).alias("k")).select(*kept, "k.kind", "k.key").where("key IS NOT NULL")


def first_arrivals(rows: DataFrame, keys: list[str], order: str, seen: DataFrame | None = None, finish: int = FINISH) -> DataFrame:
    """The numbers (`order`) of the rows that stay.

    `order` must tell rows apart and `keys` be text; a null key is none, and a
    row without any stays.  Rows with a key of `seen` (kind, key; each key once)
    go beforehand.  An empty table gives none.
    """
    wide = rows.select(F.col(order).alias("seq"), *(F.col(k) for k in keys))
    if seen is not None:
        wide = _unseen(wide, seen, keys)
    left = written(wide, "undecided")
    count = F.size(F.array_compact(F.array(*keys)))
    kept = [left.where(count == 0).select("seq")]
    tables, held = [left], left.where(count > 0)
    while (n := held.count()) > finish:
        first = written(exploded(held.withColumn("n", count), keys, "seq", "n").groupBy("kind", "key").agg(F.min(F.struct("seq", "n")).alias("f")).select("kind", "key", "f.seq", "f.n"), "first")
        stay = written(first.groupBy("seq", "n").agg(F.count(F.lit(1)).alias("led")).where("led = n").select("seq"), "stay")
        closed = first.join(stay, "seq", "left_semi").select("kind", "key")
        left = written(_unseen(held.join(stay, "seq", "left_anti"), closed, keys), "undecided")
        erase(first, *tables[1:])
        kept.append(stay)
        tables[1:], held = [left], left
    if n:
        rest = held.select("seq", *keys, F.lit(0).alias("own_group"))
        kept.append(rest.groupBy("own_group").applyInPandas(lambda x: _in_order(x.drop(columns="own_group")), held.select("seq").schema))
    out = written(reduce(DataFrame.union, kept), "kept")
    erase(*tables, *kept[1 : len(kept) - bool(n)])
    return out.withColumnRenamed("seq", order)


def arrivals_sql(source: str, order: str = "ingest_seq", keys=lead_keys) -> str:
    """The sequential rule for DuckDB: one row after another, with the list of keys of those that stay. Gives `order` of the rows of `source` that stay."""
    from ..functions.dialect import DUCK

    own = ", ".join(f"'{i}' || {k}" for i, k in enumerate(keys(DUCK).values()))
    return f"""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY {order}) AS i, {order} AS seq, list_filter(list_transform([{own}], lambda x: hash(x)), lambda x, n: [{own}][n] IS NOT NULL) AS ks FROM {source}),
        w AS (SELECT 0::BIGINT AS i, []::UBIGINT[] AS seen, NULL::BIGINT AS seq, false AS kept
              UNION ALL SELECT o.i, CASE WHEN list_has_any(w.seen, o.ks) THEN w.seen ELSE list_concat(w.seen, o.ks) END, o.seq, NOT list_has_any(w.seen, o.ks) FROM w JOIN o ON o.i = w.i + 1)
        SELECT seq AS {order} FROM w WHERE kept"""
