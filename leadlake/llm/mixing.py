"""Mixing of sources to target weights by Poisson replication.

A source with share t of the output and n of the N documents has the mean
repetition rate r = t * size * N / n.  Each document draws its number of copies
from a Poisson distribution of mean r by inverting its distribution function at
a uniform number that a seeded hash of the id gives; documents explode into
their copies, which are shuffled globally by another hash.  A rate over
`CHUNK_RATE` is drawn as the sum of several independent smaller draws, so the
tables of the distribution stay short whatever the rate.

Null source is a source of its own, null ids hash as the text `null`, repeated
rows draw alike, null or empty texts are copied like others, an empty table
gives an empty result; further columns are kept as they are, but for ones named
like the two that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Largest mean of one draw, and terms of its distribution function (the rest is below 2^-48).
CHUNK_RATE, TERMS = 16.0, 80
#: Sources up to which their rates are broadcast (about 1 kB each).
BROADCAST_SOURCES = 10_000


def hash48(*parts: Column) -> Column:
    """48 bits of a hash of the parts' text, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def rates(docs: DataFrame, targets: dict[str | None, float] | None, size: float, source: str) -> DataFrame:
    """mix_key, draws, mean, cdf by source. Without targets all sources get equal shares; a source that targets lacks gets none."""
    counts = docs.groupBy(_key(source).alias("mix_key")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if targets is None:
        share = F.lit(1.0) / F.lit(float(total["k"] or 1))
    else:
        whole = float(sum(targets.values()))
        share = F.lit(0.0)
        for name, weight in targets.items():
            share = F.when(F.col("mix_key") == F.lit("n" if name is None else f"s{name}"), F.lit(weight / whole)).otherwise(share)
    rate = share * F.lit(float(size)) * F.lit(float(total["n"] or 0)) / F.col("n")
    out = counts.select("mix_key", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK_RATE)).cast("int"))
    out = out.withColumn("mean", F.col("rate") / F.col("draws"))
    step = lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.array_append(a["c"], F.element_at(a["c"], -1) + a["p"] * F.col("mean") / k).alias("c"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda a: a["c"])
    return out.select("mix_key", "draws", cdf.alias("cdf"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, size: float = 1.0, seed: int = 0, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents' columns, repeated by their copies, with mix_copy (from 0) and mix_order (the shuffle's key).

    `size` is the wanted number of rows over that of the input. Partitions come
    in no order of their own; inside one, rows are ordered by mix_order.
    """
    by_source = written(rates(docs, targets, size, source), "rates")
    small = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    # the document travels as one column, so that its own columns may have any name
    rows = docs.select(F.struct(*kept).alias("doc"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("ident"), _key(source).alias("mix_key"))
    drawn = rows.join(F.broadcast(by_source) if small else by_source, "mix_key").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    u = (hash48(F.col("ident"), F.col("draw"), F.lit(seed)) + F.lit(0.5)) / F.lit(float(2**48))
    drawn = drawn.withColumn("u", u).withColumn("n", F.size(F.filter("cdf", lambda c: F.col("u") > c))).where("n > 0")
    each = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.withColumn("mix_copy", (F.col("draw") - 1).cast("long") * F.lit(1000) + F.col("part"))
    each = each.withColumn("mix_order", hash48(F.col("ident"), F.col("mix_copy"), F.lit(seed), F.lit("order")))
    return each.select("doc.*", "mix_copy", "mix_order").repartition("mix_order").sortWithinPartitions("mix_order")


def sql(table: str = "documents", size: float = 1.0, seed: int = 0, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL for mix() with equal shares."""
    h = "('0x' || substr(md5({}), 1, 12))::BIGINT"
    ident = "coalesce(doc_id::VARCHAR, 'null')"
    return f"""
    WITH d AS (SELECT *, coalesce('s' || source, 'n') AS mix_key FROM {table}),
    c AS (SELECT mix_key, count(*) AS n FROM d GROUP BY 1),
    r AS (SELECT mix_key, (1.0::DOUBLE / (SELECT count(*) FROM c)::DOUBLE) * {float(size)}::DOUBLE * (SELECT sum(n) FROM c)::DOUBLE / n::DOUBLE AS rate FROM c),
    m AS (SELECT mix_key, greatest(1, ceil(rate / {CHUNK_RATE}))::INT AS draws, rate / greatest(1, ceil(rate / {CHUNK_RATE})) AS mean FROM r),
    p AS (SELECT mix_key, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY mix_key ORDER BY k) AS cdf
          FROM m, range(0, {TERMS + 1}) t(k)),
    f AS (SELECT mix_key, list(cdf ORDER BY k) AS cdf FROM p GROUP BY 1),
    e AS (SELECT d.*, unnest(range(1, draws + 1)) AS mix_draw FROM d JOIN m USING (mix_key)),
    u AS (SELECT e.*, ({h.format(f"{ident} || ':' || mix_draw || ':{seed}'")} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS mix_u FROM e),
    n AS (SELECT u.*, len(list_filter(f.cdf, lambda x: u.mix_u > x)) AS mix_n FROM u JOIN f USING (mix_key)),
    x AS (SELECT n.*, (mix_draw - 1) * 1000 + unnest(range(0, mix_n)) AS mix_copy FROM n WHERE mix_n > 0)
    SELECT {columns}, mix_copy::BIGINT AS mix_copy, {h.format(f"{ident} || ':' || mix_copy || ':{seed}:order'")} AS mix_order FROM x"""
