"""Exact inner-product top-k by columnar branch and bound.

Queries and candidates are dealt into blocks by a hash of their id; each pair
of blocks meets in one bounded cogroup.  There the candidates lie in vertical
layout (one array per dimension).  A query accumulates its products a block of
dimensions at a time; the mass left in the other dimensions bounds what any
candidate can still gain or lose, and candidates whose upper bound falls below
the k-th best lower bound are compacted away.  The best k of each pair of
blocks are ranked at last by query.

Vectors that are null or hold a null or non-finite component take no part; a
missing dimension counts as 0; equal scores rank by smaller id.  Scores are
64-bit integers, so components should be under 2^25 in size with up to 2^10 of
them.  Rows with a null id take no part.  A repeated query id counts once, with one
of its rows; a repeated candidate row is ranked each time.  Empty tables give no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of candidates and of queries, and the least number of candidate blocks.
CANDIDATES, QUERIES, LEAST_BLOCKS = 32_768, 8192, 48
DIMENSIONS = 8


def integers(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def matrix(vectors, width: int) -> np.ndarray:
    """Vertical layout: dimensions by rows."""
    out = np.zeros((width, len(vectors)), np.int64)
    for j, v in enumerate(vectors):
        out[: len(v), j] = v
    return out


def best(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates for one query; rest[b] is each candidate's norm from dimension block b on."""
    width = len(query)
    live = np.flatnonzero(ids != own)
    score = np.zeros(len(live), np.int64)
    for b, d in enumerate(range(0, width, DIMENSIONS)):
        for j in range(d, min(d + DIMENSIONS, width)):
            if query[j]:
                score += query[j] * columns[j][live]
        if d + DIMENSIONS < width and len(live) > 4 * k:
            left = np.sqrt(float(np.square(query[d + DIMENSIONS :].astype(np.float64)).sum())) * rest[b + 1][live] * (1 + 1e-9) + 1
            least = np.partition(score - left, len(live) - k)[len(live) - k]
            keep = score + left >= least
            if not keep.all():
                live, score = live[keep], score[keep]
    order = np.lexsort((ids[live], -score))[:k]
    return ids[live][order], score[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, but for the candidate with the query's own id."""
    shape = lambda df: df.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("id"), integers(vector, scale).alias("v"))
    ours, theirs = shape(queries).dropDuplicates(["id"]), shape(candidates)
    n, m = queries.count(), candidates.count()
    blocks, parts = max(LEAST_BLOCKS, -(-m // CANDIDATES)), max(1, -(-n // QUERIES))
    deal = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    ours = ours.select("id", "v", deal(parts, 1).alias("q"), every(blocks).alias("c"))
    theirs = theirs.select("id", "v", deal(blocks, 2).alias("c"), every(parts).alias("q"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            width = max(map(len, [*a["v"], *b["v"]]))
            columns, ids = matrix(b["v"].tolist(), width), b["id"].to_numpy()
            mass = np.square(columns.astype(np.float64))
            rest = [np.sqrt(mass[d:].sum(axis=0)) for d in range(0, width, DIMENSIONS)]
            for query_id, q in zip(a["id"].tolist(), matrix(a["v"].tolist(), width).T, strict=True):
                found, score = best(np.ascontiguousarray(q), columns, rest, ids, query_id, k)
                out["query_id"] += [query_id] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype("int64")

    pairs = ours.groupBy("c", "q").cogroup(theirs.groupBy("c", "q")).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
