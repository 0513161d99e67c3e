"""Bounded training samples: rows chosen by a hash of their id, fetched by a broadcast semi join of ids."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Excerpts by which a long text stands in a sample.
EXCERPTS = 20


def by_hash(rows: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` distinct non-null keys, those of the smallest seeded hash; a column `key` alone."""
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def excerpts(text: str, doc_id: str, most_chars: int):
    """The text; of one longer than `most_chars`, a piece of every `EXCERPTS`-th of it, at a place that a hash of the id picks, `most_chars` in all."""
    size, stride = max(1, most_chars // EXCERPTS), F.floor(F.length(text) / EXCERPTS)
    start = lambda i: i * stride + F.pmod(F.xxhash64(F.col(doc_id), i), F.greatest(stride - size, F.lit(0)) + 1) + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda i: F.substr(F.col(text), start(i).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= most_chars, F.col(text)).otherwise(F.array_join(pieces, "\n"))


def fetch(docs: DataFrame, ids: DataFrame, doc_id: str, columns: list[str], most_chars: int = 100_000):
    """The sampled documents as pandas, ordered by id. `ids` is bounded by its limit; texts longer than `most_chars` are cut to excerpts."""
    text = columns[0]
    wanted = docs.select(doc_id, *columns).where(F.col(text).isNotNull()).join(F.broadcast(ids), doc_id, "left_semi")
    out = wanted.withColumn(text, excerpts(text, doc_id, most_chars)).toPandas()
    return out.drop_duplicates(doc_id).sort_values(doc_id, ignore_index=True)


def remainder(doc_id, n: int):
    """crc32 of the id as text modulo n (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def release(spark: SparkSession | None = None) -> None:
    """Give memory that training has freed back to the system; allocators keep it otherwise, and a driver that trains several models adds it up. With a session, its JVM does so too: a full collection shrinks the heap."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
