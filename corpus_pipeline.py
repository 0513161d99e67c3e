"""Corpus pipeline: from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last keep the
columns of documents, whatever their names.  An empty table gives no rows in
every stage.  Each begins by giving back the driver's memory that the ones before
have freed, so that they don't add up beside what a stage trains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm import filters, langid, mixing, neardup, packing, toxicity
from leadlake.llm.queries import read, tokenizer_path
from leadlake.llm.sampling import release, remainder
from leadlake.llm.store import written

#: No SQL expresses the trained stages.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; null and empty texts stay, repeated rows are judged alike."""
    release(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) == 0)
    release(spark)
    return filters.not_toxic(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one known language has at least two fifths; null, empty and letterless texts go, repeated rows are judged alike."""
    release(spark)
    model = langid.train(docs, F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    release(spark)
    return filters.in_a_language(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id (nulls last), of each near-duplicate class; null and empty texts all stay, of repeated rows one."""
    release(spark)
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal expected shares, in random order; a null source is one of its own, repeated rows draw alike."""
    release(spark)
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null text is empty, each repeated row is packed."""
    release(spark)
    packed = packing.pack(docs, tokenizer_path())
    release(spark)
    return packed


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
