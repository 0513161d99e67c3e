"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrival import exploded, first_arrivals, ingest_keys
from ..sources.store import written

#: Buckets of the keys of known leads; a batch reads those that its own keys fall into.
BUCKETS = 64


def files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", at_once: int | None = None) -> DataFrame:
    """A file stream over a folder of Parquet files, `at_once` files a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(folder)


def _there(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def incremental_ingest(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, order: str = "ingest_seq", buckets: int = BUCKETS, same: dict[str, str] | None = None):
    """Appends to the Parquet table the rows that share no key with an earlier row that was appended.

    `same` names the keys and their SQL; without it they are those of
    `ingest_keys`: place, website and name.
    The keys of the appended rows are a state of their own beside the table
    (`<table>-keys`, by bucket and batch): a batch reads the buckets that its own
    keys fall into, never the table.  Inside a batch rows count in the order of
    `order`; so the outcome is that of one row after another, wherever batches are
    cut, if batches arrive in that order.  A batch that is run again replaces what
    it wrote.  Missing columns count as null; an empty batch writes nothing.
    """
    spark, keys = stream.sparkSession, f"{table}-keys"
    own = {k: F.expr(v) for k, v in (same or ingest_keys()).items()}
    bucket = F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")

    def save(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        absent = [F.lit(None).cast("string").alias(c) for c in ("place_id", "website", "company_name", "location") if c not in batch.columns]
        rows = written(batch.select("*", *absent).select(*batch.columns, *(e.alias(k) for k, e in own.items())), "batch")
        asked = exploded(rows, list(own)).distinct().withColumn("bucket", bucket)
        seen = None
        if _there(spark, keys):
            touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most `buckets` numbers
            state = spark.read.schema("kind int, key string, bucket int, batch long").parquet(keys)
            state = state.where(F.col("bucket").isin(touched) & (F.col("batch") != number))
            seen = state.join(asked, ["bucket", "kind", "key"], "left_semi").select("kind", "key")
        kept = rows.join(first_arrivals(rows, list(own), order, seen), order, "left_semi")
        save(exploded(kept, list(own)).withColumn("bucket", bucket).withColumn("batch", F.lit(number).cast("long")), keys, "bucket", "batch")
        save(kept.select(*batch.columns).withColumn("batch", F.lit(number)), table, "batch")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(stream: DataFrame, key: str, table: str, checkpoint: str, trigger: dict | None = None):
    """Each key once over the whole stream, kept in the stream's state."""
    once = stream.dropDuplicates([key]).select(key)
    return once.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
