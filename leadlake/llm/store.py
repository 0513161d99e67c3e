"""Tables written to the shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # folders of local applications that name none


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (local tests) a temporary one is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        _own[spark.sparkContext.applicationId] = root
    return root


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder; one folder for each value of the columns `by`."""
    path = place(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def erase(*tables: DataFrame, part: str = "") -> None:
    """Delete tables of written(), or one folder of theirs, that nothing reads any more: all that came from them has been written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{df.stored_at}/{part}")
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
