"""Tables written to the shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # folders of local applications that name none


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; where that is unset (local tests), a temporary one of the application."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext
        if not app.master.startswith("local[") and app.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.get(app.applicationId) or _own.setdefault(app.applicationId, "file://" + tempfile.mkdtemp(prefix="leadlake-"))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more: all that came from them has been written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
