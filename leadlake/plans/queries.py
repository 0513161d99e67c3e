"""Registered queries: each operator over views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..operators import filters, joins, merges, quotas, reports, rollup, sets, texts, windows  # noqa: F401
from ..operators.core import OPERATORS, Operator
from ..sources import pages, structure  # noqa: F401
from . import pipelines, waterfall  # noqa: F401
from .views import VIEWS, with_views

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]


def _views(op: Operator) -> list[str]:
    return [i for i in op.inputs if i in VIEWS]


def _runner(op: Operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return op.run(spark, with_views(SPARK, _views(op)))

    run.__name__, run.__doc__ = op.name, op.__doc__
    return run


def queries() -> dict:
    return {name: _runner(op) for name, op in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    texts = {name: op.sql(DUCK) for name, op in OPERATORS.items()}
    return {name: with_views(DUCK, _views(OPERATORS[name])) + text for name, text in texts.items() if text}
