"""Operators: table-level jobs written once as SQL over named inputs.

An operator called with DataFrames runs on Spark:

    filters.target_sector(leads=df)

and `operator.sql(dialect)` gives its statement, which reads tables of the same
names.  What a job's user chooses (terms, days, caps, towns) are keyword arguments
of `sql`, or `options` of a call: filters.search_leads({"least": 7}, leads=df).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, STAGED, Dialect
from ..sources.store import written

OPERATORS: dict[str, Operator] = {}


class Operator:
    def __init__(self, key: str, build: Callable[[Dialect], str], inputs: tuple[str, ...], sides: dict[str, Callable[[Dialect], str]]):
        self.key, self.build, self.inputs, self.sides = key, build, inputs, sides
        self.__doc__ = build.__doc__
        self.name = f"{key.lower()}_{build.__name__}"
        OPERATORS[self.name] = self

    def sql(self, d: Dialect = SPARK, **options) -> str:
        return self.build(d, **options)

    def run(self, spark: SparkSession, tables: str, options: dict | None = None) -> DataFrame:
        """The statement after a WITH clause of its inputs; its sides, if it has any, are written first, in order, and read from there."""
        names = {}
        try:
            for side, build in self.sides.items():
                names[side] = f"{side}_{uuid.uuid4().hex[:8]}"
                written(spark.sql(f"{tables} {build(SPARK)}"), side).createOrReplaceTempView(names[side])
                tables = f"{tables.rstrip()}, {side} AS (SELECT * FROM {names[side]})"  # the next side may read it
            return spark.sql(f"{tables} {self.sql(STAGED if names else SPARK, **(options or {}))}")
        finally:
            for v in names.values():
                spark.catalog.dropTempView(v)

    def __call__(self, options: dict | None = None, **tables: DataFrame) -> DataFrame:
        missing = set(self.inputs) - set(tables)
        if missing:
            raise TypeError(f"{self.name} needs {sorted(missing)}")
        spark = next(iter(tables.values())).sparkSession
        names = {}
        for name, df in tables.items():
            names[name] = f"{name}_{uuid.uuid4().hex[:8]}"
            df.createOrReplaceTempView(names[name])
        try:
            return self.run(spark, "WITH " + ", ".join(f"{n} AS (SELECT * FROM {v})" for n, v in names.items()) + " ", options)
        finally:
            for v in names.values():
                spark.catalog.dropTempView(v)


def query(text: str, **tables: DataFrame) -> DataFrame:
    """The statement over DataFrames, by name."""
    spark = next(iter(tables.values())).sparkSession
    names = {name: f"{name}_{uuid.uuid4().hex[:8]}" for name in tables}
    for name, view in names.items():
        tables[name].createOrReplaceTempView(view)
    try:
        return spark.sql("WITH " + ", ".join(f"{n} AS (SELECT * FROM {v})" for n, v in names.items()) + f" SELECT * FROM ({text}) q")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


class Job(Operator):
    """An operator of several steps: a function of DataFrames.  `plain` states its rule as one SQL text, for comparison; None if SQL can't."""

    def __init__(self, key: str, build: Callable[..., DataFrame], inputs: tuple[str, ...], plain: Callable[..., str] | None):
        super().__init__(key, build, inputs, {})
        self.plain = plain

    def sql(self, d: Dialect = SPARK, **options) -> str | None:
        return self.plain(d, **options) if self.plain else None

    def run(self, spark: SparkSession, tables: str, options: dict | None = None) -> DataFrame:
        return self.build(**{n: spark.sql(f"{tables} SELECT * FROM {n}") for n in self.inputs}, **(options or {}))

    def __call__(self, options: dict | None = None, **tables: DataFrame) -> DataFrame:
        return self.build(**tables, **(options or {}))


def job(key: str, *inputs: str, plain: Callable[..., str] | None = None):
    """Marks a function of DataFrames as the operator of a row of the inventory."""
    return lambda build: Job(key, build, inputs, plain)


def operator(key: str, *inputs: str, sides: dict[str, Callable[[Dialect], str]] | None = None):
    """Marks a builder of SQL as the operator of a row of the inventory; `sides` are statements over its inputs that it reads many times."""
    return lambda build: Operator(key, build, inputs, sides or {})
