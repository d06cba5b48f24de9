"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duepath.plans.oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(
    name: str, sql: str | None = None, extra: dict[str, str] | None = None, dates: tuple[str, ...] = ()
) -> Callable[[Query], Query]:
    """Add a query; ``sql`` may name the shared views and those in ``extra``.

    Dates and timestamps leave a query as ISO text, so both engines hand over the same
    values; ``dates`` lists them for the SQL side.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: iso_text(fn(spark, folder))
        if sql is not None:
            body = sql
            if dates:
                swaps = ", ".join(f"cast({d} as varchar) as {d}" for d in dates)
                body = f"select * replace ({swaps}) from ({sql.strip()})"
            ORACLE[name] = with_views(body, extra)
        return fn

    return add


def iso_text(df: DataFrame) -> DataFrame:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields
    ])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double once, at the very end, so both engines print the same."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
