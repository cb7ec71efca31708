"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def digest_sql(vec: str) -> str:
    """A number that any changed, moved or missing value of a vector changes."""
    return f"list_sum(list_transform(list_zip({vec}, range(1, len({vec}) + 1)), lambda p: p[2] * round(p[1]::double * 1000000)::bigint))::bigint"


def digest(vec: str) -> Column:
    return F.aggregate(F.transform(vec, lambda x, i: (i + 1) * F.round(x.cast("double") * 1_000_000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
