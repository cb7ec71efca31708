"""Telemetry of runs: progress, repeats, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(x: Column | str) -> Column:
    """Both forms that event times come in."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HHmmss'Z'")))


def progress(samples: DataFrame, by: str, ts: str, done: str, target: int, tie: str) -> DataFrame:
    """Rate and seconds left between consecutive samples of each run; rates aren't negative, steps last a millisecond at least."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    seconds = F.col(ts).cast("timestamp").cast("double")
    dt = F.greatest(F.lit(1e-3), seconds - F.lag(seconds).over(w))
    step = F.col(done) - F.lag(done).over(w)
    rate = F.when(step.isNotNull(), F.greatest(F.lit(0.0), step / dt))
    out = samples.select("*", rate.alias("rate"), F.greatest(F.lit(0.0), F.lit(float(target)) - F.col(done)).alias("remaining"))
    return out.withColumn("eta_s", F.when(F.col("rate") > 0, F.floor(F.col("remaining") / F.col("rate"))))


def changed(lines: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows that differ from the one before them."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return lines.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def tail(lines: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order]))
    return lines.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def tumbling(events: DataFrame, ts: str, width: str, value: str) -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def throughput(events: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Sum of the values for each second between the first and the last event of a group."""
    span = F.greatest(F.lit(1e-3), F.max(F.col(ts).cast("timestamp").cast("double")) - F.min(F.col(ts).cast("timestamp").cast("double")))
    return events.groupBy(by).agg((F.sum(value) / span).alias("per_s"))


def readiness(present: DataFrame, prefixes: list[str], required: str, least: int = 5) -> DataFrame:
    """Whether enough dataset prefixes, and the required one, are among the names (name)."""
    flags = [F.max(F.col("name").startswith(p).cast("int")) for p in prefixes]
    got = present.agg(*[F.coalesce(f, F.lit(0)).alias(f"p{i}") for i, f in enumerate(flags)], F.coalesce(F.max(F.col("name").startswith(required)), F.lit(False)).alias("has_required"))
    count = sum((F.col(f"p{i}") for i in range(1, len(prefixes))), F.col("p0"))
    return got.select(count.alias("present"), ((count >= least) & F.col("has_required")).alias("ready"))
