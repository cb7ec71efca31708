"""A corpus build that reads no more files than its budgets need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators.budget import Build, allowed, build_corpus
from textmill.plans.shared import discard, materialize


def file_ranges(docs: DataFrame) -> DataFrame:
    """(source, path, lo, hi, upto): of each source's files the span of its ids, in order, and the bytes of files up to it.

    Only the two key columns are read.
    """
    keys = docs.select("source", "doc_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    spans = keys.groupBy("source", "path").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("size").alias("size"))
    order = Window.partitionBy("source").orderBy("lo", "path").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).drop("size")


def build_staged(spark: SparkSession, path: str, bench: DataFrame, sources: DataFrame, options: Build = Build(), existing: DataFrame | None = None, first: float = 1.0) -> tuple[DataFrame, list[str], int]:  # noqa: B008
    """(rows as of build_corpus(), the files read, the number of files) of the documents in a folder.

    Each source is read up to a frontier, at first so far that its files hold `first` times its
    target in bytes; while a source is neither full nor read to its end, its frontier moves twice
    as far and the build is made anew from what lies before the frontiers. A source's rows before its
    frontier are complete, and what it keeps depends on these and on earlier sources alone, so once
    all are full or at their end the rows are those of the whole build. Files whose ids overlap
    are read together; where one file holds all, all is read.
    """
    docs = spark.read.parquet(path)
    spans = materialize(file_ranges(docs), "staged-spans")
    n_files = spans.select("path").distinct().count()
    limits = {r["source"]: r["target_bytes"] for r in sources.collect()}  # configuration, a few rows
    reach = {s: max(1.0, first * t) for s, t in limits.items()}
    while True:
        goal = spark.createDataFrame(list(reach.items()), "source string, reach double")
        own = spans.join(F.broadcast(goal), "source").withColumn("taken", F.col("before") < F.col("reach"))
        # Ids before the first file that isn't taken are all in files that are.
        ends = {r["source"]: r["end"] for r in own.groupBy("source").agg(F.min(F.when(~F.col("taken"), F.col("lo"))).alias("end")).collect()}
        files = sorted(r["path"] for r in own.where("taken").select("path").distinct().collect())  # those that are read
        if not files:
            rows = docs.limit(0)
        else:
            frontier = spark.createDataFrame([(s, ends.get(s)) for s in reach], "source string, end long")
            rows = spark.read.schema(docs.schema).parquet(*files).join(F.broadcast(frontier), "source").where("end is null or doc_id < end").select(*docs.columns)
        built = build_corpus(rows, bench, sources, options, existing)
        kept = built.groupBy("source").agg(F.sum("nbytes").alias("bytes"))
        have = existing.select("source", F.col("bytes").alias("have")) if existing is not None else spark.createDataFrame([], "source string, have long")
        room = allowed(sources.join(have, "source", "left").select("source", "ord", "target_bytes", F.coalesce("have", F.lit(0)).alias("have")), built, options.total_bytes)
        short = [r["source"] for r in room.join(kept, "source", "left").where("target_bytes > 0 and coalesce(bytes, 0) < target_bytes").collect() if ends.get(r["source"]) is not None]
        if not short:
            discard(spans)
            return built, files, n_files
        discard(built)
        for s in short:
            reach[s] *= 2
