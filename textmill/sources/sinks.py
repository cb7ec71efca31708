"""Writers of the output forms. Spark's commit makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_lines(df: DataFrame, path: str, append: bool = True) -> None:
    """{"text", "source"} lines in a folder for each source."""
    df.select("text", "source", F.col("source").alias("part")).write.mode("append" if append else "overwrite").partitionBy("part").json(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corpus_summary(counts: DataFrame, path: str, target_total: int) -> None:
    """One JSON line of build_summary()'s rows: bytes added and in all, the target, its percentage, whether it is met, and the sources' counts."""
    own = counts.agg(F.sum("bytes").alias("b"), F.sum("total_bytes").alias("t"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.struct("seen", "kept", "bytes"))))).alias("sources"))
    total = F.coalesce("t", F.lit(0))
    own.select(F.coalesce("b", F.lit(0)).alias("added_bytes"), total.alias("total_bytes"), F.lit(target_total).alias("target_total_bytes"), percent(total, target_total).alias("percent"), (total >= target_total).alias("complete"), "sources").coalesce(1).write.mode("overwrite").json(path)


def percent(done: Column, target: int) -> Column:
    return F.round(100 * done / F.lit(max(1, target)), 1)


def snapshot(df: DataFrame, path: str, keep: list[str] | None = None, most: int | None = None, order: list[str] | None = None) -> None:
    """Some columns, and of the rows the first `most` in order, or any without one."""
    own = df.orderBy(*order) if most and order else df
    own = own.limit(most) if most else own
    (own.select(*keep) if keep else own).write.mode("overwrite").parquet(path)


def id_lines(df: DataFrame, path: str) -> None:
    """Lines of ids, and beside them in `path`.stats one JSON line with their number and ids."""
    df.select("line").write.mode("overwrite").text(path)
    df.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.size(F.array_remove(F.split("line", " "), ""))), F.lit(0)).alias("tokens")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.stats")


def vector_lines(df: DataFrame, path: str) -> None:
    """Lines "<token> f1 ... fd", and beside them in `path`.meta one JSON line with their number and width."""
    df.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)
    df.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")


def alignment(df: DataFrame, path: str, report: DataFrame | None = None) -> None:
    df.select("tgt_id", "src_id").write.mode("overwrite").json(path)
    if report is not None:
        report.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.report")


def metrics(df: DataFrame, path: str) -> None:
    """variant, dataset, metric, value as CSV with a header, as JSON lines, and as JSON in a folder for each dataset."""
    rows = df.select("variant", "dataset", "metric", "value")
    rows.coalesce(1).write.mode("overwrite").csv(f"{path}/results_csv", header=True)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/metrics_json")
    rows.withColumn("part", F.col("dataset")).write.mode("overwrite").partitionBy("part").json(f"{path}/by_dataset")


def samples(df: DataFrame, path: str, order: list[str], each: int = 5) -> None:
    """A Markdown file with the first `each` predictions (dataset, prompt, pred, label) of each dataset."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    lines = df.withColumn("_rank", rank).where(F.col("_rank") <= each)
    text = F.format_string("## %s %d\n\nprompt: %s\n\nprediction: %s\n\nlabel: %s\n", "dataset", "_rank", F.coalesce("prompt", F.lit("")), F.coalesce("pred", F.lit("")), F.coalesce("label", F.lit("")))
    lines.coalesce(1).orderBy("dataset", "_rank").select(text.alias("value")).write.mode("overwrite").text(path)


def statistics(df: DataFrame, path: str) -> None:
    """Bootstrap results (dataset, delta_mean, ci_low, ci_high, p_value_two_sided), a few rows, as JSON and as a Markdown table."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}/stats_json")
    head = df.sparkSession.createDataFrame([(0, "| dataset | delta | 95 % interval | p |"), (1, "| --- | --- | --- | --- |")], "ix int, value string")
    line = F.format_string("| %s | %.4f | %.4f to %.4f | %.4f |", "dataset", "delta_mean", "ci_low", "ci_high", "p_value_two_sided")
    rows = df.select(F.lit(2).alias("ix"), line.alias("value"))
    head.unionByName(rows).coalesce(1).orderBy("ix", "value").select("value").write.mode("overwrite").text(f"{path}/diagnostics_md")


def term_lines(df: DataFrame, path: str) -> None:
    """Terms (term, score) in the order of their scores, one to a line, and beside them in `path`.report their number and the score's bounds."""
    df.coalesce(1).orderBy(F.desc("score"), "term").select("term").write.mode("overwrite").text(path)
    df.agg(F.count("*").alias("added"), F.min("score").alias("least_score"), F.max("score").alias("most_score")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.report")


def sweep(df: DataFrame, path: str) -> None:
    """A grid of settings and their results as one CSV file with a header."""
    df.coalesce(1).orderBy(*df.columns).write.mode("overwrite").csv(path, header=True)
