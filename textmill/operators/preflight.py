"""Checks of sources before a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source string, split string, ok boolean, reason string, fields_present array<string>"


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """sha256 of each file, computed on the executors; keys are the files' names."""
    rows = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
    return {r["name"]: r["sha"] for r in rows}


def check_parquet(spark: SparkSession, source: str, paths: list[str], fields: list[str], expected: dict[str, str] | None = None) -> tuple:
    """(source, split, ok, reason, fields_present) of a Parquet source."""
    try:
        df = spark.read.parquet(*paths)
    except Exception as e:  # noqa: BLE001  any unreadable input is a finding, not an error
        return source, "parquet", False, f"unreadable: {type(e).__name__}", []
    present = [f for f in fields if f in df.columns] if fields else df.columns[:1]
    if not present:
        return source, "parquet", False, "no requested column", []
    if df.select(*present).limit(1).isEmpty():
        return source, "parquet", False, "empty", present
    if expected:
        got = checksums(spark, paths)
        wrong = sorted(n for n, sha in expected.items() if got.get(n.rsplit("/", 1)[-1]) != sha)
        if wrong:
            return source, "parquet", False, f"checksum mismatch: {', '.join(wrong)}", present
    return source, "parquet", True, "ok", present


def check_sources(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """A row for each source {name, kind, paths, text_fields, checksums}; kinds are judged by their own rules."""
    rows = []
    for s in specs:
        if s.get("kind", "parquet") == "parquet":
            rows.append(check_parquet(spark, s["name"], s["paths"], s.get("text_fields", []), s.get("checksums")))
        else:
            try:
                df = spark.read.format(s["kind"]).load(s["paths"])
                rows.append((s["name"], s["kind"], not df.limit(1).isEmpty(), "ok" if not df.limit(1).isEmpty() else "empty", [f for f in s.get("text_fields", []) if f in df.columns]))
            except Exception as e:  # noqa: BLE001
                rows.append((s["name"], s["kind"], False, f"unreadable: {type(e).__name__}", []))
    return spark.createDataFrame(rows, SCHEMA)


def overall(report: DataFrame, strict: bool = True) -> DataFrame:
    """One row: ok (of all if strict, of any otherwise) and a line for each failure."""
    ok = F.every("ok") if strict else F.some("ok")
    return report.agg(F.coalesce(ok, F.lit(True)).alias("ok"), F.concat_ws("\n", F.sort_array(F.collect_list(F.when(~F.col("ok"), F.format_string("[%s] %s: %s", "source", "split", "reason"))))).alias("failures"))
