"""Readers of the input forms."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import concat_text, first_text, flat_text, strip
from textmill.operators.align import parse_vectors
from textmill.operators.budget import running_before
from textmill.plans.shared import exists


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; a bad line is left out, or stops the read if strict. A missing path is empty unless strict; other failures stop the read."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def parquet_texts(spark: SparkSession, paths: list[str], fields: list[str]) -> DataFrame:
    """(text): the requested columns that exist, joined by spaces; the first column if none is requested or exists."""
    df = spark.read.parquet(*paths)
    have = [f for f in fields if f in df.columns] or df.columns[:1]
    types = dict(df.dtypes)
    return df.select(concat_text(*[(f, types[f].startswith("array")) for f in have]).alias("text")).where("text <> ''")


def http_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): stripped lines that aren't blank, of staged files."""
    return spark.read.text(path).select(strip("value").alias("text")).where("text <> ''")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def term_list(spark: SparkSession, path: str, limit: int = 2048) -> DataFrame:
    """(term) of the first lines that aren't blank, in the order of file and line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("i"), strip("value").alias("term"))
    return lines.where("term <> ''").orderBy("f", "o", "i").limit(limit).select("term")


def id_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(tokens) of lines of ids."""
    return spark.read.text(path).select(F.array_remove(F.split(F.trim("value"), r"\s+"), "").alias("tokens")).where(F.size("tokens") > 0)


def every_field(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(order, field_ix, text): each present field that isn't empty as a text of its own."""
    types = {f.name: f.dataType for f in df.schema.fields}
    have = [f for f in fields if f in types]
    texts = F.array(*[F.struct(F.lit(i).alias("field_ix"), flat_text(F.col(f), types[f]).alias("text")) for i, f in enumerate(have)])
    return df.select(order, F.explode(texts).alias("t")).select(order, "t.field_ix", "t.text").where("text <> ''")


def in_order(parts: list[DataFrame]) -> DataFrame:
    """The union of parts with their number as part_ix."""
    return reduce(DataFrame.unionByName, [p.withColumn("part_ix", F.lit(i)) for i, p in enumerate(parts)])


def sample_texts(df: DataFrame, order: list[str], cap: int = 2000, more: DataFrame | None = None) -> DataFrame:
    """The first `cap` rows in order; those of `more`, with the same columns, follow if df has fewer."""
    if more is None:
        return df.orderBy(*order).limit(cap)
    return in_order([df, more]).orderBy("part_ix", *order).limit(cap).drop("part_ix")


def limited(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in order, or all if n is 0.

    Ranks are taken of range-sorted rows, so a large group is no single task.
    """
    if not n:
        return df
    return running_before(df.withColumn("_one", F.lit(1)), by, order, "_one", "_rank").where(F.col("_rank") < n).drop("_one", "_rank")


def first_that_has(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback only if the primary has no row."""
    return fallback if primary.isEmpty() else primary


def perplexity_texts(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, first_text(df, "text", "abstract", "sentence").alias("text")).where("text <> ''")


def warmup_texts(parts: list[tuple[DataFrame, str]], fields: list[str], cap: int = 20_000) -> DataFrame:
    """(part_ix, order, field_ix, text): every field of each part (rows, order column) in turn, the first `cap` of all."""
    texts = in_order([every_field(df, fields, order).withColumnRenamed(order, "order") for df, order in parts])
    return texts.orderBy("part_ix", "order", "field_ix").limit(cap).select("part_ix", "order", "field_ix", "text")


# Benchmark families with their splits and the names that a fetcher may know them by, in the order they are tried.
BENCHMARKS = {
    "pubmedqa": (("train", "validation", "test"), ("qiaojin/PubMedQA", "pubmed_qa")),
    "medqa": (("train", "validation", "test"), ("GBaker/MedQA-USMLE-4-options", "bigbio/med_qa")),
    "mednli": (("train", "validation", "test"), ("bigbio/mednli", "medarc/mednli")),
    "ncbi_disease": (("train", "validation", "test"), ("ncbi_disease", "bigbio/ncbi_disease")),
    "bc5cdr": (("train", "validation", "test"), ("bigbio/bc5cdr", "tner/bc5cdr")),
    "medmcqa": (("train", "validation", "test"), ("openlifescienceai/medmcqa", "medmcqa")),
    "mmlu": (("test",), ("cais/mmlu", "lukaemon/mmlu")),
}


def fetch_splits(fetch: Callable[[str, str], DataFrame], available: Callable[[str], list[str]], dataset: str, splits: list[str]) -> DataFrame | None:
    """The union, in order, of those of the wanted splits that a set has; one that can't be fetched is left out with a warning."""
    parts = []
    for split in splits:
        if split in available(dataset):
            try:
                parts.append(fetch(dataset, split))
            except (OSError, LookupError, ValueError) as e:
                warnings.warn(f"{dataset} {split}: {e}", stacklevel=2)
    return in_order(parts) if parts else None


def stage_benchmarks(spark: SparkSession, fetch: Callable[[str, str], DataFrame], folder: str, wanted: dict = BENCHMARKS, required: tuple[str, ...] = ()) -> DataFrame:
    """(name, split, candidate, rows): each split of the wanted sets as JSON lines in the folder, from the first candidate that fetch() gives.

    fetch(candidate, split) returns a table or raises OSError, LookupError or ValueError. A set
    that no candidate gives has a null candidate, or stops the staging if it is required.
    """
    report = []
    for name, (splits, candidates) in wanted.items():
        for split in splits:
            for candidate in candidates:
                try:
                    rows = fetch(candidate, split)
                except (OSError, LookupError, ValueError):
                    continue
                path = f"{folder}/{name}_{split}.jsonl"
                rows.write.mode("overwrite").json(path)
                report.append((name, split, candidate, spark.read.schema(rows.schema).json(path).count()))
                break
            else:
                if name in required:
                    raise LookupError(f"no candidate gives {name} {split}")
                report.append((name, split, None, 0))
    return spark.createDataFrame(report, "name string, split string, candidate string, rows long")


def benchmark(spark: SparkSession, folder: str, name: str, split: str, schema: str, fetch: Callable[[str, str], DataFrame] | None = None) -> DataFrame:
    """A benchmark's split from its staged file, or where there is none from the first of its candidates that fetch() gives."""
    path = f"{folder}/{name}_{split}.jsonl"
    if exists(spark, path):
        return json_lines(spark, path, schema, strict=True)
    for candidate in BENCHMARKS.get(name, ((), ()))[1] if fetch else ():
        try:
            return fetch(candidate, split)
        except (OSError, LookupError, ValueError):
            continue
    raise FileNotFoundError(path)


def config(text: str) -> dict:
    """A configuration in JSON, or in YAML where a YAML library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def latest_run(runs: DataFrame) -> DataFrame:
    """The valid run (name, mtime, valid) with the latest time; the later name on a tie."""
    return runs.where("valid").agg(F.max_by("name", F.struct("mtime", "name")).alias("name"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few short lists of settings."""
    rows = spark.range(1, numPartitions=1)
    for name, own in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, own))))
    return rows.drop("id")


def folder_bytes(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """(name, files, bytes, percent) of each entry of a folder with all below it: what a run has written so far, and its share of the target (of all bytes without one).

    Names and sizes alone are listed, by Spark's readers; no file is opened. Hidden and empty files aren't counted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = "/" + path.split("://", 1)[-1].split("/", 1)[-1].strip("/") + "/" if "://" in path else path.rstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    own = files.select(F.substring_index(below, "/", 1).alias("name"), "length").groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    whole = own.agg(F.sum("bytes").alias("_all"))
    return own.crossJoin(F.broadcast(whole)).select("name", "files", "bytes", F.round(100 * F.col("bytes") / (F.lit(target) if target else F.col("_all")), 4).alias("percent"))  # one row beside each
