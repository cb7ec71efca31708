"""Token statistics under a tokenizer that is given as a function from texts to lists of ids."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textmill.functions import batches
from textmill.functions.text import naive_entities, word_count
from textmill.operators.budget import running_before
from textmill.operators.metrics import nearest_rank
from textmill.plans.shared import materialize

#: make() is called once in each Python worker and returns encode(texts) -> lists of ids.
Make = Callable[[], Callable[[list[str]], list[list[int]]]]


def ids_of(text: Column | str, make: Make, most: int | None = None) -> Column:
    """Ids without special tokens, cut to `most`. What a worker holds is bounded by bytes of text, not by rows."""
    batches.bound()

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for texts in columns:
            yield batches.by_steps(texts, lambda some: pa.array([x[:most] for x in own([t or "" for t in some.to_pylist()])], pa.list_(pa.int32())))

    return encode(F.col(text) if isinstance(text, str) else text)


def tokenizer_file(spark: SparkSession, path: str) -> Make:
    """Make for a tokenizers JSON file of the driver's, which is sent to the executors with the application."""
    name = os.path.basename(path)
    if name not in {os.path.basename(p) for p in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)

    def make():
        own = loaded(SparkFiles.get(name))
        return lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]

    return make


@functools.lru_cache(1)
def loaded(path: str):
    """A tokenizer, which a Python worker keeps from task to task until another one is asked for."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_lengths() -> Callable[[list[str]], list[list[int]]]:
    """A Make that SQL can repeat: a token for each four characters of a white-space word, its number of characters the id."""
    return lambda texts: [[len(w[i : i + 4]) for w in t.split() for i in range(0, len(w), 4)] for t in texts]


def tokens_per_word(docs: DataFrame, make: Make, by: str, text: str = "text") -> DataFrame:
    """Average, p50 and p90 (nearest rank) of tokens per white-space word, of texts with a word."""
    n = materialize(docs.select(by, word_count(text).alias("w"), F.size(ids_of(text, make)).alias("t")).where("w > 0").withColumn("r", F.col("t") / F.col("w")), "tokens-per-word")
    return n.groupBy(by).agg(F.avg("r").alias("avg")).join(nearest_rank(n, by, "r", {"p50": 0.5, "p90": 0.9}), by)


def fragmentation(terms: DataFrame, base: Make, adapted: Make) -> DataFrame:
    """(term, base_len, adapted_len, reduction) of distinct terms."""
    once = terms.select("term").distinct()
    return once.select("term", F.size(ids_of("term", base)).alias("base_len"), F.size(ids_of("term", adapted)).alias("adapted_len")).withColumn("reduction", F.col("base_len") - F.col("adapted_len"))


def atomic_coverage(docs: DataFrame, make: Make, order: str, n_docs: int = 256, each: int = 16, text: str = "text") -> DataFrame:
    """The share of entities of one token: the first `each` of the first n_docs texts."""
    some = docs.orderBy(order).limit(n_docs).select(F.explode(F.slice(naive_entities(text), 1, each)).alias("e"))
    sized = some.select(F.size(ids_of("e", make)).alias("n"))
    return sized.agg(F.count("*").alias("entities"), F.coalesce(F.avg((F.col("n") == 1).cast("double")), F.lit(0.0)).alias("coverage"))


def id_corpus(docs: DataFrame, make: Make, order: str, byte_cap: int, most: int = 4096, least: int = 15, text: str = "text") -> DataFrame:
    """(order, line) of ids joined by spaces, of texts with `least` tokens or more, while bytes before a line are under the cap."""
    lines = docs.select(order, F.lit(0).alias("_g"), ids_of(text, make, most).alias("ids")).where(F.size("ids") >= least).select(order, "_g", F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("line"))
    sized = lines.withColumn("nbytes", F.octet_length("line").cast("long") + 1)
    return running_before(sized, "_g", [order], "nbytes", "before").where(F.col("before") < byte_cap).select(order, "line")


def two_id_corpora(docs: DataFrame, base: Make, adapted: Make, order: str, byte_cap: int, fallback: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The id corpora of two tokenizers over the same texts, half of the byte cap each.

    The fallback's texts (order, text) are taken only if the first ones give no line at all.
    """
    made = tuple(materialize(id_corpus(docs, make, order, byte_cap // 2, **options), "id-corpus") for make in (base, adapted))
    if fallback is not None and all(x.isEmpty() for x in made):
        return two_id_corpora(fallback, base, adapted, order, byte_cap, **options)
    return made


def line_stats(lines: DataFrame, order: str, first: int = 10_000, least: int = 15) -> DataFrame:
    """Number, average, p50 and p90 of the lengths of the first lines with `least` tokens or more."""
    n = lines.select(order, F.size(F.split("line", " ")).alias("n")).where(F.col("n") >= least).orderBy(order).limit(first).select(F.lit(0).alias("_g"), "n")
    n = materialize(n, "line-lengths")
    stats = n.groupBy("_g").agg(F.count("*").alias("lines"), F.avg("n").alias("avg"))
    return stats.join(nearest_rank(n, "_g", "n", {"p50": 0.5, "p90": 0.9}), "_g").drop("_g")


def analysis(docs: DataFrame, terms: DataFrame, base: Make, adapted: Make, order: str) -> DataFrame:
    """(metric, tokenizer, value): tokens per word, atomic coverage and fragmentation of two tokenizers, one report."""
    rows = []
    for name, make in (("base", base), ("adapted", adapted)):
        own = tokens_per_word(docs.withColumn("_all", F.lit(0)), make, "_all")
        rows.append(own.select(F.explode(F.create_map(*[x for m in ("avg", "p50", "p90") for x in (F.lit(f"tokens_per_word_{m}"), F.col(m).cast("double"))])).alias("metric", "value"), F.lit(name).alias("tokenizer")))
        rows.append(atomic_coverage(docs, make, order).select(F.lit("atomic_coverage").alias("metric"), F.col("coverage").alias("value"), F.lit(name).alias("tokenizer")))
    cut = materialize(fragmentation(terms, base, adapted), "fragmentation")
    rows += [cut.agg(F.avg(f"{name}_len").alias("value")).select(F.lit("term_tokens").alias("metric"), "value", F.lit(name).alias("tokenizer")) for name in ("base", "adapted")]
    return functools.reduce(DataFrame.unionByName, rows).select("metric", "tokenizer", "value")


def mean_nll(rows: DataFrame, by: str, nll: str = "nll", mask: str = "mask") -> DataFrame:
    """Mean of masked token losses (arrays) by row, an interface for logits that a model elsewhere made."""
    kept = F.filter(F.arrays_zip(nll, mask), lambda x: x[mask] == 1)
    return rows.select(by, (F.aggregate(kept, F.lit(0.0), lambda a, x: a + x[nll]) / F.size(kept)).alias("mean_nll"))


def mean_nll_of(rows: DataFrame, by: str, nll: str = "nll", mask: str = "mask") -> DataFrame:
    """The same of rows with a token's loss each, which no task gathers."""
    return rows.where(F.col(mask) == 1).groupBy(by).agg(F.avg(nll).alias("mean_nll"))


def generate(prompts: DataFrame, generator: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt") -> DataFrame:
    """prompts with a column `raw`: the hook for a text generator, made once in each Python worker."""

    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = generator()
        for texts in columns:
            yield pd.Series(own(texts.fillna("").tolist()))

    return prompts.withColumn("raw", run(prompt))
