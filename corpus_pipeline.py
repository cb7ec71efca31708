"""The training-data pipeline: language ID, quality rules, near-duplicates, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. Of docs each stage reads the columns of documents alone, so
others can't clash with what it adds; an empty table gives an empty result. No stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common, language, neardup, packing, pii, quality
from textmill.llm.queries import PACKING_TOKENIZER, surrogate_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin.

    Null and empty texts, those without letters and ties are rejected; each of repeated rows is
    decided alike; rows with a null id or language are told by their text like all others.
    """
    return language.identify(docs.select(*COLUMNS), keep=COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's reference.

    Null and empty texts fail; each of repeated rows is decided alike; a null language is compared
    with the reference of all. The verdict depends on text and language alone, so that the texts
    that go are named by a digest and a language, and the texts that stay aren't shuffled while
    those are few.
    """
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key")
    keyed = docs.select(*COLUMNS, key, F.coalesce("lang", F.lit("")).alias("_lang"))
    judged = quality.judge(keyed, keep=("_key", "_lang"))
    gone = common.materialize(judged.where(~F.col("kept")).select("_key", "_lang").distinct(), "quality-gone")
    return keyed.join(common.few(gone), ["_key", "_lang"], "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, by 5 words and 0.8.

    Null and empty texts are in no group and stay, as do rows without an id. Repeated rows of one
    id are one document, and stay or go together.
    """
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), neardup.Near())
    gone = common.materialize(groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "near-gone")
    common.discard(groups)
    return docs.join(common.few(gone), "doc_id", "left_anti").select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data.

    A row for each row, null ids and texts included; n_chars is that of the new text.
    """
    made = pii.pseudonymize(docs, surrogate_key(spark), keep=("doc_id", "lang", "source"))
    return made.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences. A null or empty text is one token; repeated rows are packed as often as they come."""
    return packing.pack_documents(docs, PACKING_TOKENIZER)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("surrogates", surrogates), ("best_fit_packing", best_fit_packing)]

#: SQL has no zstandard, keyed permutations or tokenizers; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
