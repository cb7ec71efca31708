"""Language identification by compression with per-language dictionaries.

A text is encoded with one zstandard raw-content dictionary for each language; the language
whose dictionary gives the fewest bytes is chosen, and a choice by a narrow margin is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import held, map_arrow, steps

#: The bounded sample that the dictionaries are made from: documents of a language, characters of
#: a span drawn from each, bytes of a dictionary, and bytes of all dictionaries together, which
#: very many languages share evenly.
SAMPLE_DOCS, SPAN, DICTIONARY_BYTES, ALL_BYTES = 600, 500, 96 << 10, 64 << 20
#: Bytes encoded at once. Short blocks keep a long text from becoming its own dictionary.
BLOCK = 4 << 10
LEVEL = 6
#: A choice is rejected if the second best needs less than this share of bytes more.
MARGIN = 0.003
UNKNOWN = "und"
OUTPUT = ("lang_pred", "score", "rejected")
#: All but letters and the marks that belong to them.
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def normalized(text: str) -> bytes:
    """Lower-case letters with their marks, and one space between words; empty if there is no letter."""
    return OTHER.sub(" ", text.lower()).strip().encode() if LETTER.search(text) else b""


def held_out(doc_id):
    """Documents that nothing is learned from; null ids are neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary contents by language, from a bounded sample of the rows with a text and a language.

    Every language that a row names is learned. The sample has the documents of the smallest hashes
    of ids, and of each a span whose place in the whole text is drawn by hash too. Its size depends
    on the parameters above only. Of equal spans one is used.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = docs.where(F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    most = max(1, min(SAMPLE_DOCS, 3 * size // SPAN + 1))
    whole = 1 << 40
    # A row for each language, as many as have just come to the driver.
    shares = docs.sparkSession.createDataFrame([(lang, whole * 2 * most // n) for lang, n in counts.items()], "lang string, share long")
    rank = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(whole))
    place = F.pmod(F.xxhash64(F.lit("span"), F.col("id").cast("string")), F.greatest(F.length("text") - SPAN, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.join(F.broadcast(shares), "lang").where(rank < F.col("share")).select("lang", F.substr("text", place, F.lit(SPAN)).alias("span"), rank.alias("rank"))
    texts: dict[str, dict[bytes, None]] = {}
    for r in drawn.orderBy("rank", "lang", "span").limit(4 * most * len(counts)).collect():
        own = texts.setdefault(r["lang"], {})
        if len(own) < most and (text := normalized(r["span"])):
            own[text] = None
    return {lang: b" ".join(own)[:size] for lang, own in sorted(texts.items()) if own}


class Classifier:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...]) -> None:
        import zstandard

        self.by_lang = []
        for lang, content in dictionaries:
            prefix = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prefix.precompute_compress(level=LEVEL)
            self.by_lang.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=prefix, write_checksum=False, write_content_size=False, write_dict_id=False).compress))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(bytes, language), fewest first; empty for a text without letters."""
        whole = normalized(text)
        blocks = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
        return sorted((sum(len(compress(b)) for b in blocks), lang) for lang, compress in self.by_lang) if blocks else []


def classify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = (), margin: float = MARGIN) -> DataFrame:
    """Each row's columns `keep` with lang_pred, score and rejected, from its whole text.

    score is the share of bytes that the best language saves against the second best, 1 if only
    one language is known, 0 on a tie (the first by name is taken). A null text, one without
    letters, and any text if no language is known have lang_pred "und", score 0 and are
    rejected. One row out for each row in, repeated ones alike; a column of `keep` that is named as
    one of the three gives way to it. The dictionaries are at most ALL_BYTES; no shuffle; a batch
    is bounded (common.BATCH_BYTES), a longer text is held whole.
    """
    keep = tuple(c for c in keep if c not in OUTPUT)
    known = tuple(sorted(dictionaries.items()))
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held(("languages", known), lambda: Classifier(known)).sizes
        for batch in steps(batches, "_text_"):
            langs, scores, rejected = [], [], []
            for text in batch.column("_text_").to_pylist():
                found = sizes(text or "")
                score = 0.0 if not found else 1.0 if len(found) == 1 else 1 - found[0][0] / found[1][0]
                langs.append(found[0][1] if found else UNKNOWN)
                scores.append(score)
                rejected.append(not found or score < margin)
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, *OUTPUT])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, f"{kept}{', ' if kept else ''}lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """learn() and classify() over the same rows; neither sees labels of held-out rows, and no prediction sees any label."""
    return classify(docs, learn(docs, id_col, text_col, lang_col), text_col, keep)
