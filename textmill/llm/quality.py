"""Quality rules: divergence from language references, in DataFrame operations alone.

A document's histograms of character classes and of common words are compared with those of its
language by Jensen-Shannon distance. The references are sums over all documents that pass the
base rules. Guards of a minimum length keep short texts from being judged by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialize

#: Characters and words from which the two histograms are judged.
LEAST_CHARS, LEAST_WORDS = 200, 80
#: Distances (0 to 1) beyond which a document is not kept.
FAR_CHARS, FAR_WORDS = 0.27, 0.37
#: A reference is used from so many words on.
LEAST_REFERENCE = 1_000

# Common words by language.
COMMON = {
    "en": "the of and to in is it that a for was on are as with be by he this from at or an not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ce avec il sont aux".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero".split(),
    "it": "di e il la che in un a per una è non del con le da si i della sono al come dei anche nel".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas foi ao".split(),
    "nl": "de van het een en in is dat op te zijn met die voor niet aan er om ook als dan bij door uit naar".split(),
}
#: The reference of all languages together, for documents of none of the above.
ALL = "*"
SPACE = r"[\x20\x09-\x0D]+"
# The character classes, in the order of their tests; the rest are lower-case and other letters.
CLASSES = [("symbol", r"#*$%&|<>"), ("digit", r"0-9"), ("upper", r"\p{Lu}"), ("mark", r".,;:!?'\"()\-"), ("other", r"@=+/\\_~^{}\[\]`")]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where the optimizer would put it in place of each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more.

    Only windows whose 64-bit hash occurs twice are compared as words; most texts have none.
    """

    def count(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i"))
        alike = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        same = lambda h: let(alike(h), lambda s: let(F.sort_array(F.transform(twice(s), window)), places))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(same(h))))

    def twice(s: Column) -> Column:
        key = lambda j: F.get(s, j).getField("k")
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (key(j) == key(j - 1)) | (key(j) == key(j + 1)))
        return F.transform(found, lambda j: F.get(s, j).getField("i"))

    def places(s: Column) -> Column:
        return let(F.sort_array(twice(s)), covered)

    def covered(d: Column) -> Column:
        # Each window covers the words up to the next one's start, three at most; the last covers three.
        steps = F.transform(d, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(words, count).cast("long")


def occurrences(words: Column, vocabulary: list[str]) -> Column:
    """How often each word of a vocabulary in ascending order occurs in words, which holds no others.

    Sorted together with one of each, equal words form one run for each word, in its order.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda j: F.coalesce(F.get(s, j) != F.get(s, j - 1), F.lit(True)))
        return let(starts, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda j, k: F.get(at, k + 1) - j - 1))

    return let(F.sort_array(F.concat(words, F.array(*map(F.lit, vocabulary)))), runs)


def _stripped(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts, base_failed and both histograms of each whole text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    vocabulary = sorted({w for own in COMMON.values() for w in own})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    lang = F.when(F.col("_lang").isin(*COMMON), F.col("_lang")).otherwise(ALL)

    def of_words(w: Column) -> Column:
        common = F.filter(F.transform(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?\"')|#*$%&")))), lambda x: x.isin(vocabulary))
        tally = let(common, lambda c: F.concat(occurrences(c, vocabulary), F.array(F.size(w) - F.size(c))))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), tally.alias("word_hist"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        *[f"_keep_{c}" for c in keep],
        lang.alias("reference"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(text).cast("long").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(word_array(text), of_words).alias("w"),
        *[_stripped(text, kept).alias(name) for name, kept in CLASSES],
    )
    letters = F.col("word_chars") - sum((F.col(name) for name, _ in CLASSES[1:]), F.col("symbol"))
    n_words, n_repeat = F.col("w.n_words"), F.col("w.n_repeat_words")
    return rows.select(
        "doc_id",
        *[f"_keep_{c}" for c in keep],
        "reference",
        "n_chars",
        n_words.alias("n_words"),
        "word_chars",
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        n_repeat.alias("n_repeat_words"),
        ((n_words < 50) | (100 * n_repeat > 50 * n_words)).alias("base_failed"),
        F.array(*[F.col(name) for name, _ in CLASSES], letters, F.col("n_chars") - F.col("word_chars")).alias("char_hist"),
        F.col("w.word_hist").cast("array<long>").alias("word_hist"),
    )


def references(rows: DataFrame) -> DataFrame:
    """(reference, char_ref, word_ref): summed histograms by language, and of all together.

    At most one row for each language of COMMON and one more, whatever the size of the input.
    """
    n_chars, n_words = len(CLASSES) + 2, len({w for own in COMMON.values() for w in own}) + 1
    good = rows.where(~F.col("base_failed"))
    total = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)) for i in range(n)])
    by_lang = good.groupBy("reference").agg(total("char_hist", n_chars).alias("char_ref"), total("word_hist", n_words).alias("word_ref"))
    both = by_lang.where(F.col("reference") != ALL).unionByName(by_lang.select(F.lit(ALL).alias("reference"), *[F.col(x) for x in ("char_ref", "word_ref")]).groupBy("reference").agg(total("char_ref", n_chars).alias("char_ref"), total("word_ref", n_words).alias("word_ref")))
    return both.where(F.aggregate("word_ref", F.lit(0).cast("long"), lambda a, x: a + x) >= LEAST_REFERENCE)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance with logarithms to the base 2, of two arrays of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    term = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: let(F.struct((a / sums.getField("p")).alias("a"), (b / sums.getField("q")).alias("b")), lambda s: term(s.getField("a"), (s.getField("a") + s.getField("b")) / 2) + term(s.getField("b"), (s.getField("a") + s.getField("b")) / 2)))
        return F.when((sums.getField("p") > 0) & (sums.getField("q") > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / (2 * math.log(2)))))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), of)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Base counts, distances and verdict of each row.

    One row out for each row in: doc_id, the columns `keep`, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept. Null and empty
    texts have no words and fail the base rules. A null or other language is compared with the
    reference of all languages. Where a text is too short for a histogram, or a reference has
    fewer than LEAST_REFERENCE words, the distance is null and the base rules alone decide.
    Repeated rows are judged alike, and count as often in the references. Of other columns only
    those in `keep` are read, so their names can't clash.

    The texts are read once: their histograms, a few hundred bytes a row, go to the shared
    folder, are summed there and compared. The references are broadcast; there are at most
    len(COMMON) + 1.
    """
    rows = materialize(features(docs, id_col, text_col, lang_col, keep), "quality")
    refs = F.broadcast(references(rows).withColumnRenamed("reference", "_ref"))
    own = rows.join(refs, F.col("reference") == F.col("_ref"), "left")
    own = own.withColumn("char_distance", F.when(F.col("n_chars") >= LEAST_CHARS, distance(F.col("char_hist"), F.col("char_ref"))))
    own = own.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("word_hist"), F.col("word_ref"))))
    far = (F.coalesce("char_distance", F.lit(0.0)) > FAR_CHARS) | (F.coalesce("word_distance", F.lit(0.0)) > FAR_WORDS)
    return own.select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
