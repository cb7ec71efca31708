"""Exact and near duplicates, decontamination and the store of seen hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import batches
from textmill.functions.text import hash_3gram, norm_text, words
from textmill.plans.shared import discard, materialize


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key. Minima are taken in parts before the shuffle, so a key with very many rows is no hot task."""
    names = df.columns
    best = df.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def hashed(df: DataFrame, text: str = "text", name: str = "h") -> DataFrame:
    return df.withColumn(name, hash_3gram(norm_text(text)))


def exact_dedup(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The first row, in order, of each text hash. Only hashes and order keys are shuffled, not texts, until the first are known."""
    keys = hashed(df, text).select("h", *order)
    return first_of_each(keys, "h", *order)


def blocklist(bench: DataFrame, *fields: str) -> DataFrame:
    """Hashes of the benchmark rows: of the first of the fields that isn't empty."""
    own = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields], F.lit(""))
    return bench.select(hash_3gram(norm_text(own)).alias("h")).distinct()


def without(df: DataFrame, seen: DataFrame, key: str = "h") -> DataFrame:
    """Rows whose hash the store doesn't hold."""
    return df.join(seen.select(key), key, "left_anti")


def backfill(store: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """Hashes of a corpus that the store lacks, each once."""
    return without(hashed(corpus, text).select("h").distinct(), store)


# Near-duplicates by bands without a look at the texts, and their check.


def word_set(x: Column | str) -> Column:
    return F.array_distinct(words(F.lower(F.col(x) if isinstance(x, str) else x)))


#: Word hashes and their permutations are numbers below this prime, so that their products fit 64 bits.
PRIME = (1 << 31) - 1


def permutations(n: int) -> list[tuple[int, int]]:
    """Factor and summand of n permutations of the numbers below PRIME."""
    draw = lambda name, i: int(hashlib.md5(f"{name}{i}".encode()).hexdigest()[:8], 16) % (PRIME - 1)
    return [(1 + draw("a", i), draw("b", i)) for i in range(n)]


def minhash(word_array: Column, seeds: int, fast: bool = False) -> Column:
    """For each permutation the smallest word hash: of the first 8 hex digits of md5, which SQL engines share, or of xxhash64."""
    value = (lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))) if fast else lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    return least_moved(F.transform(word_array, value), permutations(seeds))


def least_moved(values: Column, moves: list[tuple[int, int]]) -> Column:
    """For each (a, b) the least (a * v + b) % PRIME of a list's values, null for none; a lambda for each value and move would be interpreted."""
    batches.bound()

    def least(lists: pa.Array) -> pa.Array:
        n = batches.sizes(lists) // 8
        flat, full = lists.flatten().to_numpy(zero_copy_only=False), n > 0
        starts = (np.cumsum(n) - n)[full]
        out = np.zeros((len(lists), len(moves)), np.int64)
        for i, (a, b) in enumerate(moves):
            if len(flat):
                out[full, i] = np.minimum.reduceat((flat * a + b) % PRIME, starts)
        rows = pa.array(out.ravel(), mask=np.repeat(~full, len(moves)))
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(moves), dtype=np.int32), rows)

    @F.arrow_udf("array<long>")
    def run(lists: pa.Array) -> pa.Array:
        return batches.by_steps(lists, least)

    return run(values)


def band_rows(df: DataFrame, id_col: str, text: str, bands: int, rows: int, fast: bool = False) -> DataFrame:
    """(id, band, key) of each text with a word."""
    sets = df.select(id_col, word_set(text).alias("w")).where(F.size("w") > 0)
    signed = sets.select(id_col, minhash(F.col("w"), bands * rows, fast).alias("s"))
    keys = F.array(*[F.concat_ws("-", *[F.get("s", F.lit(b * rows + r)).cast("string") for r in range(rows)]) for b in range(bands)])
    return signed.select(id_col, F.posexplode(keys).alias("band", "key"))


def near_candidates(df: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = 3, rows: int = 2) -> DataFrame:
    """(first, other): each row that shares a band with an earlier one, and the first row of that bucket.

    The reference drops a row if a band collides with an earlier kept one; here a bucket's first
    row stands for it, so that a bucket of any size gives as many pairs as it has rows. Links
    between its other rows are not among them; `near_groups` finds those too.
    """
    banded = band_rows(df, id_col, text, bands, rows)
    first = banded.groupBy("band", "key").agg(F.min(id_col).alias("first"))
    return banded.join(first, ["band", "key"]).where(F.col(id_col) > F.col("first")).select("first", F.col(id_col).alias("other")).distinct()


def jaccard(pairs: DataFrame, df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs with the similarity of their word sets."""
    sets = df.select(F.col(id_col).alias("_id"), word_set(text).alias("w"))
    both = pairs.join(sets.select(F.col("_id").alias("first"), F.col("w").alias("a")), "first").join(sets.select(F.col("_id").alias("other"), F.col("w").alias("b")), "other")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("first", "other", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity"))


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links (first, other) lead to, of each id. Labels also jump to their label's label, so chains take few rounds."""
    edges = materialize(links.select("first", "other").union(links.select("other", "first")).distinct(), "links")
    state = materialize(ids.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = edges.join(state, F.col("other") == F.col("id")).groupBy("first").agg(F.min("label").alias("near"))
        least = state.join(near, F.col("id") == F.col("first"), "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = state.select(F.col("id").alias("label"), F.col("label").alias("next"))
        made = materialize(least.join(jump, "label").select("id", "old", F.least("label", "next").alias("label")), "labels")
        discard(state)
        state = made.select("id", "label")
        state._textmill_path = made._textmill_path
        if made.where("old <> label").isEmpty():
            discard(edges)
            return state


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, bands: int = 3, rows: int = 2) -> DataFrame:
    """(id, group_id) of each text with a word; any two whose word sets are at least `percent` similar are in one group.

    Equal sets are one row at first, and `near_candidates` links most copies to their bucket's first
    row. Its buckets may hold unrelated first rows, so an exact step follows: two such sets
    share one of their rarest words, so many that the others can't suffice; rows of different groups
    that share one are compared, if that and the more frequent words of the two would do: this holds at the rarest word
    that two similar sets share. Groups are named by their smallest id; null ids are left out.
    """
    own = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), word_set(text).alias("w")).where(F.size("w") > 0)
    keyed = materialize(own.select("id", F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("key")), "group-keys")
    first = materialize(keyed.groupBy("key").agg(F.min("id").alias("rep")), "group-firsts")
    some = materialize(own.select("id", "text").join(first, F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"]), "group-rows")
    ids = some.select("id")
    close = lambda pairs: jaccard(pairs, some, "id").where(F.col("similarity") >= percent / 100).select("first", "other")
    links = materialize(close(near_candidates(some, "id", "text", bands, rows)), "group-links")
    label = components(ids, links)
    each = materialize(some.select("id", F.explode(word_set("text")).alias("word")), "group-words")
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
    rare = F.slice("w", F.lit(1), (F.size("w") - F.ceil((F.size("w") * percent) / 100) + 1).cast("int"))
    rare = materialize(ranked.select("id", F.size("w").alias("size"), F.posexplode(rare).alias("at", "x")).join(label, "id").select("id", "size", "at", "label", F.col("x.word").alias("word")), "group-rare")
    discard(each)
    mixed = rare.join(rare.groupBy("word").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b"), "word", "left_semi")
    a, b = (mixed.select("word", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "size", "at", "label")]) for x in "ab")
    pairs = a.join(b, "word").where(f"id_a < id_b and label_a <> label_b and 100 * size_a >= {percent} * size_b and 100 * size_b >= {percent} * size_a and {100 + percent} * least(size_a - at_a, size_b - at_b) >= {percent} * (size_a + size_b)")
    more = close(pairs.select(F.col("id_a").alias("first"), F.col("id_b").alias("other")).distinct())
    more = materialize(more, "group-links")
    discard(rare, label)
    label = components(ids, links.union(more))
    discard(links, more)
    return keyed.join(first, "key").join(label.select(F.col("id").alias("rep"), F.col("label").alias("group_id")), "rep").select(F.col("id").alias(id_col), "group_id")


def greedy_near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = 3, rows: int = 21) -> DataFrame:
    """Ids kept if rows come in order and each is dropped that shares a band with an earlier kept row.

    An ordered fixpoint over buckets: a row is kept once every bucket of its has no undecided or
    kept row before it, and dropped once one of its buckets has a kept row before it.
    """
    banded = materialize(band_rows(df, id_col, text, bands, rows, True).withColumnRenamed(id_col, "id"), "greedy-bands")
    state = materialize(banded.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")), "greedy-state")
    while True:
        own = banded.join(state, "id")
        bucket = own.groupBy("band", "key").agg(F.min(F.when(F.col("kept"), F.col("id"))).alias("kept_id"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("open_id"))
        told = own.where("kept is null").join(bucket, ["band", "key"]).groupBy("id").agg(F.max(F.coalesce(F.col("kept_id") < F.col("id"), F.lit(False))).alias("dropped"), F.min(F.coalesce(F.col("open_id") >= F.col("id"), F.lit(True))).alias("first"))
        state = materialize(state.join(told, "id", "left").select("id", F.coalesce("kept", F.when(F.col("dropped"), False).when(F.col("first"), True)).alias("kept")), "greedy-state")
        if state.where("kept is null").isEmpty():
            rest = df.where(F.size(word_set(text)) == 0).select(id_col)
            return state.where("kept").select(F.col("id").alias(id_col)).unionByName(rest)


