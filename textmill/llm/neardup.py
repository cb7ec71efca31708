"""Near-duplicate groups by MinHash bands, with odd sketches as the candidates' first check.

Texts become sets of word shingles; sets are hashed to MinHash samples, whose bands find
candidates. The samples are also folded into a parity bitmap, the odd sketch: the population
count of two bitmaps' XOR estimates their similarity, most precisely where it is high, and
candidates that it rules out need no look at the sets. What is left is confirmed on the full sets
of words themselves.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, few, held, map_arrow, materialize, steps

#: Rows of a band, samples of a sketch and its bits.
ROWS, SAMPLES, BITS = 4, 256, 512
#: Bits of a set's own parity bitmap.
SET_BITS = 1024
#: How likely a link of just the wanted similarity may be to share no band.
MISS = 1e-7
#: Candidates are ruled out only if their sketches differ in more bits than this many standard
#: deviations above what is expected of a pair of just the wanted similarity.
DEVIATIONS = 6
#: Words whose hashes a Python worker remembers, and the longest of them. Results don't depend on it.
WORDS, LONGEST = 100_000, 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Near:
    """What counts as near: `shingle` words, linked from a similarity of `percent` on."""

    shingle: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def most_bits(self) -> int:
        """The largest population count of two sketches' XOR that is not ruled out."""
        s = self.percent / 100
        flips = 2 * (SAMPLES * (1 - s) + DEVIATIONS * math.sqrt(SAMPLES * s * (1 - s)))
        bits = BITS * (1 - math.exp(-2 * flips / BITS)) / 2
        return math.ceil(bits + DEVIATIONS * math.sqrt(bits) / 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_seeds = np.arange(1, 4097, dtype=np.uint64) * MULTIPLIER
PERM_A = mix(_seeds[400 : 400 + SAMPLES]) | np.uint64(1)
#: A-Z as a-z, all other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The key of the words' hashes; it only keeps texts from being made to collide.
WORD_KEY = b"textmill word shingles"


class Words(dict):
    """The number of each word met, and 128-bit keyed BLAKE2b hashes of the words by number, in two lanes of 64 bits."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.lanes = np.zeros((2, 1024), np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def __call__(self, texts: list[list[bytes]]) -> np.ndarray:
        """Both lanes of all texts' words in order."""
        if len(self) > WORDS:
            self.clear()
        n = len(self)
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if self.new:
            if len(self) > self.lanes.shape[1]:
                grown = np.zeros((2, 2 * len(self)), np.uint64)
                grown[:, :n] = self.lanes[:, :n]
                self.lanes = grown
            made = b"".join([hashlib.blake2b(w, key=WORD_KEY, digest_size=16).digest() for w in self.new])
            self.lanes[:, n : len(self)] = np.frombuffer(made, "<u8").reshape(-1, 2).T
        out = self.lanes[:, at]
        if any(len(w) > LONGEST for w in self.new):  # long words are known for this call only
            self.clear()
        self.new = []
        return out


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words between characters of white space."""
    return (text or "").encode().translate(LOWER).split()


def shingle_sets(texts: list[str | None], size: int, words: Words) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted, as two lanes of hashes; fewer words than a shingle make one."""
    split = [words_of(x) for x in texts]
    lanes = words(split)
    n = lanes.shape[1]
    with np.errstate(over="ignore"):
        shingles = np.zeros((2, n), np.uint64)
        for i in range(size):
            shingles[:, : max(0, n - i)] += mix(lanes[:, i:] + np.uint64(i + 1) * MULTIPLIER)
        shingles = mix(shingles)
        sets, a = [], 0
        for own in split:
            b = a + len(own)
            if b - a >= size:
                first, at = np.unique(shingles[0, a : b - size + 1], return_index=True)
                sets.append(np.stack([first, shingles[1, a : b - size + 1][at]]))
            elif b > a:  # told apart from the shingles of `size` words
                terms = mix(lanes[:, a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * MULTIPLIER)
                sets.append(mix(terms.sum(axis=1, dtype=np.uint64) + np.uint64(b - a + 7919) * MULTIPLIER)[:, None])
            else:
                sets.append(np.zeros((2, 0), np.uint64))
            a = b
    return sets


def real_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The set itself, for the confirmation of links."""
    words = words_of(text)
    return set(zip(*[words[i:] for i in range(size)])) if len(words) >= size else {tuple(words)} if words else set()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row for each set; empty sets are taken as {0}."""
    sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out, moved = np.empty((len(sets), SAMPLES), np.uint64), np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k, a in enumerate(PERM_A):
            # Multiplying by an odd number permutes the hashes; their upper bits are well mixed.
            out[:, k] = np.minimum.reduceat(np.multiply(flat, a, out=moved), at)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    with np.errstate(over="ignore"):
        parts = mix(signature[:, : bands * ROWS].reshape(len(signature), bands, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * MULTIPLIER)
        return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64))


def odd_sketches(signature: np.ndarray) -> np.ndarray:
    """Each row's bitmap of BITS bits, as 64-bit integers: a bit is the parity of the samples that hash to it."""
    with np.errstate(over="ignore"):
        bit = (mix(signature + np.arange(1, SAMPLES + 1, dtype=np.uint64) * MULTIPLIER) % np.uint64(BITS)).astype(np.int64)
    counts = np.bincount((np.arange(len(signature))[:, None] * BITS + bit).ravel(), minlength=len(signature) * BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, BITS), axis=1).view(np.int64)


def set_parities(sets: list[np.ndarray]) -> np.ndarray:
    """The same of all of a set's hashes. Two sets differ in at least as many shingles as their bitmaps in bits."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.repeat(np.arange(len(sets)) * SET_BITS, sizes) + (np.concatenate(sets) % np.uint64(SET_BITS)).astype(np.int64)
    counts = np.bincount(at, minlength=len(sets) * SET_BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, SET_BITS), axis=1).view(np.int64)


def features(df: DataFrame, near: Near, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch, parity): all but doc_id depend on the set of shingles alone.

    A row for each row, null texts and texts without words with no shingle. digest stands for the
    set: it is made of 128 bits of each shingle. Sets are counted and compared by 64 of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("near-words",), Words)
        for batch in steps(batches, "text"):
            full = shingle_sets(batch.column("text").to_pylist(), near.shingle, words)
            sets = [x[0] for x in full]
            signature = signatures(sets)
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel().view(np.int64)))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                    "digest": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in full], pa.binary()),
                    "bands": lists(band_keys(signature, near.bands)),
                    "sketch": lists(odd_sketches(signature)),
                    "parity": lists(set_parities(sets)),
                }
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def differing(a: str, b: str, name: str, bits: int) -> Column:
    """The population count of the XOR of two bitmaps."""
    parts = [F.bit_count(F.col(f"{a}.{name}")[i].bitwiseXOR(F.col(f"{b}.{name}")[i])) for i in range(bits // 64)]
    return sum(parts[1:], parts[0])


def alike(a: str, b: str, near: Near) -> Column:
    """Whether a link of a and b is possible by their sizes, their sketches and their sets' parities.

    The sketches estimate the similarity, whatever the sets' sizes. The parities give a lower
    bound of the symmetric difference, which rules out no link at all and is sharp for all but
    very long texts.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = (100 * n >= near.percent * m) & (100 * m >= near.percent * n)
    return sizes & (differing(a, b, "sketch", BITS) <= near.most_bits) & ((100 + near.percent) * differing(a, b, "parity", SET_BITS) <= (100 - near.percent) * (n + m))


def confirm(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Those of the pairs (a, b) whose full sets, the words themselves, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text_a"):
            kept = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                p, q = real_shingles(x, near.shingle), real_shingles(y, near.shingle)
                both = len(p & q)
                kept.append(100 * both >= near.percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    full = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return map_arrow(full.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches; a written table.

    Alternating large and small stars until nothing changes, a number of rounds that grows with
    the logarithm of the nodes. A node's neighbours are summed in parts, and the sums are written
    before they join the edges again: both sides of that join then come straight from a shuffle or
    the small one is broadcast, and AQE can split a node with very many neighbours.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        root = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "root")
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before, least, large, root)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            made = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            made._textmill_path = edges._textmill_path
            return made
        state = now


def near_duplicates(df: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Links are the pairs of different documents with a similarity (shared shingles to all
    shingles) of near.percent or more; component_id is the smallest doc_id that links reach, and
    kept is true where it is the row's own. A null text or one without words has no shingle and
    no link. Rows with one doc_id count as one document; a null doc_id has a null component and
    isn't kept. Other columns are left out. An empty table gives an empty result.

    Equal sets become one representative, by partial minima, before any pairing. In each bucket
    of a band all members are checked against one member, drawn by hash; what this connects is
    not compared again. Then members of different components that share a bucket are compared,
    each pair in the first bucket it shares: by size and sketch inside the join, and on full
    sets where these leave a link possible. No bucket is capped. The result is a written table;
    those made on the way are deleted.
    """
    seen = materialize(features(df, near, id_col, text_col), "near-features")
    reps = seen.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "n_shingles", "bands", "sketch", "parity").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "near-reps")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    pivots = banded.groupBy("band", "key").agg(F.min_by("rep", F.struct(F.xxhash64("rep", "band"), "rep")).alias("pivot"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("band", "key", "pivot")
    members = materialize(banded.join(pivots, ["band", "key"]).select("band", "key", "pivot", "rep"), "near-members")
    ids = materialize(members.select("rep").distinct(), "near-ids")
    rows = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    texts = materialize(rows.join(few(ids), "rep", "left_semi"), "near-texts")
    known = materialize(reps.join(few(ids), "rep", "left_semi").select("rep", "n_shingles", "sketch", "parity", "bands"), "near-known")
    star = members.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    x, y = known.alias("x"), known.alias("y")
    star = star.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(alike("x", "y", near)).select("a", "b")
    links = materialize(confirm(star, texts, near), "near-links")
    starred = components(links)
    named = known.join(starred, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "sketch", "parity", "bands", F.coalesce("label", "rep").alias("label"))
    apart = materialize(members.select("band", "key", "rep").join(named, "rep"), "near-apart")
    # Buckets that the stars have connected are done.
    open_buckets = apart.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band", "key")
    still = materialize(apart.join(open_buckets, ["band", "key"], "left_semi"), "near-open")
    x, y = still.alias("x"), still.alias("y")
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.band") + 1
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & alike("x", "y", near) & first)
    more = materialize(confirm(cross.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), texts, near), "near-more")
    labels = components(links.unionByName(more))
    final = reps.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"))
    # Only sets are shared by many rows; the join is one that AQE can split.
    out = seen.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("label"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near-groups")
    discard(seen, reps, members, ids, texts, known, links, starred, apart, still, more, labels)
    return out
