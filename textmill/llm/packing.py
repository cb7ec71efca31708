"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokenising is one pass without a shuffle, and counts the pieces by length and partition. Equally
long pieces are alike to best fit, so the packing is made over runs of equal lengths (rounds.py), in
bulk-synchronous rounds: documents and gaps sorted, swept for the smallest gap that is large
enough, conflicts resolved by rank, gaps updated. Pieces then look their place up by length and
rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import rounds
from textmill.llm.common import few, held, local_file, map_arrow, materialize, shipped_file, steps

CAPACITY = 2048
#: Words whose ids a Python worker remembers; when so many are known, the plain ones are kept until the next time, and of them those not met by then are forgotten. Results don't depend on it.
WORDS = 450_000
#: Letters that are one character in each case, with closing marks or none; the tokenizer keeps the marks as one piece of their own. No apostrophe: it may open a contraction.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer whose tokens never cross ' ' or a line feed.

    The tokenizer lower-cases, and keeps letters apart from the marks behind them, so a word with
    capitals or closing marks is put together from words and marks that are known already.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> None:
        """Adds words to those known: those of small letters alone, which have one closing token each, in one call."""
        joint = [w for w in words if w.isalpha() and w == w.lower()]
        words = [w for w in words if not (w.isalpha() and w == w.lower())]
        for i in range(0, len(joint), 4096):
            some = joint[i : i + 4096]
            ids = array("I", self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids).tobytes()
            ends = 4 * (np.flatnonzero(self.closes[np.frombuffer(ids, "<u4")]) + 1)
            if len(ends) != len(some):
                words += some
                continue
            at = 0
            for word, end in zip(some, ends.tolist(), strict=True):
                self.known[word] = ids[at:end]
                at = end
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            for word, made in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[word] = array("I", made.ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > self.words:  # what is put together from others needs no memory
            self.known, self.older = {}, {w: ids for w, ids in self.known.items() if w.isalpha() and w.islower()}
        known, older = self.known, self.older
        plain, joint = {""}, {}
        for word in set().union(*parts).difference(known):
            if word in older:
                known[word] = older[word]
            elif (m := SIMPLE(word)) and (m[2] or not m[1].islower()):
                core = m[1].lower()
                joint[word] = (core, m[2])
                plain.add(core)
                plain.add(m[2])
            else:
                plain.add(word)
        new = []
        for word in plain.difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        self.encode(new)
        for word, (core, mark) in joint.items():
            known[word] = known[core] + known[mark]
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in parts]


def tokenize(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids, with the closing id 0: (doc_id, piece, start, length, ids_crc32, part, nth).

    part is the partition and nth the piece's number among the part's pieces of that length. A null
    or empty text is the id 0 alone; null ids, repeated rows and empty tables are as in
    pack_documents(). The tokenizer's file is sent to the executors.
    """
    name = shipped_file(df.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = held(("words", name), lambda: WordIds(local_file(name))), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in steps(batches, "text"):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces of tokenize() with sequence_id and offset."""
    pieces = materialize(pieces, "pieces")
    held = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    runs, _ = rounds.plan(held.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    plan = materialize(runs.withColumnRenamed("length", "plan_length"), "packing-plan")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(held.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(few(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and a closing 0, cut only where longer than capacity, packed by best fit.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    null or empty text is the id 0 alone. Repeated rows are packed as often as they come, null
    ids are carried along, other columns are left out. Pieces of one length are alike to the
    packing; their ranks decide. An empty table gives an empty result.

    The largest shuffle carries about 50 bytes a piece. The rounds' tables and the plan depend on the
    number of distinct lengths (at most `capacity`) and of rounds, not on the number of documents.
    """
    return pack(tokenize(df, tokenizer, capacity, id_col, text_col), capacity)
