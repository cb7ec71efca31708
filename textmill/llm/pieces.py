"""SentencePiece merge-type (BPE) encoding by a prefix table, and decoding.

A prefix of a text has one encoding, so it has one last token. The table is filled from left to
right: an Aho-Corasick automaton gives the vocabulary's pieces that end at a place, and of these
exactly one is compatible with the last token of the prefix before it. Two tokens are compatible
if merging the two's joined text gives just these two. The ids are then read backwards. The
table takes linear time, whatever order the merges would have come in.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import held, local_file, map_arrow, shipped_file, steps

SPACE = "▁"
#: Segments whose ids a Python worker remembers, twice, and the longest of them: when so many are
#: known, those not met since the last time are forgotten. Results don't depend on it.
SEGMENTS, LONGEST = 400_000, 64
SCHEMA = "doc_id long, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixTable:
    """Encoder for a merge-type model with byte fallback and no text normalisation but spaces."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a merge-type model with byte fallback, a dummy prefix and no other normalisation is expected")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.piece = {i: p for p, i in self.id.items()}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(c not in self.id for p in self.id for c in p) or any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces of known characters are expected, with spaces in front only and no line feed")
        self.automaton = ahocorasick.Automaton()
        self.left: dict[int, list[tuple[str, float, float]]] = {}
        self.right: dict[int, list[tuple[str, float, float]]] = {}
        halves: dict[str, tuple[str, str]] = {}
        for p, i in self.id.items():
            # A piece that its own text doesn't merge to is never in any encoding.
            if self.merged(p, halves) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        for p, i in self.id.items():
            self.left[i], self.right[i] = self.spine(p, halves, 0), self.spine(p, halves, 1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.code = "H" if len(model.pieces) <= 1 << 16 else "I"
        self.decimal = list(map(str, range(len(model.pieces))))
        self.unknown = re.compile("[^" + re.escape("".join(p for p in self.id if len(p) == 1)) + "]").search
        # A segment has its spaces in front; no piece crosses the border of two segments.
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def spine(self, piece: str, halves: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float, float]]:
        """The parts at one edge of a piece: (part, when it is made, when it is merged into the next larger one)."""
        out, end = [], float("inf")
        while piece:
            made = -self.score[piece] if len(piece) > 1 else float("-inf")
            out.append((piece, made, end))
            piece, end = halves[piece][side] if piece in halves else "", made
        return out

    def merged(self, text: str, halves: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The merges as they are defined: best score first, then leftmost. halves: gets what made each part."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if halves is not None and len(parts) == 2:
                halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before those that make a and b."""
        if self.piece[a][-1] == SPACE or self.piece[b][-1] == SPACE:  # runs of spaces have equal scores
            return self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        score = self.score.get
        for x, x_made, x_end in self.right[a]:
            for y, y_made, y_end in self.left[b]:
                s = score(x + y)
                # Both parts stand at the border when this merge is due; of equal ones the left goes first.
                if s is not None and (t := max(-s, x_made, y_made)) < x_end and (t < y_end or t == y_end == -s):
                    return False
        return True

    def encode_known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        last: list[int] = [-1] * (len(text) + 1)
        size: list[int] = [0] * (len(text) + 1)
        compatible = self.compatible
        for end, (n, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - n
                if not before or (last[before] >= 0 and compatible(last[before], token)):
                    last[end], size[end] = token, n
        out, at = [], len(text)
        while at:
            if last[at] < 0:
                raise ValueError(f"no last token for a prefix of {text[:40]!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_segment(self, segment: str) -> list[int]:
        if not self.unknown(segment):
            return self.encode_known(segment)
        out: list[int] = []
        start = 0
        for i, c in enumerate(segment):
            if c not in self.id:  # its UTF-8 bytes, which merge with nothing
                if i > start:
                    out += self.encode_known(segment[start:i])
                out += [self.byte[b] for b in c.encode()]
                start = i + 1
        return out + self.encode_known(segment[start:]) if start < len(segment) else out

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Of each text the ids, and the ids as decimals joined by commas."""
        parts = [self.segments(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        if len(self.known) > SEGMENTS:
            self.known, self.older = {}, self.known
        known, older, passing = self.known, self.older, []
        for segment in set().union(*parts).difference(known):
            own = older.get(segment)
            known[segment] = array(self.code, self.encode_segment(segment)).tobytes() if own is None else own
            if len(segment) > LONGEST:
                passing.append(segment)
        get, decimal, out = known.__getitem__, self.decimal.__getitem__, []
        for own in parts:
            ids = array(self.code, b"".join(map(get, own))).tolist()
            out.append((ids, ",".join(map(decimal, ids))))
        for segment in passing:
            del known[segment]
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        return self.encode_all([text])[0]


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Each row's ids and what the library decodes them to, with digests of both.

    One row out for each row in. A null or empty text has no ids and decodes to an empty text.
    Null ids of rows are carried along, repeated rows stay, other columns are left out. With
    ids=False the ids and the decoded text are left null, for queries that need the digests
    alone. An empty table gives an empty result. No shuffle; batches are bounded, a longer text is
    held whole. The model's file is sent to the executors.
    """
    name = shipped_file(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(("pieces", name), lambda: PrefixTable(local_file(name)))
        for batch in steps(batches, "text"):
            made = table.encode_all([x or "" for x in batch.column("text").to_pylist()])
            texts = table.library.decode([x[0] for x in made], num_threads=1)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.array([x[0] for x in made] if ids else [None] * len(made), pa.list_(pa.int32())),
                    "decoded": pa.array(texts if ids else [None] * len(made), pa.string()),
                    "n_tokens": pa.array([len(x[0]) for x in made], pa.int64()),
                    "ids_sha256": pa.array([sha(x[1]) for x in made]),
                    "decoded_sha256": pa.array([sha(x) for x in texts]),
                }
            )

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)
