"""License scan by ordered signature rules.

A few hundred regular expressions (`signatures`), written by hand from license texts, notices,
names and tags, are gated by keywords: a rule runs only on a text that holds one of its keywords,
which an automaton finds in one pass. Where detections overlap, one that lies inside another of
the same or a higher priority is suppressed. Lower numbers are higher priorities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import held, map_arrow, steps, utf8
from textmill.llm.signatures import signatures

#: The base phrases of the contract and their labels.
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = (LOWER >= 128) | ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,rule:string,start:int,end:int>>"


class Scanner:
    """The rules by keyword; one is built in each Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = signatures()
        by_key: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for key in rule[0]:
                by_key.setdefault(key, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key, own in by_key.items():
            self.automaton.add_word(key, own)
        self.automaton.make_automaton()

    def detect(self, lowered: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of what is left after suppression, in order of place."""
        due: set[int] = set()
        for _, own in self.automaton.iter(lowered):
            due.update(own)
        return self.suppressed([(m.start(), m.end(), i) for i in sorted(due) for m in self.rules[i][5].finditer(lowered) if m.end() > m.start()])

    def suppressed(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Without those that lie inside another one of their own or a higher priority; of equal ones the first rule stays.

        One sweep by start: what may hold a detection starts no later, so the furthest end of each
        priority so far decides.
        """
        priority = lambda i: self.rules[i][3]
        furthest, kept = [-1] * 6, []
        for start, end, i in sorted(found, key=lambda x: (x[0], -x[1], priority(x[2]), x[2])):
            if max(furthest[: priority(i) + 1]) < end:
                kept.append((start, end, i))
            furthest[priority(i)] = max(furthest[priority(i)], end)
        return kept


def base_places(lowered: str) -> list[tuple[int, str]]:
    """(first word's number, label) of each base phrase."""
    words = WORD.findall(lowered)
    return [(i, label) for i, word in enumerate(words) for phrase, label in BASE if word == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = held(("licenses",), Scanner)
    kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in steps(batches, "text"):
        raw, offsets = utf8(batch.column("text"))
        n = batch.num_rows
        inside = IN_WORD[raw]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        starts[edge] = inside[edge]
        total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
        lowered = LOWER[raw].tobytes()
        base: dict[int, list] = {}
        found: dict[int, list] = {}
        for row in range(n):
            text = lowered[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")
            if "license" in text and (places := base_places(text)):
                base[row] = places
            if hits := own.detect(text):
                found[row] = hits
        at = [base.get(i, ()) for i in range(n)]
        hit = [[(own.rules[r], a, b) for a, b, r in found.get(i, ())] for i in range(n)]
        labels = [{label for _, label in x} for x in at]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(total[offsets[1:]] - total[offsets[:-1]]),
                "n_base": pa.array([len(x) for x in at], pa.int64()),
                "first_word": pa.array([x[0][0] if x else None for x in at], pa.int64()),
                "last_word": pa.array([x[-1][0] if x else None for x in at], pa.int64()),
                "base_labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                "labels": pa.array([",".join(sorted(x | {h[0][1] for h in y})) for x, y in zip(labels, hit, strict=True)], pa.string()),
                "score": pa.array([max([0.9 if x else 0.0, *(h[0][4] for h in y)]) for x, y in zip(labels, hit, strict=True)], pa.float64()),
                "detections": pa.array([[{"label": h[0][1], "rule": h[0][2], "start": h[1], "end": h[2]} for h in y] for y in hit], kind),
            }
        )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections of each row's whole text.

    One row out for each row in, repeated rows included; other columns are left out, so their
    names can't clash. A null or empty text has no word, no label and score 0; a null id stays
    null. An empty table gives an empty result. Ties between rules at one place go to the
    earlier rule. No shuffle; batches are bounded, a longer text is held whole.
    """
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _scan, SCHEMA)
