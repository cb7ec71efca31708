"""The text functions for SQL: temporary functions of a session, written in SQL, so that the optimiser sees through them.

    norm_text(t), word_count(t), text_words(t), extract_letter(t), text_terms(t)   columns
    hash_3gram(t)                                                                  by Arrow batches
    text_chunks(t, most)                                                           a table, for LATERAL, by Arrow batches
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import TERM, WS, hash_of

_words = f"array_remove(split(coalesce(t, ''), r'{WS}+'), '')"
#: Name, parameters, result and body of each function.
FUNCTIONS = {
    "norm_text": ("t STRING", "STRING", f"trim(regexp_replace(coalesce(t, ''), r'{WS}+', ' '))"),
    "text_words": ("t STRING", "ARRAY<STRING>", _words),
    "word_count": ("t STRING", "INT", f"size({_words})"),
    "extract_letter": ("t STRING", "STRING", r"upper(regexp_extract(coalesce(t, ''), r'(?i)\b([ABCD])\b', 1))"),
    "text_terms": ("t STRING", "ARRAY<STRING>", f"filter(regexp_extract_all(coalesce(t, ''), r'{TERM}', 0), x -> length(x) <= 64)"),
}


@F.udtf(returnType="chunk_ix int, piece string", useArrow=True)
class TextChunks:
    """text_chunks(t, most): pieces of at most `most` characters; longer texts overlap by a tenth, 200 at most. A null text has none."""

    def eval(self, t: str, most: int):
        if t is None:
            return
        step = most - min(200, most // 10)
        for i in range(1 if len(t) <= most else (len(t) - 1) // step + 1):
            yield i, t[i * step : i * step + most]


_registered: set[int] = set()


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session, once."""
    if id(spark) in _registered:
        return
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("text_chunks", TextChunks)

    @F.arrow_udf("string")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([hash_of(t) for t in texts.to_pylist()], pa.string())

    spark.udf.register("hash_3gram", hashes)
    _registered.add(id(spark))
