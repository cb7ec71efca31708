"""Fill-in-the-middle transformation by DuckDB's SQL over Arrow batches.

Spark deals out the rows; in each task a DuckDB connection registers one slice of an Arrow batch
after another and turns it by one SQL statement: lines by regexp_extract_all, the three
parts by list_slice and array_to_string, draws and digests by sha256. What comes back is Arrow. No
row is touched by Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import held, map_arrow, steps

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Infill:
    """seed: of the draws. percent: of the documents that are turned. spm: percent of these that begin with the suffix.

    The marks must be three texts that no part of a text can be mistaken for: equally
    long, beginning with a character that stands in them just once.
    """

    seed: int = 7
    percent: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"

    def __post_init__(self) -> None:
        marks = {self.prefix, self.suffix, self.middle}
        if len(marks) < 3 or len({len(m) for m in marks}) > 1 or any(not m or m[0] in n[1:] for m in marks for n in marks):
            raise ValueError("the marks must differ, be equally long, and not hold each other's first characters behind their own first ones")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def statement(how: Infill, outputs: bool) -> str:
    """The SQL over a view `batch` (doc_id, text)."""
    p, s, m, size = _text(how.prefix), _text(how.suffix), _text(how.middle), len(how.prefix)
    group = lambda i: f"('0x' || substr(hash, {8 * i + 1}, 8))::bigint"
    return f"""
        with units as (
            select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_text(how.unit)}) as units, sha256('{int(how.seed)}:' || coalesce(doc_id::varchar, '')) as hash from batch),
        drawn as (
            select doc_id, text, units, len(units) as n, {group(0)} % (n + 1) as h1, {group(1)} % (n + 1) as h2,
                case when text = '' or contains(text, {p}) or contains(text, {s}) or contains(text, {m}) or {group(2)} % 100 >= {int(how.percent)} then 'plain'
                    when {group(3)} % 100 < {int(how.spm)} then 'spm' else 'psm' end as form from units),
        parts as (
            select doc_id, text, n, form, array_to_string(list_slice(units, 1, least(h1, h2)), '') as prefix,
                array_to_string(list_slice(units, least(h1, h2) + 1, greatest(h1, h2)), '') as middle,
                array_to_string(list_slice(units, greatest(h1, h2) + 1, n), '') as suffix from drawn),
        turned as (
            select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
                case form when 'plain' then text when 'psm' then {p} || prefix || {s} || suffix || {m} || middle else {s} || suffix || {p} || prefix || {m} || middle end as output from parts),
        split as (
            select *, string_split(output, {m}) as halves, string_split(halves[1], case form when 'psm' then {s} else {p} end) as front from turned),
        restored as (
            select *, case form when 'plain' then output when 'psm' then substr(front[1], {size + 1}) || halves[2] || front[2] else front[2] || halves[2] || substr(front[1], {size + 1}) end as restored from split)
        select doc_id, n::bigint as n, form, prefix_chars::bigint as prefix_chars, middle_chars::bigint as middle_chars, {'output' if outputs else 'null::varchar'} as output,
            sha256(output) as output_sha256, sha256(restored) as restored_sha256 from restored"""


def connect():
    """A connection of one thread, as Spark has one task a core, that never writes to disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})


def fill_in_middle(df: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:  # noqa: B008
    """SCHEMA: each text as a fill-in-the-middle example, with digests of it and of the text rebuilt from it.

    One row out for each row in. A null text counts as empty; an empty one, one that holds a mark
    and one that isn't drawn stay plain, with null parts. The draws depend on seed and doc_id
    alone: repeated rows are turned alike, a null id draws as an empty one. Parts may be empty.
    With outputs=False `output` is left null, for queries that need the digests alone. Other
    columns are not read. An empty table gives an empty result. No shuffle; slices are
    bounded, a longer text is a slice of its own.
    """
    sql = statement(how, outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = held(("duckdb",), connect)
        for batch in steps(batches, "text"):
            connection.register("batch", pa.Table.from_batches([batch]))
            made = connection.sql(sql).to_arrow_table()
            connection.unregister("batch")
            yield from made.cast(TYPES).combine_chunks().to_batches()

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


TYPES = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in re.findall(r"(\w+) (\w+)", SCHEMA)])
