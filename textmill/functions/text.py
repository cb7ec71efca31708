"""Column functions on texts: normalising, hashing, chunking, parsing of answers."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from textmill.functions import batches

#: White space as Unicode has it; Java's and RE2's \s are narrower, in different ways.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a text.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# The patterns of terms and of naive entities, and those of answers below.
TERM = r"[A-Za-z][A-Za-z0-9_\-/]{3,}"
ENTITY = r"[A-Za-z][a-z]+(?:\s+[A-Za-z][a-z]+)*"
#: The same for Java, which takes a stack frame for each turn of a group unless nothing in it is taken back. Nothing needs to be: no white space is a letter.
WHOLE_ENTITY = rf"[A-Za-z][a-z]++(?:{WS}++[A-Za-z][a-z]++)*+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it and however projections are merged."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def strip(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(SPACES))


def norm_text(x: Column | str) -> Column:
    """White space collapsed and stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), f"{WS}+", " "))


def words(x: Column | str) -> Column:
    return F.array_remove(F.split(F.coalesce(col(x), F.lit("")), f"{WS}+"), "")


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


_NOT_A_WORD = re.compile("[^a-z0-9 ]+")


def hash_of(text: str | None) -> str:
    """sha1 over the binary md5 of each 3-word window of the lower-cased text; of the words themselves if fewer than three."""
    k = _NOT_A_WORD.sub(" ", (text or "").lower()).split()
    if len(k) < 3:
        return hashlib.sha1(" ".join(k).encode()).hexdigest()
    md5, out = hashlib.md5, hashlib.sha1()
    for i in range(len(k) - 2):
        out.update(md5(f"{k[i]} {k[i + 1]} {k[i + 2]}".encode()).digest())
    return out.hexdigest()


def hash_3gram(x: Column | str) -> Column:
    """hash_of() by Arrow batches of bounded bytes: an expression of array functions takes an interpreted lambda for each word, and about five times as long (hash_3gram_native)."""
    batches.bound()

    @F.arrow_udf("string")
    def hashes(texts: pa.Array) -> pa.Array:
        return batches.by_steps(texts, lambda some: pa.array([hash_of(t) for t in some.to_pylist()], pa.string()))

    return hashes(col(x))


def hash_3gram_native(x: Column | str) -> Column:
    """The same in array functions alone."""
    tokens = F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9 ]+", " ")), " +"), "")
    window = lambda k: lambda i: F.md5(F.concat_ws(" ", F.get(k, i), F.get(k, i + 1), F.get(k, i + 2)).cast("binary"))
    many = lambda k: F.sha1(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.size(k) - 3, F.lit(0))), window(k)), "")))
    return let(tokens, lambda k: F.when(F.size(k) < 3, F.sha1(F.array_join(k, " ").cast("binary"))).otherwise(many(k)))


def chunks(x: Column | str, most: int) -> Column:
    """Pieces of at most `most` characters; longer texts overlap by a tenth, 200 at most, and the last may lie inside the one before."""
    step = most - min(200, most // 10)
    starts = lambda s: F.sequence(F.lit(0), F.floor((F.length(s) - 1) / step).cast("int"))
    return let(col(x), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.transform(starts(s), lambda k: F.substr(s, k * step + 1, F.lit(most)))))


def coalesce_text(*fields: Column | str) -> Column:
    """The first field that isn't empty; arrays of strings are joined by line feeds."""
    return F.coalesce(*[blank_to_null(F.array_join(c, "\n") if is_array else c) for c, is_array in map(_field, fields)], F.lit(""))


def flat_text(x: Column, kind: DataType) -> Column:
    """A value of any type as text: lists, and the strings and lists of strings in structs and maps, joined by line feeds.

    Of structs in a list the strings and lists of strings count too; numbers in a list or struct don't.
    """

    def strings(v: Column, t: DataType) -> Column | None:
        if isinstance(t, StringType):
            return F.array(v)
        if isinstance(t, ArrayType) and isinstance(t.elementType, StringType):
            return v
        return None

    def of_struct(v: Column, t: StructType) -> list[Column]:
        return [F.coalesce(own, F.array().cast("array<string>")) for f in t.fields if (own := strings(v.getField(f.name), f.dataType)) is not None]

    if isinstance(kind, StructType):
        parts = F.concat(*of_struct(x, kind)) if of_struct(x, kind) else F.array().cast("array<string>")
    elif isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        parts = F.map_values(x)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        inner = kind.elementType
        parts = F.flatten(F.transform(x, lambda v: F.concat(*of_struct(v, inner)) if of_struct(v, inner) else F.array().cast("array<string>")))
    elif isinstance(kind, ArrayType):
        parts = x if isinstance(kind.elementType, StringType) else F.array().cast("array<string>")
    else:
        return x.cast("string")
    return F.array_join(F.filter(parts, lambda v: v.isNotNull() & (v != "")), "\n")


def first_text(df, *names: str) -> Column:
    """The first of the table's columns by these names whose text isn't empty, whatever its type; else empty."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.coalesce(*[blank_to_null(flat_text(F.col(n), types[n])) for n in names if n in types], F.lit(""))


def concat_text(*fields: Column | str) -> Column:
    """All fields joined by spaces, without empty ones; arrays give their items."""
    return F.trim(F.concat_ws(" ", *[F.filter(c, lambda v: v != "") if is_array else blank_to_null(c) for c, is_array in map(_field, fields)]))


def _field(x) -> tuple[Column, bool]:
    """An argument may be (column, True) for an array of strings."""
    return (col(x[0]), x[1]) if isinstance(x, tuple) else (col(x), False)


def json_bytes(text: Column | str, source: Column | str) -> Column:
    """UTF-8 bytes of the JSON line {"text": ..., "source": ...} with a space after each separator, without the line feed."""
    return (F.octet_length(F.to_json(F.struct(col(text).alias("text"), col(source).alias("source")))) + 3).cast("long")


def terms(x: Column | str, longest: int = 64) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(TERM), 0), lambda t: F.length(t) <= longest)


def naive_entities(x: Column | str) -> Column:
    """What ENTITY finds."""
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(WHOLE_ENTITY), F.lit(0))


def normalize_entity(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(x)), f"{WS}+", " ")


def first_match(x: Column | str, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(col(x), pattern, 1))


def last_match(x: Column | str, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(x), F.lit(pattern), 1), F.lit(-1))


def extract_letter(x: Column | str) -> Column:
    return F.coalesce(F.upper(first_match(x, r"(?i)\b([ABCD])\b")), F.lit(""))


def extract_choice(x: Column | str) -> Column:
    """A to D by five rules in order, or empty: the last named answer, the last in brackets, the
    first such letter that no letter follows, the last lone digit 1 to 4, a line's first letter."""
    s = strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), "\r", "\n"))
    digit = last_match(s, r"(?<!\d)([1-4])(?!\d)")
    line = F.regexp_extract(s, rf"^(?:{WS}*\n)*{WS}*([^\n]*)", 1)
    return F.coalesce(
        F.upper(last_match(s, r"(?i)(?:final\s*answer|answer|choice|option|letter)\s*[:=\-]?\s*([ABCD])(?![a-z])")),
        F.upper(last_match(s, r"(?i)[\(\[\{]\s*([ABCD])\s*[\)\]\}]")),
        F.upper(first_match(s, r"(?i)([ABCD])(?![a-z])")),
        F.translate(digit, "1234", "ABCD"),
        F.upper(first_match(line, r"(?i)^([ABCD])(?:\b|\.|\))")),
        F.lit(""),
    )


def starts_with_one_of(x: Column | str, known: list[str], default: str) -> Column:
    low = F.lower(strip(F.coalesce(col(x), F.lit(""))))
    out = F.lit(default)
    for k in reversed(known):
        out = F.when(low.startswith(k), k).otherwise(out)
    return out


def parse_yes_no(x: Column | str) -> Column:
    return starts_with_one_of(x, ["yes", "no", "maybe"], "maybe")


def parse_nli(x: Column | str) -> Column:
    return starts_with_one_of(x, ["entailment", "contradiction"], "neutral")


def parse_spans(x: Column | str) -> Column:
    """Lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda v: v != "")


def clip_at(x: Column | str, stops: list[str]) -> Column:
    out = col(x)
    for stop in stops:
        out = F.substring_index(out, stop, 1)
    return out


def fill_empty(first: Column | str, second: Column | str) -> Column:
    return F.coalesce(blank_to_null(first), col(second), F.lit(""))


def metric_name(x: Column | str) -> tuple[Column, Column]:
    """(dataset, metric) of a name such as medqa_acc; without the ending the metric is the name's own."""
    acc = col(x).endswith("_acc")
    return F.when(acc, F.regexp_replace(col(x), "_acc$", "")).otherwise(col(x)), F.when(acc, "acc").otherwise("value")


# Markers in log texts of errors that pass and of those that don't.
TRANSIENT = ["read timed out", "timed out", "connection reset", "connection reset by peer", "temporary failure in name resolution", "network is unreachable", "502 bad gateway", "503 service unavailable", "504 gateway timeout", "remotedisconnected", "ratelimit", "rate limit", "retrying", "connectionerror"]
FATAL = ["modulenotfounderror", "no module named", "importerror", "command not found", "filenotfounderror", "no such file or directory", "cuda initialization error", "cuda driver version", "out of memory", "permission denied", "killed"]


def contains_any(x: Column | str, markers: list[str]) -> Column:
    return F.lower(F.coalesce(col(x), F.lit(""))).rlike("|".join(markers))


def cache_key(*parts: Column | str) -> Column:
    """16 hex digits for a list of parts; a null is a part of its own, and no two lists are spelled alike."""
    spelled = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in map(col, parts)]
    return F.substring(F.sha1(F.concat_ws("|", *spelled).cast("binary")), 1, 16)
