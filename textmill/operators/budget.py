"""Byte budgets in the order of sources and rows, and the corpus build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import chunks, json_bytes, norm_text
from textmill.operators.dedup import band_rows, blocklist, first_of_each, hashed, without
from textmill.plans.shared import discard, materialize


def ranged(df: DataFrame, group: str, order: list[str], label: str = "ranged") -> DataFrame:
    """df as a written table with a column _range: rows in order are dealt to ranges of about equal size, numbered in order.

    df is computed once: it is written first, as dealing it out reads it twice. A group with very
    many rows spans as many ranges as it needs, and how the order's values are spread doesn't matter.
    """
    rows = materialize(df, label)
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), label)
    discard(rows)
    return dealt


def running_sum(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """The rows of ranged(), or some of them, with the sum of `value` over the group's rows before each.

    The ranges' totals, a row for each range and group in it, are summed first; then each range by itself.
    """
    totals = df.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col(group).alias("_sum_group"), F.col("_range").alias("_sum_range"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    own = F.sum(value).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_own", own).join(totals, F.col(group).eqNullSafe(F.col("_sum_group")) & (F.col("_range") == F.col("_sum_range")))
    return out.withColumn(name, (F.col("_earlier") + F.coalesce("_own", F.lit(0))).cast("long")).drop("_own", "_earlier", "_sum_group", "_sum_range")


def running_before(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows of the group before each row, in order."""
    return running_sum(ranged(df, group, order), group, order, value, name).drop("_range")


def within_budget(df: DataFrame, targets: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Rows of each source as long as the bytes before them are fewer than its target, which a last row may pass.

    targets (source, target_bytes); existing (source, bytes) counts as written already.
    """
    run = running_before(df, "source", order, "nbytes", "before") if "_range" not in df.columns else running_sum(df, "source", order, "nbytes", "before")
    run = run.join(targets, "source")
    if existing is not None:
        run = run.join(existing.select("source", F.col("bytes").alias("_existing")), "source", "left")
        run = run.withColumn("before", F.col("before") + F.coalesce("_existing", F.lit(0))).drop("_existing")
    return run.where(F.col("before") < F.col("target_bytes"))


def effective_targets(sources: list[tuple[str, int]], existing: dict[str, int], wanted: dict[str, int], total: int) -> list[tuple[str, int]]:
    """Targets under a cap on all sources together, which take what is left in order.

    wanted has the bytes that a source would write by itself. A source with nothing left gets 0.
    """
    left, out = total - sum(existing.values()), []
    for source, target in sources:
        have = existing.get(source, 0)
        room = max(0, min(target - have, left))
        out.append((source, have + room if room else 0))
        left -= min(room, wanted.get(source, room))
    return out


def summary(df: DataFrame) -> DataFrame:
    """kept rows, bytes, and the file's bytes with line feeds, by source."""
    return df.groupBy("source").agg(F.count("*").alias("kept"), F.sum("nbytes").alias("bytes"), (F.sum("nbytes") + F.count("*")).alias("file_bytes"))


@dataclass(frozen=True)
class Build:
    """Options of a corpus build.

    total_bytes caps all sources together; near_dup drops pieces that share a band of 64 MinHash
    permutations with an earlier kept one; drop_blocklist reproduces a build whose dedup store has
    no blocklist.
    """

    most_chars: int = 2000
    least_chars: int = 200
    target_bytes: int = 400_000
    total_bytes: int | None = None
    near_dup: bool = False
    drop_blocklist: bool = False


def pieces(docs: DataFrame, options: Build) -> DataFrame:
    """(source, doc_ord, chunk_ix, text, h, nbytes) of each piece that is long enough."""
    rows = docs.select("source", F.col("doc_id").alias("doc_ord"), norm_text("text").alias("whole")).where("whole <> ''")
    rows = rows.select("source", "doc_ord", F.posexplode(chunks("whole", options.most_chars)).alias("chunk_ix", "text")).where(F.length("text") >= options.least_chars)
    return hashed(rows).withColumn("nbytes", json_bytes("text", "source"))


def build_corpus(docs: DataFrame, bench: DataFrame, sources: DataFrame, options: Build = Build(), existing: DataFrame | None = None, store: DataFrame | None = None) -> DataFrame:
    """The rows that a build keeps: sources in order, first text of each hash wins, budgets by source and in all.

    sources (source, ord, target_bytes), a few rows of configuration; existing (source, bytes) was
    written by earlier runs and counts toward the budgets; store (h) has the hashes seen by then.
    A hash or a band blocks later rows only where its row was written, so that rows beyond a budget
    free theirs. Instead of one job for each source, all are cut at once against what the round
    before kept, until nothing changes: what a row meets depends on earlier rows alone, so each
    round settles some more, and two or three do unless near duplicates form long chains. Keys and
    sizes go through the rounds; texts join at the end.
    """
    every = pieces(docs, options)
    if not options.drop_blocklist:
        every = without(every, blocklist(bench, "text"))
    if store is not None:
        every = without(every, store)
    every = materialize(every.join(sources.select("source", "ord"), "source"), "build-pieces")
    order = ["doc_ord", "chunk_ix"]
    own = first_of_each(every.select("source", "ord", "h", *order, "nbytes").withColumn("_sh", F.concat_ws("|", "source", "h")), "_sh", *order).drop("_sh")
    own = ranged(own, "source", order, "build-own")
    place = F.struct("ord", *order)
    bands = materialize(band_rows(every.withColumn("id", place).select("id", "text"), "id", "text", 3, 21, True), "build-bands") if options.near_dup else None
    have = existing.select("source", F.col("bytes").alias("have")) if existing is not None else own.sparkSession.createDataFrame([], "source string, have long")
    limits = materialize(sources.join(have, "source", "left").select("source", "ord", "target_bytes", F.coalesce("have", F.lit(0)).alias("have")), "build-limits")
    state, kept = None, None
    while True:
        if kept is None:
            open_rows = first_of_each(own, "h", "ord", *order)
        else:
            first = kept.groupBy("h").agg(F.min(place).alias("_first"))
            open_rows = own.join(first, "h", "left").where(F.coalesce(place <= F.col("_first"), F.lit(True))).drop("_first")
            if bands is not None:
                held = bands.join(kept.select(place.alias("id")), "id", "left_semi").groupBy("band", "key").agg(F.min("id").alias("_first"))
                met = bands.join(held, ["band", "key"]).where(F.col("id") > F.col("_first")).select("id").distinct()
                open_rows = open_rows.withColumn("id", place).join(met, "id", "left_anti").select(*own.columns)
        before, kept = kept, materialize(within_budget(open_rows, allowed(limits, kept, options.total_bytes), order).select(*own.columns), "build-kept")
        discard(before)
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("source", *order).cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    built = materialize(every.join(kept.select("source", *order), ["source", *order], "left_semi"), "build-rows")
    discard(every, own, bands, limits, kept)
    return built


def allowed(limits: DataFrame, kept: DataFrame | None, total: int | None) -> DataFrame:
    """(source, target_bytes) that each source may still add: what its own target leaves, and of the total what the sources before it leave.

    limits (source, ord, target_bytes, have), a row for each configured source.
    """
    left = F.greatest(F.col("target_bytes") - F.col("have"), F.lit(0))
    if total is None:
        return limits.select("source", left.alias("target_bytes"))
    bytes_of = kept.groupBy("source").agg(F.sum("nbytes").alias("added")) if kept is not None else limits.select("source", F.lit(0).alias("added"))
    rows = limits.join(bytes_of, "source", "left").select("source", "ord", left.alias("left"), "have", F.coalesce("added", F.lit(0)).alias("added"))
    earlier = rows.select(F.col("ord").alias("_o"), F.col("added").alias("_a"), F.col("have").alias("_h"))
    used = rows.join(earlier, F.lit(True)).groupBy("source", "left").agg(F.sum("_h").alias("h"), F.sum(F.when(F.col("_o") < F.col("ord"), F.col("_a"))).alias("a"))  # a few rows by a few
    return used.select("source", F.least("left", F.greatest(F.lit(total) - F.col("h") - F.coalesce("a", F.lit(0)), F.lit(0))).alias("target_bytes"))


def build_summary(docs: DataFrame, built: DataFrame, sources: DataFrame, options: Build = Build(), existing: DataFrame | None = None) -> DataFrame:
    """(source, seen, kept, bytes, total_bytes) of a build: a source's documents are seen until its budget is full."""
    have = existing.select("source", F.col("bytes").alias("have")) if existing is not None else docs.sparkSession.createDataFrame([], "source string, have long")
    limits = sources.join(have, "source", "left").select("source", "ord", "target_bytes", F.coalesce("have", F.lit(0)).alias("have"))
    own = built.groupBy("source").agg(F.count("*").alias("kept"), F.sum("nbytes").alias("bytes"), F.max("doc_ord").alias("last"))
    own = allowed(limits, built, options.total_bytes).join(limits.select("source", "have"), "source").join(own, "source", "left")
    own = materialize(own.select("source", "have", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.when(F.col("target_bytes") <= 0, F.lit(-1)).when(F.coalesce("bytes", F.lit(0)) >= F.col("target_bytes"), F.col("last")).alias("upto"), (F.col("target_bytes") <= 0).alias("closed")), "build-summary")
    seen = docs.select("source", "doc_id").join(own.select("source", "upto", "closed"), "source").where(~F.col("closed") & F.coalesce(F.col("doc_id") <= F.col("upto"), F.lit(True))).groupBy("source").agg(F.count("*").alias("seen"))
    return own.join(seen, "source", "left").select("source", F.coalesce("seen", F.lit(0)).alias("seen"), "kept", "bytes", (F.col("have") + F.col("bytes")).alias("total_bytes"))


def quick_overlay(sources: list[dict], disabled: set[str], source_cap: int = 10_000_000, total_cap: int = 20_000_000) -> tuple[list[dict], int]:
    """A small trial's configuration: some sources off, targets capped, and the cap on the total."""
    out = [s | {"enabled": s.get("enabled", True) and s["name"] not in disabled, "target_bytes": min(s["target_bytes"], source_cap)} for s in sources]
    return out, total_cap


def enough(total_bytes: Column | str, target_bytes: int) -> Column:
    """Whether a corpus is large enough to go on with: a tenth of its target, and five million bytes."""
    return (F.col(total_bytes) if isinstance(total_bytes, str) else total_bytes) >= max(5_000_000, target_bytes // 10)
