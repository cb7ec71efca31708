"""Bulk-synchronous best fit over runs of equal lengths.

Documents and gaps lie in one table of runs: (length, first rank, number) and (size, first
sequence, number). In each round both are sorted from large to small and swept: a gap is laid
down, a document takes the gap laid down last that is still free, which is the smallest one that is
large enough. Many documents come upon the same gaps; their rank decides: sums over the sorted runs
give every document and every gap its height in the stack of free gaps, and the two that meet
at one height are consecutive there. So the heights are dealt out, and each task matches its own by
looking at the row behind. Gaps then shrink by what they took, documents longer than every gap open
sequences, and the rest waits for the next round; each gap takes one document in each.

A run's number is all that grows with the input: there are at most `capacity` lengths and sizes,
however many documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import materialize

GAP, DOCUMENT, PLACED = 0, 1, 2
#: A gap run (size, its first sequence, number), a run of documents that wait (length, first rank,
#: number), or one that was placed in this round, with its first sequence and the place in each.
STATE = "kind int, size long, first long, n long, sequence long, offset long"



def begun(state: DataFrame, known: int, capacity: int) -> DataFrame:
    """STATE with new sequences for documents longer than every gap: the fewest that could hold all of these, the longest first.

    A table of runs is in one partition here, as sorting runs is no work worth a shuffle.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = state.coalesce(1).select("kind", "size", "first", "n").withColumn("top", F.coalesce(F.max(F.when(F.col("kind") == GAP, F.col("size"))).over(whole), F.lit(0)))
    rows = rows.withColumn("beyond", (F.col("kind") == DOCUMENT) & (F.col("size") > F.col("top")))
    total = lambda test, x: F.coalesce(F.sum(F.when(test, x)).over(whole), F.lit(0))
    need = F.greatest(total(F.col("beyond") & (2 * F.col("size") > capacity), F.col("n")), F.ceil(total(F.col("beyond"), F.col("size") * F.col("n")) / capacity))
    before = F.coalesce(F.sum(F.when(F.col("beyond"), F.col("n"))).over(Window.orderBy(F.desc("size"), "kind", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("need", need).withColumn("before", before).withColumn("own", F.when(F.col("beyond"), F.greatest(F.lit(0), F.least("n", F.col("need") - F.col("before")))).otherwise(F.lit(0)))
    null, new = F.lit(None).cast("long"), F.lit(known) + F.col("before")
    one = lambda kind, *of: F.struct(*[x.cast("long" if i else "int").alias(name) for i, (x, name) in enumerate(zip((kind, *of), ("kind", "size", "first", "n", "sequence", "offset"), strict=True))])
    own = F.col("own")
    each = F.array(one(F.col("kind"), F.col("size"), F.col("first") + own, F.col("n") - own, null, null), one(F.lit(PLACED), F.col("size"), F.col("first"), own, new, F.lit(0)), one(F.lit(GAP), F.lit(capacity) - F.col("size"), new, own, null, null))
    return materialize(rows.select(F.explode(each).alias("x")).select("x.*").where("n > 0 and size > 0"), "round-begun")


def heights(documents: DataFrame, gaps: DataFrame) -> DataFrame:
    """The runs of documents (size, first, n) and the sums of the gaps by size from large to small, each with the stack's height before and after it."""
    events = documents.withColumn("kind", F.lit(DOCUMENT)).unionByName(gaps.withColumn("kind", F.lit(GAP))).coalesce(1).groupBy("kind", "size").agg(F.max("first").alias("first"), F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("size"), "kind")  # two rows for each size at most
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("u", F.sum(F.when(F.col("kind") == GAP, F.col("n")).otherwise(-F.col("n"))).over(upto))
    # The height of the stack of free gaps: documents that find none take nothing away.
    events = events.withColumn("low", F.least(F.lit(0), F.min("u").over(upto))).withColumn("h", F.col("u") - F.col("low")).withColumn("was", F.coalesce(F.lag("h").over(order), F.lit(0))).withColumn("place", F.row_number().over(order))
    return events.select("kind", "size", "first", "n", "h", "was", "place")


def matched(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """(size, by, rank, sequence, n): runs of gaps of a size, with the length and first rank of the documents that take them, null if none does."""
    cuts = events.agg(F.array_sort(F.collect_set("h")).alias("cuts"))  # one row, a number for each event
    inside = F.filter("cuts", lambda c: (c > F.least("h", "was")) & (c <= F.greatest("h", "was")))
    cells = events.crossJoin(F.broadcast(cuts)).select("kind", "size", "first", "h", "was", "place", inside.alias("cuts")).select("*", F.posexplode("cuts").alias("i", "high"))
    cells = cells.withColumn("under", F.when(F.col("i") == 0, F.least("h", "was")).otherwise(F.get("cuts", F.col("i") - 1))).drop("cuts")
    # At one height gaps and documents take turns: who comes behind a gap has it.
    at = Window.partitionBy("high").orderBy("place")
    cells = cells.withColumn("by", F.lead("size").over(at)).withColumn("rank", F.lead(F.col("first") + F.col("was") - F.col("high")).over(at))
    free = cells.where(F.col("kind") == GAP).select("size", (F.col("under") - F.col("was")).alias("at"), (F.col("high") - F.col("under")).alias("wide"), "by", "rank")
    # The units of a size are its sequences in order.
    runs = gaps.withColumn("c", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = free.join(F.broadcast(runs.withColumnRenamed("size", "_size")), (F.col("size") == F.col("_size")) & (F.col("at") < F.col("c") + F.col("n")) & (F.col("c") < F.col("at") + F.col("wide")))
    start, end = F.greatest("at", "c"), F.least(F.col("at") + F.col("wide"), F.col("c") + F.col("n"))
    return met.select("size", "by", (F.col("rank") + start - F.col("at")).alias("rank"), (F.col("first") + start - F.col("c")).alias("sequence"), (end - start).alias("n"))


def swept(begun_: DataFrame, capacity: int) -> DataFrame:
    """STATE after a sweep: what was placed, the gaps, and the documents that wait."""
    runs = begun_.coalesce(1)
    documents, gaps = (runs.where(F.col("kind") == k).select("size", "first", "n") for k in (DOCUMENT, GAP))
    events = heights(documents, gaps)
    met = matched(events, gaps).withColumn("room", F.when(F.col("by").isNull(), F.col("size")).otherwise(F.col("size") - F.col("by")))
    null = F.lit(None).cast("long")
    one = lambda kind, *of: F.struct(*[(F.col(x) if isinstance(x, str) else x).cast("long" if i else "int").alias(name) for i, (x, name) in enumerate(zip((F.lit(kind), *of), ("kind", "size", "first", "n", "sequence", "offset"), strict=True))])
    out = met.select(F.explode(F.array(one(GAP, "room", "sequence", "n", null, null), one(PLACED, "by", "rank", "n", "sequence", F.lit(capacity) - F.col("size")))).alias("x")).select("x.*")
    took = F.greatest(F.lit(0), F.col("was") - F.col("h"))
    wait = events.where(F.col("kind") == DOCUMENT).select(F.explode(F.array(one(DOCUMENT, "size", F.col("first") + took, F.col("n") - took, null, null))).alias("x")).select("x.*")
    return materialize(out.unionByName(wait).where("n > 0 and size > 0").coalesce(4), "round-swept")


def plan(counts: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((length, lo, hi, first_sequence, offset) of runs of ranks, the number of rounds) for counts (length, n).

    The driver holds the number of sequences, and whether any document waits; each round's runs are written.
    """
    spark: SparkSession = counts.sparkSession
    state = materialize(counts.select(F.lit(DOCUMENT).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("offset")).where("n > 0"), "round-lengths")
    known, rounds, paths = 0, 0, []
    while True:
        now = begun(state.where(F.col("kind") != PLACED), known, capacity)
        paths.append(now._textmill_path)
        told = now.agg(F.count(F.when(F.col("kind") == DOCUMENT, 1)), F.max(F.when(F.col("kind") == PLACED, F.col("sequence") + F.col("n")))).first()
        known, rounds = max(known, told[1] or 0), rounds + 1
        if not told[0]:
            break
        state = swept(now, capacity)
        paths.append(state._textmill_path)
    placed = spark.read.schema(STATE).parquet(*paths).where(F.col("kind") == PLACED)
    return placed.select(F.col("size").alias("length"), F.col("first").alias("lo"), (F.col("first") + F.col("n")).alias("hi"), F.col("sequence").alias("first_sequence"), "offset"), rounds
