"""Structured Streaming forms: events by window, and deduplication against a store that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.operators.budget import Build, pieces
from textmill.operators.dedup import first_of_each, hashed
from textmill.operators.store import Layout, SeenStore


def event_stream(spark: SparkSession, path: str, schema: str, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """JSON events as they come, with a watermark."""
    return spark.readStream.schema(schema).json(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_totals(events: DataFrame, ts: str = "ts", width: str = "15 seconds", value: str = "bytes") -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def dedup_recent(stream: DataFrame, key: str) -> DataFrame:
    """The first event of each key within the watermark; the state is bounded by it, as a store's cache of recent keys is."""
    return stream.dropDuplicatesWithinWatermark([key])


def dedup_into(stream: DataFrame, store: str, out: str, checkpoint: str, order: str, text: str = "text", layout: Layout = Layout(), compact_every: int = 0) -> StreamingQuery:  # noqa: B008
    """Appends to `out` each batch's rows whose text hash the store lacks, and then to the store their hashes.

    A batch that is repeated after a failure first takes back what it had written under its
    number, so rows are neither lost nor doubled. A batch reads the sketches of its own buckets and the files that
    may hold one of its hashes, not the store. Every compact_every-th batch compacts the segments before its own,
    which can still be taken back.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = SeenStore(spark, store, layout)
        seen.without(first_of_each(hashed(batch, text), "h", order), but=number).write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.add(spark.read.parquet(f"{out}/batch={number}"), number)
        if compact_every and number % compact_every == compact_every - 1:
            seen.compact(before=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_events(events: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Appends events as JSON lines; a stream goes on where its checkpoint ended."""
    if not events.isStreaming:
        events.write.mode("append").json(path)
        return None
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumable_pieces(stream: DataFrame, options: Build, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the pieces of documents as their files come; a run that is started again takes only new files."""
    return pieces(stream, options).select("source", "doc_ord", "chunk_ix", "text", "h", "nbytes").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
