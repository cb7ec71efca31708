"""A store of seen hashes that is looked up without being read whole.

Hashes lie in buckets by their first digits, as a file for each bucket and segment; a segment is what
one batch added. Beside each file goes a Bloom sketch of it in the store's index. A batch meets
the sketches of the buckets that it has hashes for, then the files whose sketch may hold one of
them, and no others. compact() makes one segment of all.

    <store>/index/segment=<n>   bucket, name, n, bytes, sketch
    <store>/hashes/<name>       h

A segment's index is written after its hashes and names them, so files that a lost run left behind
are never read. Writing a segment again replaces it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.plans.shared import delete, discard, exists, materialize

INDEX = "bucket int, name string, n long, sketch binary"
#: Bits of a sketch for each hash, and places each hash has in it: one of a hundred others is taken for held.
BITS, PLACES = 10, 7


@dataclass(frozen=True)
class Layout:
    """digits: hexadecimal digits that name a bucket; 2 make 256 buckets, 4 make 65,536, for about a million hashes in each."""

    digits: int = 2

    def bucket(self, h: Column | str = "h") -> Column:
        return F.conv(F.substring(h, 1, self.digits), 16, 10).cast("int")


def places(hashes: list[str], size: int) -> np.ndarray:
    """Where each hash, as hexadecimal digits, sets a bit among `size`: by two numbers from its last digits, as they spread evenly."""
    tail = np.array([int(h[-16:], 16) for h in hashes], np.uint64)
    first, second = tail >> np.uint64(32), (tail & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + second[:, None] * np.arange(PLACES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def sketch(hashes: list[str]) -> bytes:
    size = max(64, -(-len(hashes) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[places(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def held(hashes: list[str], sketches: list[bytes]) -> np.ndarray:
    """A row for each sketch: whether it may hold each hash."""
    out = np.zeros((len(sketches), len(hashes)), bool)
    for i, own in enumerate(sketches):
        bits = np.unpackbits(np.frombuffer(own, np.uint8)).astype(bool)
        out[i] = bits[places(hashes, len(bits))].all(1)
    return out


class SeenStore:
    """Exact membership of hashes (lower-case hexadecimal, 16 digits at least)."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout = Layout()) -> None:  # noqa: B008
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout
        #: Of the last lookup: files that were read, and hashes in them.
        self.last = (0, 0)

    def index(self, but: int | None = None) -> DataFrame:
        """The index's rows, without those of one segment."""
        if not exists(self.spark, f"{self.path}/index"):
            return self.spark.createDataFrame([], f"{INDEX}, segment long")
        rows = self.spark.read.schema(f"{INDEX}, segment long").parquet(f"{self.path}/index")
        return rows if but is None else rows.where(F.col("segment") != but)

    def lookup(self, keys: DataFrame, but: int | None = None, h: str = "h") -> DataFrame:
        """The distinct hashes of keys that the store holds, in segments other than `but`.

        Only the sketches of the keys' own buckets are unpacked, only files that may hold a key are
        read. The names of these come to the driver; they are as many as buckets and segments.
        """
        keys = materialize(keys.select(F.col(h).alias("h")).where(F.col("h").isNotNull()).distinct().withColumn("bucket", self.layout.bucket()), "store-keys")

        def probe(key, asked: pa.Table, known: pa.Table) -> pa.Table:
            hashes = asked["h"].to_pylist()
            hit = held(hashes, known["sketch"].to_pylist()) if hashes else np.zeros((0, 0), bool)
            names = [n for n, any_ in zip(known["name"].to_pylist(), hit.any(1), strict=False) if any_]
            maybe = [x for x, any_ in zip(hashes, hit.any(0), strict=False) if any_] if len(hit) else []
            return pa.table({"name": pa.array([*names, *[None] * len(maybe)], pa.string()), "h": pa.array([*[None] * len(names), *maybe], pa.string())})

        buckets = keys.select("bucket").distinct()
        known = self.index(but).join(buckets, "bucket", "left_semi").select("bucket", "name", "n", "sketch")
        found = materialize(keys.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(probe, "name string, h string"), "store-probes")
        discard(keys)
        names = [r["name"] for r in found.where("name is not null").collect()]
        files = [f"{self.path}/hashes/{n}" for n in sorted(names)]
        read = self.spark.read.schema("h string").parquet(*files) if files else self.spark.createDataFrame([], "h string")
        self.last = (len(files), read.count() if files else 0)
        maybe = found.where("h is not null").select("h")
        return maybe.join(read.distinct(), "h", "left_semi")

    def without(self, rows: DataFrame, h: str = "h", but: int | None = None) -> DataFrame:
        """The rows whose hash the store doesn't hold; those without a hash stay."""
        seen = materialize(self.lookup(rows, but, h), "store-seen")
        return rows.join(seen.withColumnRenamed("h", h), h, "left_anti").select(*rows.columns)

    def add(self, keys: DataFrame, segment: int, h: str = "h") -> None:
        """The keys as a segment, which replaces one of that number."""
        token = f"{segment}-{uuid.uuid4().hex[:12]}"
        own = keys.select(F.col(h).alias("h")).where(F.col("h").isNotNull()).distinct().withColumn("bucket", self.layout.bucket())
        own.repartition("bucket").sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(f"{self.path}/hashes/{token}")
        written = self.spark.read.schema("h string, bucket int").parquet(f"{self.path}/hashes/{token}")

        def of_bucket(key, rows):
            hashes = rows["h"].to_pylist()
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "name": [f"{token}/bucket={key[0].as_py()}"], "n": pa.array([len(hashes)], pa.int64()), "sketch": pa.array([sketch(hashes)], pa.binary())})

        written.groupBy("bucket").applyInArrow(of_bucket, INDEX).write.mode("overwrite").parquet(f"{self.path}/index/segment={segment}")

    def compact(self, before: int | None = None) -> None:
        """One segment, of a number that no batch has, of all segments, or of those before a batch's own; what it replaces is deleted once its index is there.

        A run that is lost in between leaves hashes that two segments have, which changes nothing.
        """
        index = self.index() if before is None else self.index().where(F.col("segment") < before)
        rows = index.select("name", "segment").collect()  # as many as buckets and segments
        if len({r["segment"] for r in rows}) < 2:
            return
        everything = self.spark.read.schema("h string").parquet(*[f"{self.path}/hashes/{r['name']}" for r in rows])
        self.add(everything, -1 - max(r["segment"] for r in rows))
        for segment in {r["segment"] for r in rows}:
            delete(self.spark, f"{self.path}/index/segment={segment}")
        for token in {r["name"].split("/")[0] for r in rows}:
            delete(self.spark, f"{self.path}/hashes/{token}")
