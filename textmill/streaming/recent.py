"""A cache of recent keys over a stream, bounded in number and in age."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "keys array<string>, times array<long>"


def first_recent(stream: DataFrame, key: str, ts: str, order: str, bound: int, ttl_seconds: float, shards: int = 8) -> DataFrame:
    """(order, key, shard, held): the rows whose key isn't among the recent ones, with the number of keys held then.

    Keys are dealt to shards by hash. A shard holds its last `bound` new keys, first in first out, and
    none that came over ttl_seconds before the row at hand; a key that comes again stays where it is.
    Rows of a micro-batch are taken in the order of ts and order, micro-batches as they come. The
    state of a shard is its keys and their times, never more than `bound`, and there are as many shards as
    are asked for; so the state doesn't grow with the stream. Null keys count as an empty one.
    """
    micros = int(ttl_seconds * 1_000_000)

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, times = map(list, state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["t", "o"], kind="stable")
        known, out, start = dict(zip(keys, times, strict=True)), [], 0
        for o, k, t in zip(rows["o"], rows["k"], rows["t"], strict=True):
            while start < len(keys) and times[start] < t - micros:
                del known[keys[start]]
                start += 1
            if k in known:
                continue
            if len(keys) - start == bound:
                del known[keys[start]]
                start += 1
            keys.append(k)
            times.append(int(t))
            known[k] = int(t)
            out.append((o, k, name[0], len(keys) - start))
        state.update((keys[start:], times[start:]))
        yield pd.DataFrame(out, columns=["o", "k", "shard", "held"])

    kind = stream.schema[order].dataType.simpleString()
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = stream.select(F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("long").alias("x"), own.alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o")).withColumn("shard", F.col("x") % F.lit(shards))
    made = rows.groupBy("shard").applyInPandasWithState(run, f"o {kind}, k string, shard long, held int", STATE, "append", GroupStateTimeout.NoTimeout)
    return made.select(F.col("o").alias(order), F.col("k").alias(key), "shard", "held")
