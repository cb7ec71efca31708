import pyarrow as pa
from pyspark.sql import functions as F

from textmill.functions import batches
from textmill.functions import text as T
from textmill.operators import tokens


def met(spark, column, texts, met_by):
    """The number of texts that the function met_by was given at once, at most."""
    got = texts.select(column.alias("x")).select(F.max(met_by("x")).alias("m")).first()["m"]
    return got


def test_a_worker_encodes_bounded_bytes_at_once(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("t"))  # 15 MB in one partition
    make = lambda: lambda own: [[len(own)] for _ in own]
    most = met(spark, tokens.ids_of("t", make), texts, lambda c: F.get(c, F.lit(0)))
    assert 1 <= most <= batches.STEP_BYTES // 5000 + 1


def test_steps_are_whole_and_bounded():
    column = pa.array(["a" * 700_000, None, "", "b" * 3_000_000, "c", "d" * 700_000] * 2)
    parts = list(batches.steps(column))
    assert pa.concat_arrays(parts).equals(column)
    assert all(len(p) == 1 or batches.sizes(p).sum() <= batches.STEP_BYTES for p in parts)
    lists = pa.array([[1] * 100_000, None, [], [2] * 200_000, [3]], pa.list_(pa.int64()))
    assert pa.concat_arrays(list(batches.steps(lists))).equals(lists) and len(list(batches.steps(lists))) > 1
    assert batches.by_steps(pa.array([], pa.string()), lambda x: pa.array([1] * len(x), pa.int32())).to_pylist() == []


def test_batches_are_bounded_by_the_column_functions(spark):
    spark.conf.unset(batches.SETTING)
    T.hash_3gram("t")
    assert spark.conf.get(batches.SETTING) == str(batches.BATCH_BYTES)
    spark.conf.set(batches.SETTING, "1m")
    T.hash_3gram("t")
    assert spark.conf.get(batches.SETTING) == "1m"
    spark.conf.unset(batches.SETTING)
