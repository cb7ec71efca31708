"""Alignment across spaces, resampling by blocks, staged builds, recent keys, functions for SQL and folder sizes."""

import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from textmill.functions import sql
from textmill.functions.text import strip
from textmill.operators import metrics, spaces, staged
from textmill.operators.budget import Build, build_corpus
from textmill.plans.shared import shared_path
from textmill.sources import readers
from textmill.streaming import recent


@pytest.fixture(scope="module")
def two_spaces(spark):
    r = np.random.default_rng(1)
    source = r.normal(size=(60, 9))
    target = source @ r.normal(size=(9, 5)) + 0.01 * r.normal(size=(60, 5))
    table = lambda m, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    gold = spark.createDataFrame([(100 + i, i) for i in range(30)] + [(999, 3), (101, 998)], "tgt_id long, src_id long")
    return source, target, table(source, 0), table(target, 100), gold


def test_bridge_is_the_product_of_relative_vectors(two_spaces):
    """Carried over, a target vector has the same inner products as the two relative vectors have."""
    source, target, s, t, gold = two_spaces
    pivots = spaces.shared_pivots(gold, t, s, 20, 7)
    rows = sorted(map(tuple, pivots.collect()))
    assert [r[0] for r in rows] == list(range(20)) and all(r[1] - 100 == r[2] for r in rows)  # those without a vector are left out
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    at = [r[2] for r in rows]
    want = (unit(target) @ unit(target)[at].T) @ (unit(source) @ unit(source)[at].T).T
    got = {r["id"]: r["vec"] for r in spaces.carried(t, spaces.bridge(pivots, t, s)).collect()}
    assert np.allclose(np.array([got[100 + i] for i in range(60)]) @ unit(source).T, want)
    rel = {r["id"]: r["rel"] for r in spaces.relative(s, pivots.join(s.withColumnRenamed("id", "src_id"), "src_id"), block=6, parts=2).collect()}  # four blocks of pivots
    assert np.allclose(np.array([rel[i] for i in range(60)]), unit(source) @ unit(source)[at].T)


def test_alignment_without_shared_pivots(two_spaces, spark):
    _, _, s, t, _ = two_spaces
    with pytest.raises(ValueError):
        spaces.bridge(spaces.shared_pivots(spark.createDataFrame([(999, 3)], "tgt_id long, src_id long"), t, s, 5), t, s)


def test_rows_drawn_anew(two_spaces):
    _, _, s, _, _ = two_spaces
    ids = s.select((F.col("id") % 7 + F.col("id") * 100).alias("id"))
    one = {r["id"]: r["vec"] for r in spaces.random_rows(ids, s, 3).collect()}
    two = {r["id"]: r["vec"] for r in spaces.random_rows(ids.repartition(5), s.repartition(3), 3).collect()}
    assert all(np.allclose(one[i], two[i]) for i in one) and len(one) == 60
    many = np.array([r["vec"] for r in spaces.random_rows(s.sparkSession.range(4000).select("id"), s, 3).collect()])
    own = np.array([r["vec"] for r in s.collect()])
    assert np.allclose(many.mean(0), own.mean(0), atol=0.1) and np.allclose(many.var(0), own.var(0), rtol=0.15)


def test_bootstrap_blocks_draws_n_a_sample():
    """A block's share found by itself is its share of one split of all, and shares sum to the number of draws."""
    upto = [0, 5, 5, 40, 41, 100]
    shares = np.array([metrics.share_of_block(i, upto, 200, 3) for i in range(5)])
    assert (shares.sum(0) == 100).all() and (shares[1] == 0).all() and abs(shares[4].mean() - 59) < 3


def test_bootstrap_blocks_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(3)), float(r.randrange(4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = metrics.bootstrap_blocks(df.repartition(4), "a", "b", 400, 5, per_block=60).first()
    assert tuple(got) == tuple(metrics.bootstrap_blocks(df.repartition(2), "a", "b", 400, 5, per_block=60).first())  # on any partitioning
    counts = Counter(b - a for _, a, b in rows)
    blocks = {x["d"]: x["block"] for x in spark.createDataFrame([(d,) for d in counts], "d double").select("d", F.pmod(F.xxhash64("d"), F.lit(9)).cast("int").alias("block")).collect()}
    names = sorted(set(blocks.values()))
    own = [sorted(d for d in counts if blocks[d] == n) for n in names]
    upto = [0, *np.cumsum([sum(counts[d] for d in x) for x in own]).tolist()]
    deltas = sum(metrics.draws_of_block(i, np.array(x), np.array([counts[d] for d in x]), metrics.share_of_block(i, upto, 400, 5), 5) for i, x in enumerate(own)) / 500
    s = np.sort(deltas)
    assert got["ci_low"] == pytest.approx(s[int(0.025 * 399)]) and got["ci_high"] == pytest.approx(s[int(0.975 * 399)])
    assert got["delta_mean"] == pytest.approx(sum(d * n for d, n in counts.items()) / 500)
    spread = np.std([b - a for _, a, b in rows]) / 500**0.5
    assert deltas.std() == pytest.approx(spread, rel=0.15)
    assert metrics.bootstrap_blocks(df.where("a is null"), "a", "b", 10).first()["p_value_two_sided"] == 1.0


def test_recent_keys_stay_bounded(spark):
    r, out = random.Random(3), shared_path(spark, "recent-test")
    rows = [(i, f"k{r.randrange(30)}", i * 1000 + r.randrange(500)) for i in range(900)]
    for part in range(3):
        spark.createDataFrame(rows[300 * part : 300 * part + 300], "id long, key string, ms long").select("id", "key", F.timestamp_millis("ms").alias("ts")).repartition(3).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema("id long, key string, ts timestamp").parquet(f"{out}/in")
        recent.first_recent(stream, "key", "ts", "id", 4, 60, shards=2).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    got = {x["id"]: (x["shard"], x["held"]) for x in spark.read.parquet(f"{out}/out").collect()}
    import hashlib

    want, state = {}, {0: [], 1: []}
    for i, key, ms in rows:
        shard = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 2
        own = [x for x in state[shard] if x[1] >= ms - 60_000]
        if key not in [k for k, _ in own]:
            own = [*own, (key, ms)][-4:]
            want[i] = (shard, len(own))
        state[shard] = own
    assert got == want and max(h for _, h in got.values()) <= 4


def test_a_build_stops_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = shared_path(spark, "staged-test")
    docs.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    sources = spark.createDataFrame([(f"src{i}", i, 3000) for i in range(3)], "source string, ord int, target_bytes long")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    keys = lambda df: sorted(map(tuple, df.select("source", "doc_ord", "chunk_ix", "h", "text").collect()))
    built, files, n = staged.build_staged(spark, path, bench, sources, Build())
    assert keys(built) == keys(build_corpus(docs, bench, sources, Build())) and 0 < len(files) < n


def test_functions_in_sql(spark):
    sql.register(spark)
    got = spark.sql("select norm_text(' a \\t b ') as a, word_count('x  y z') as b, extract_letter('the answer: c.') as c, size(text_terms('some termed a-b words')) as d, norm_text(null) as e").first()
    assert tuple(got) == ("a b", 3, "C", 3, "")
    rows = spark.sql("select chunk_ix, piece from (select repeat('0123456789', 25) as t) x, lateral text_chunks(x.t, 100) order by chunk_ix").collect()
    assert [(r["chunk_ix"], r["piece"][:1], len(r["piece"])) for r in rows] == [(0, "0", 100), (1, "0", 100), (2, "0", 70)]


def test_folder_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"1" * 70)
    (tmp_path / "a" / "y.bin").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"2" * 30)
    got = {r["name"]: (r["files"], r["bytes"], r["percent"]) for r in readers.folder_bytes(spark, str(tmp_path), target=200).collect()}
    assert got == {"a": (1, 70, 35.0), "b.txt": (1, 30, 15.0)}
    sizes = {name: os.path.getsize(f"{SF}/{name}") for name in os.listdir(SF) if os.path.isfile(f"{SF}/{name}")}
    assert {r["name"]: r["bytes"] for r in readers.folder_bytes(spark, SF).collect() if r["name"] in sizes} == sizes


def test_long_texts_take_linear_time(spark):
    began = time.time()
    text = "a" + " " * 200_000 + "b"
    assert spark.createDataFrame([(f" \t　{text} \n",)], "t string").select(strip("t").alias("t")).first()["t"] == text
    words = [f"w{i}" for i in range(200_000)]
    df = spark.createDataFrame([(words, words[::2] + ["x"] * 100_000)], "p array<string>, r array<string>")
    assert metrics.bleu_1(df, "p", "r").first()["bleu_1"] == pytest.approx(50.0)
    assert time.time() - began < 60
