"""What no single task may write or read whole, and what is shuffled no more often than needed."""

import numpy as np

from textmill.operators import align, terms
from textmill.plans import queries, queries_files
from textmill.plans.catalog import QUERIES


def test_terms_are_written_by_many_tasks_in_order(spark, tmp_path, monkeypatch):
    spark.range(0, 5000, 1, 4).selectExpr("(id * 7919) % 5000 as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(queries_files, "shared_path", lambda *_: str(tmp_path / "terms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r["term"] for r in QUERIES["term_list_scan"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [f"term{i}" for i in range(2048)]
    assert len(list((tmp_path / "terms").glob("part-*"))) > 1


def test_a_streamed_batch_may_be_many_files(spark, tmp_path, monkeypatch):
    spark.range(0, 60, 1, 3).selectExpr("id as doc_id", "concat('text number ', id % 40) as text").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "shared_path", lambda *_: str(tmp_path / "stream"))
    got = sorted(r["doc_id"] for r in QUERIES["stream_dedup"](spark, str(tmp_path)).collect())
    # Of two equal texts (40 apart, so in one batch) the smaller id comes first.
    assert got == list(range(40))
    assert len(list((tmp_path / "stream" / "in").glob("part-*"))) > 5
    assert len(list((tmp_path / "stream" / "rows").glob("batch=*"))) == 5


def test_pairs_are_counted_once_for_a_factorisation(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("a", "a", 3.0), ("c", "d", 0.0)], "a string, b string, weight double")
    made = terms.embed_counts(pairs.mapInArrow(count, "a string, b string, weight double"), size=4, rounds=2)
    assert sorted(r["token"] for r in made.collect()) == ["a", "b", "c"] and all(len(r["vec"]) == 4 for r in made.collect())
    assert counted.value == 4


def test_words_are_trained_by_as_many_tasks_as_can_run(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    seen = []
    fit = Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, rows: seen.append(self.getNumPartitions()) or fit(self, rows))
    lines = spark.createDataFrame([(["x", "y", "z"] * 5,)] * 8, "tokens array<string>")
    assert sorted(r["token"] for r in terms.train_vectors(lines, size=4, epochs=1).collect()) == ["x", "y", "z"]
    assert seen == [spark.sparkContext.defaultParallelism]


def test_blocks_of_vectors_grow_with_the_table(spark):
    # Copies of a vector that are shuffled: one for each block of the other side.
    assert align.n_blocks(615_384, align.BLOCK) + align.n_blocks(615_384, align.QUERIES) <= 40
    assert align.n_blocks(10_000, align.BLOCK) > 1 and align.n_blocks(0, align.BLOCK) == 1
    rows = np.random.default_rng(5).integers(-2, 3, (60, 4))  # with ties
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rows.astype(float).tolist())], "id long, vec array<double>")
    sims = rows @ rows.T
    want = {i: sorted(range(60), key=lambda j: (-sims[i, j], j))[:2] for i in range(60)}
    for block in (60, 7):
        assert {r["id"]: [r["best_id"], r["second_id"]] for r in align.top2(vectors, vectors, block).collect()} == want
