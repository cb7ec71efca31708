"""The seen store: exact, safe to repeat, and read in part."""

import hashlib
import random

import pytest

from textmill.operators import store as S
from textmill.operators.store import Layout, SeenStore
from textmill.plans.shared import shared_path


def sha(x):
    return hashlib.sha1(str(x).encode()).hexdigest()


def table(spark, values):
    return spark.createDataFrame([(sha(v),) for v in values], "h string")


def test_sketch_has_no_false_negative():
    own = [sha(i) for i in range(2000)]
    bits = S.sketch(own)
    assert S.held(own, [bits]).all()
    wrong = S.held([sha(-i - 1) for i in range(5000)], [bits]).mean()
    assert wrong < 0.03 and len(bits) <= 2000 * S.BITS / 8 + 8
    assert not S.held(own, [S.sketch([])]).any()


def test_exact_over_random_batches(spark):
    r = random.Random(5)
    store, seen = SeenStore(spark, shared_path(spark, "store"), Layout(1)), set()
    for batch in range(5):
        values = {r.randrange(400) for _ in range(120)}
        rows = table(spark, values)
        new = {x["h"] for x in store.without(rows, but=batch).collect()}
        assert new == {sha(v) for v in values} - seen
        store.add(rows, batch)
        if batch == 2:
            store.add(rows, batch)  # again
        if batch == 3:
            store.compact(before=3)
            assert {x["segment"] for x in store.index().select("segment").distinct().collect()} == {-3, 3}
        seen |= {sha(v) for v in values}
    store.compact()
    assert {x["h"] for x in store.lookup(table(spark, range(500))).collect()} == seen & {sha(v) for v in range(500)}
    assert [x["h"] for x in store.without(spark.createDataFrame([(None,), (next(iter(seen)),)], "h string")).collect()] == [None]


@pytest.mark.parametrize("compacted", [False, True])
def test_a_batch_reads_what_it_may_hold_and_no_more(spark, compacted):
    """New hashes read nothing to speak of, known ones their own files, however many batches there were before."""
    store = SeenStore(spark, shared_path(spark, "store"), Layout(2))
    read = []
    for batch in range(6):
        rows = table(spark, [f"{batch}-{i}" for i in range(300)])
        assert store.without(rows, but=batch).count() == 300
        read.append(store.last[0])
        store.add(rows, batch)
        if compacted:
            store.compact(before=batch)
    assert max(read) <= 30  # of up to 1300 files: one in a hundred hashes is taken for held
    known = store.lookup(table(spark, ["0-1", "0-2", "3-3"]))
    assert known.count() == 3 and store.last[0] <= 6 and store.last[1] <= 60


def test_an_empty_store_and_an_empty_batch(spark):
    store = SeenStore(spark, shared_path(spark, "store"))
    assert store.without(table(spark, [1, 2])).count() == 2
    store.add(spark.createDataFrame([], "h string"), 0)
    store.compact()
    assert store.lookup(table(spark, [1])).count() == 0
    store.add(table(spark, [1]), 1)
    assert store.lookup(spark.createDataFrame([], "h string")).count() == 0
