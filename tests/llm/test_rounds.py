"""Packing by rounds on Spark: valid, in the rounds of the plain form, about as few sequences as best-fit decreasing."""

import math
import random
from collections import Counter

import pytest
from yardstick import plan_best_fit

pytest.importorskip("public_tokenizers")

from test_llm import swept  # noqa: E402

from textmill.llm import rounds  # noqa: E402


def check(rows, counts, capacity):
    """Every piece has one place, places are gapless, sequences are not overfull; returns the number of sequences."""
    ranks, places = {}, {}
    for r in rows:
        ranks.setdefault(r["length"], []).append((r["lo"], r["hi"]))
        for i in range(r["hi"] - r["lo"]):
            places.setdefault(r["first_sequence"] + i, []).append((r["offset"], r["length"]))
    assert set(ranks) == {k for k, n in counts.items() if n}
    for length, own in ranks.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(places) == set(range(len(places)))
    return len(places)


@pytest.mark.parametrize("counts,capacity", [({k: random.Random(k).randrange(1, 90) for k in range(9, 64, 9)}, 64), ({10: 7}, 10), ({1: 5, 100: 3}, 100), ({60: 4, 41: 9, 40: 9, 20: 30}, 100)])
def test_rounds(spark, counts, capacity):
    runs, n = rounds.plan(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity)
    sequences = check(runs.collect(), counts, capacity)
    plain, plain_rounds = swept(counts, capacity)
    assert (sequences, n) == (plain, plain_rounds)
    best = sum(hi - lo for _, lo, hi, _, offset in plan_best_fit(Counter(counts), capacity) if offset == 0)
    assert math.ceil(sum(k * v for k, v in counts.items()) / capacity) <= sequences <= 1 + 1.02 * best


def test_no_documents(spark):
    runs, n = rounds.plan(spark.createDataFrame([], "length long, n long"), 64)
    assert runs.count() == 0 and n == 1
