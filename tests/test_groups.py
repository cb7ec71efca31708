"""Groups of near duplicates: what is compared, and what comes out."""

import itertools
import random

from textmill.operators import dedup


def test_only_pairs_that_could_suffice_are_compared(spark, monkeypatch):
    r = random.Random(3)
    fillers = [f"filler{i}" for i in range(24)]
    sets = {i: {f"own{i}x{j}" for j in range(3)} | ({"shared"} if i < 30 else {f"own{i}y"}) | set(r.sample(fillers, 16)) for i in range(80)}
    for i in range(12):  # of these, some are 80 % similar
        sets[100 + i] = {f"base{j}" for j in range(20)} - {f"base{r.randrange(20)}" for _ in range(3)} | {f"new{i % 4}"}
    compared, jaccard = [], dedup.jaccard
    monkeypatch.setattr(dedup, "jaccard", lambda pairs, *rest: compared.append(pairs.count()) or jaccard(pairs, *rest))
    rows = [(i, " ".join(r.sample(sorted(s), len(s)))) for i, s in sets.items()]
    got = {x["doc_id"]: x["group_id"] for x in dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(got.values())) < len(sets)
    assert compared[1] < 80  # 435 pairs and more have the shared word among their rarest
