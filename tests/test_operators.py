import math

import pytest
from pyspark.sql import functions as F

from textmill.operators import align, budget, dedup, events, metrics, preflight, terms, tokens
from textmill.sources import readers, sinks
from textmill.streaming import incremental


def test_budget_overshoots_by_one_row(spark):
    rows = spark.createDataFrame([("a", i, 40) for i in range(3)] + [("b", 9, 5)], "source string, doc_id long, nbytes long")
    targets = spark.createDataFrame([("a", 50), ("b", 0)], "source string, target_bytes long")
    kept = budget.within_budget(rows, targets, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r["source"], r["doc_id"], r["before"]) for r in kept] == [("a", 0, 0), ("a", 1, 40)]
    have = spark.createDataFrame([("a", 45)], "source string, bytes long")
    assert budget.within_budget(rows, targets, ["doc_id"], have).count() == 1


def test_global_targets():
    assert budget.effective_targets([("a", 50), ("b", 50), ("c", 50)], {}, {"a": 80, "b": 20, "c": 50}, 100) == [("a", 50), ("b", 50), ("c", 30)]
    assert budget.effective_targets([("a", 50)], {"a": 60}, {}, 100) == [("a", 0)]


def test_rows_beyond_a_budget_free_their_hash(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(0, "first text of source a that fills it up", "a"), (1, text, "a"), (2, text, "b"), (3, text, "b")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([("nothing",)], "text string")
    sources = lambda a: spark.createDataFrame([("a", 0, a), ("b", 1, 1000)], "source string, ord int, target_bytes long")
    options = budget.Build(least_chars=5)
    kept = lambda a: sorted(r["doc_ord"] for r in budget.build_corpus(docs, bench, sources(a), options).collect())
    assert kept(10) == [0, 2]
    assert kept(1000) == [0, 1]
    block = spark.createDataFrame([(text,)], "text string")
    got = lambda o: budget.build_corpus(docs, block, sources(1000), o).count()
    assert got(options) == 1 and got(budget.Build(least_chars=5, drop_blocklist=True)) == 2


def plain_build(rows, sources, options, have, block, bands):
    """One row after another, as a build without Spark would."""
    from textmill.functions.text import hash_of

    seen, near, kept, counts = set(block), set(), [], {}
    left = None if options.total_bytes is None else options.total_bytes - sum(have.values())
    for name, target in sources:
        room, own, n = max(0, target - have.get(name, 0)), 0, 0
        room = room if left is None else min(room, max(0, left))
        for i, text, source in rows:
            if source != name or own >= room:
                continue
            n += 1
            if len(text) < options.least_chars or hash_of(text) in seen or (options.near_dup and near & bands[i]):
                continue
            seen.add(hash_of(text))
            near |= bands[i]
            own += len(f'{{"text": "{text}", "source": "{name}"}}')
            kept.append(i)
        counts[name] = (n, own)
        left = None if left is None else left - own
    return kept, counts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("options", [budget.Build(least_chars=12), budget.Build(least_chars=12, near_dup=True, total_bytes=2600), budget.Build(least_chars=1, near_dup=True)])
def test_build_is_as_one_row_after_another(spark, seed, options):
    import random

    from textmill.functions.text import hash_of

    r = random.Random(seed)
    texts = [" ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(r.randrange(1, 9))) for _ in range(25)]
    rows = [(i, r.choice(texts), r.choice("abc")) for i in range(120)]
    sources, have = [("b", 900), ("a", 1500), ("c", 700)], {"a": 300, "c": 50}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bands = {i: set() for i, _, _ in rows}
    for x in dedup.band_rows(docs, "doc_id", "text", 3, 21, True).collect():
        bands[x["doc_id"]].add((x["band"], x["key"]))
    table = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(sources)], "source string, ord int, target_bytes long")
    existing = spark.createDataFrame(list(have.items()), "source string, bytes long")
    bench, store = spark.createDataFrame([(texts[0],)], "text string"), spark.createDataFrame([(hash_of(texts[1]),)], "h string")
    built = budget.build_corpus(docs, bench, table, options, existing, store)
    kept, counts = plain_build(rows, sources, options, have, {hash_of(texts[0]), hash_of(texts[1])}, bands)
    assert sorted(x["doc_ord"] for x in built.collect()) == sorted(kept)
    got = {x["source"]: (x["seen"], x["bytes"], x["total_bytes"]) for x in budget.build_summary(docs, built, table, options, existing).collect()}
    assert got == {s: (n, b, b + have.get(s, 0)) for s, (n, b) in counts.items()}


def test_running_sums_of_uneven_groups(spark):
    import random

    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", r.randrange(10**12), i, r.randrange(100)) for i in range(3000)] + [(None, 5, 1, 2), (None, 4, 2, 3)]
    df = spark.createDataFrame(rows, "g string, a long, b long, v long").repartition(7)
    want, sums = {}, {}
    for g, a, b, v in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        want[g, a, b] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert {(x["g"], x["a"], x["b"]): x["s"] for x in budget.running_before(df, "g", ["a", "b"], "v", "s").collect()} == want


def test_nearest_rank_of_many_values(spark):
    import random

    r = random.Random(2)
    rows = [(f"g{i % 3}", r.choice([r.random(), 0.5, None])) for i in range(2000)]
    got = {x["g"]: (x["p0"], x["p50"], x["p90"], x["p100"]) for x in metrics.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    for g in ("g0", "g1", "g2"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(own[round(p * (len(own) - 1))] for p in (0.0, 0.5, 0.9, 1.0))


def test_dedup_keeps_the_first(spark):
    docs = spark.createDataFrame([(3, "x y z"), (1, "X, y z"), (2, "other"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dedup.exact_dedup(docs, ["doc_id"]).collect()) == [1, 2, 4]
    assert dedup.exact_dedup(docs.limit(0), ["doc_id"]).count() == 0


def test_near_groups_link_rows_behind_an_unrelated_first(spark):
    import random

    # Near copies whose buckets mostly begin with an unrelated row.
    r = random.Random(5)
    rows = [(0, "common words alone"), (1, "common"), (2, "words")]
    for i in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(12)] + ["common", "words"]
        for j in range(r.randrange(1, 5)):
            text = list(base)
            for _ in range(r.randrange(3)):
                text[r.randrange(12)] = f"w{r.randrange(60)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), rows[7][1]), (len(rows) + 1, ""), (len(rows) + 2, None)]
    sets = {i: set(t.split()) for i, t in rows if t}
    label = {i: i for i in sets}
    links = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in dedup.near_groups(docs).collect()}
    assert got == label
    pairs = {(r["first"], r["other"]) for r in dedup.near_candidates(docs).collect()}
    assert any((a, b) not in pairs for a, b in links)


def test_greedy_near_dedup_compares_with_kept_rows(spark):
    docs = spark.createDataFrame([(0, "a b c d"), (1, "a b c d"), (2, "q r s t"), (3, ""), (4, "d c b a")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dedup.greedy_near_dedup(docs).collect()) == [0, 2, 3]


def test_metrics(spark):
    rows = spark.createDataFrame([("x", "A", "a"), ("x", "b", "B"), ("x", "C", ""), ("y", "A", None)], "d string, pred string, label string")
    assert {r["d"]: r["accuracy"] for r in metrics.accuracy(rows, "d").collect()} == {"x": 1.0, "y": 0.0}
    assert rows.select(F.sum(metrics.correct_sample(F.col("pred"), F.col("label")))).first()[0] == 0
    spans = spark.createDataFrame([([], []), (["x"], ["X", "y"])], "pred array<string>, gold array<string>")
    s = metrics.span_scores(spans).first()
    assert (s["micro_p"], s["micro_r"], round(s["micro_f1"], 9), round(s["macro_f1"], 9)) == (1.0, 0.5, round(2 / 3, 9), round(5 / 6, 9))
    nll = spark.createDataFrame([(0.0,), (float("nan"),), (None,)], "x double")
    assert nll.agg(metrics.perplexity("x")).first()[0] == 1.0
    assert nll.limit(0).agg(metrics.perplexity("x")).first()[0] == math.inf
    two = spark.createDataFrame([("g", 1), ("g", 2)], "g string, v int")
    assert metrics.nearest_rank(two, "g", "v", {"p": 0.5}).first()["p"] == 1


def test_bootstrap(spark):
    equal = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "i int, a int, b int")
    assert tuple(metrics.bootstrap(equal, "a", "b", "i", 50).first()) == (0.0, 0.0, 0.0, 1.0)
    none = metrics.bootstrap(equal.limit(0), "a", "b", "i", 50).first()
    assert math.isnan(none[0]) and none[3] == 1.0
    long = spark.createDataFrame([("d", 0, 1.0), ("d", 1, 0.0), ("e", 0, 1.0)], "dataset string, idx int, score double")
    assert metrics.paired(long, long.where("dataset = 'd' or idx = 5")).count() == 2


def test_variants(spark):
    inf = float("-inf")
    rows = spark.createDataFrame([(0, "B", -1.0), (0, "A", -1.0), (0, "A", -3.0), (1, "A", inf)], "row int, letter string, ll double")
    assert {r["row"]: r["choice"] for r in metrics.best_variant(rows).collect()} == {0: "A", 1: ""}


def test_alignment(spark):
    gold = align.normalize_gold(spark.createDataFrame([(" 3 ", "5"), ("4", "x")], "key string, value string"))
    assert [tuple(r) for r in gold.collect()] == [(3, 5)]
    ids = spark.createDataFrame([(3,), (4,), (7,)], "id int")
    target = spark.createDataFrame([(7, [1.0, 0.0])], "id int, vec array<double>")
    source = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.5, 0.5]), (2, [0.9, 0.1])], "id int, vec array<double>")
    got = {r["tgt_id"]: r for r in align.align(ids, gold, target, source, 3, unknown=0).collect()}
    assert (got[3]["src_id"], got[3]["method"]) == (5, "gold")
    assert got[4]["method"] == "random" and 0 <= got[4]["src_id"] < 3
    assert (got[7]["src_id"], got[7]["method"], got[7]["margin"]) == (2, "query", 0.0)
    blocks = align.top2(target, source, block=1).first()
    assert (blocks["best_id"], blocks["second_id"]) == (0, 2)


def test_scores_read_whole_texts(spark, tmp_path):
    from textmill.plans.catalog import QUERIES

    same, other = "a bb " * 300 + "Alpha Omega abcdefgh ", "a bb " * 300 + "Gamma Delta qrstuvwx "
    spark.createDataFrame([(0, same * 2), (1, same + other)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = QUERIES["ner_span_f1"](spark, str(tmp_path)).first()
    import re

    from textmill.functions import text as T

    sets = [({x.lower() for x in re.findall(T.ENTITY, a)}, {x.lower() for x in re.findall(T.ENTITY, b)}) for a, b in ((same, same), (same, other))]
    tp, n = sum(len(a & b) for a, b in sets), sum(len(a) for a, _ in sets)
    assert (whole["micro_p"], whole["micro_r"]) == (round(tp / n, 9), round(tp / sum(len(b) for _, b in sets), 9)) and 0 < tp < n
    s = QUERIES["term_prf"](spark, str(tmp_path)).first()
    assert 0 < s["precision"] < 1 and 0 < s["recall"] < 1


def test_cascade_query_has_all_tiers(spark):
    import numpy as np
    from conftest import SF

    from textmill.plans.catalog import QUERIES

    got = {r["tgt_id"]: r for r in QUERIES["align_cascade"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    pages = [r["page_id"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert len(got) == len(rows) + len(pages) and all(got[-1 - i]["method"] == "random" and 0 <= got[-1 - i]["src_id"] < len(rows) for i in pages)
    ids, m = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    for r, sims in zip(rows, np.round(m @ m.T, 9), strict=True):
        own = got[r["vec_id"]]
        if r["label"] != 0:
            assert (own["src_id"], own["method"]) == (r["label"], "gold")
        else:
            a, b = np.argsort(-sims, kind="stable")[:2]
            assert (own["src_id"], own["method"]) == (ids[b] if ids[a] == 0 else ids[a], "query") and abs(own["margin"] - (sims[a] - sims[b])) < 1e-6
    assert {r["method"] for r in got.values()} == {"gold", "query", "random"}


def test_gold_and_model_types(spark):
    gold = align.normalize_gold(spark.createDataFrame([("3", "5", 0), (" 3", "7", 1), ("3", "x", 2)], "key string, value string, o int"), "o")
    assert [tuple(r) for r in gold.collect()] == [(3, 7)]
    assert "mistral" in align.EMBEDDING_ROWS and set(align.EMBEDDING_ROWS) == set(align.HEAD_ROWS)
    with pytest.raises(ValueError):
        align.remap(spark.createDataFrame([], "tensor string, row_id long, vec array<double>"), spark.createDataFrame([], "tgt_id long, src_id long"), "unknown")
    wide = spark.createDataFrame([("tok " + "0.5 " * 1_200_000,)], "value string").select(F.trim("value").alias("value"))
    assert align.parse_vectors(wide).select(F.size("vec")).first()[0] == 1_200_000


def test_bleu_and_rouge(spark):
    rows = spark.createDataFrame([("The cat sat, on the mat.", "The cat sat on the mat!"), ("one", "two words")], "p string, r string")
    tokens_of = lambda t: [x["x"] for x in spark.createDataFrame([(t,)], "t string").select(metrics.tokens_13a("t").alias("x")).collect()][0]
    assert tokens_of("It's 3.5, 1,000-a (b) &amp; c.") == ["It's", "3.5", ",", "1,000", "-", "a", "(", "b", ")", "&", "c", "."]
    # Eight tokens against seven: 6, 4 and 2 n-grams are shared, of four words none.
    got = metrics.bleu(rows.limit(1), "p", "r").first()["bleu"]
    want = 100 * math.exp(sum(map(math.log, [6 / 8, 4 / 7, 2 / 6, 1 / (2 * 5)])) / 4)
    assert abs(got - want) < 1e-9
    short = spark.createDataFrame([("a b c d e", "a x b y c")], "p string, r string")
    assert abs(metrics.bleu(short, "p", "r").first()["bleu"] - 100 * math.exp(sum(map(math.log, [3 / 5, 1 / 8, 1 / 12, 1 / 16])) / 4)) < 1e-9
    assert metrics.bleu(rows.limit(0), "p", "r").first()["bleu"] == 0.0
    stems = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi relational:relat digitizer:digit operator:oper hopeful:hope adjustment:adjust adoption:adopt rate:rate controlling:control sky:sky"
    assert {a: metrics.stem(a) for a, _ in (x.split(":") for x in stems.split())} == dict(x.split(":") for x in stems.split())
    assert metrics.common_length("a b c d e".split(), "b x d a e".split()) == 3 and metrics.common_length([], ["a"]) == 0
    assert metrics.rouge_l(spark.createDataFrame([("The cats running", "the cat runs")], "p string, r string"), "p", "r").first()["rouge_l"] == 1.0


def test_terms(spark):
    docs = spark.createDataFrame([(0, "abcdefgh abcdefgh zz wxyz"), (1, "abcdefgh qrstuvwxy")], "doc_id long, text string")
    top = terms.select_terms(docs, 5, mode="frequency").collect()
    assert [r["term"] for r in top] == ["abcdefgh", "qrstuvwxy"] and all(r["score"] == 0 for r in top)
    best = terms.select_terms(docs, 5).collect()
    assert best[0]["term"] == "qrstuvwxy"
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    added = spark.createDataFrame([("b", 0), ("c", 1)], "term string, rank int")
    assert sorted((r["token"], r["id"]) for r in terms.extend_vocabulary(vocabulary, added).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_tokens(spark):
    make = lambda: lambda texts: [list(range(len(t))) for t in texts]
    docs = spark.createDataFrame([(0, "ab cd"), (1, None), (2, "x" * 20)], "doc_id long, text string")
    assert [len(r["x"]) for r in docs.select("doc_id", tokens.ids_of("text", make, 10).alias("x")).orderBy("doc_id").collect()] == [5, 0, 10]
    lines = tokens.id_corpus(docs, make, "doc_id", 10**6, least=5)
    assert lines.count() == 2 and tokens.line_stats(lines, "doc_id", least=1).first()["lines"] == 2
    assert tokens.generate(docs.select(F.col("text").alias("prompt")), lambda: lambda texts: [t.upper() for t in texts]).where("raw = 'AB CD'").count() == 1
    losses = spark.createDataFrame([(0, [1.0, 3.0, 9.0], [1, 1, 0])], "row int, nll array<double>, mask array<int>")
    assert tokens.mean_nll(losses, "row").first()["mean_nll"] == 2.0


def test_benchmarks_are_staged_and_found(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q")], "id long, question string")

    def fetch(candidate, split):
        if candidate != "tner/bc5cdr":
            raise LookupError(candidate)
        return rows

    folder = f"file://{tmp_path}"
    report = readers.stage_benchmarks(spark, fetch, folder, {k: readers.BENCHMARKS[k] for k in ("bc5cdr", "mmlu")})
    assert {(r["name"], r["split"]): (r["candidate"], r["rows"]) for r in report.collect()} == {("bc5cdr", s): ("tner/bc5cdr", 1) for s in ("train", "validation", "test")} | {("mmlu", "test"): (None, 0)}
    assert readers.benchmark(spark, folder, "bc5cdr", "test", "id long, question string").collect() == rows.collect()
    assert readers.benchmark(spark, folder + "/none", "bc5cdr", "test", "id long", fetch).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.benchmark(spark, folder, "mmlu", "test", "id long", fetch)
    with pytest.raises(LookupError):
        readers.stage_benchmarks(spark, fetch, folder, {"mmlu": readers.BENCHMARKS["mmlu"]}, ("mmlu",))
    assert readers.config('{"a": 1}') == {"a": 1}


def test_tables_are_discarded(spark):
    from textmill.plans import shared

    kept, gone = (shared.materialize(spark.range(3), "t") for _ in range(2))
    shared.discard(gone, None)
    assert kept.count() == 3 and not shared.exists(spark, gone._textmill_path) and shared.exists(spark, kept._textmill_path)


def test_event_times(spark):
    rows = spark.createDataFrame([("2025-11-07T08:52:08Z",), ("20251107T085208Z",), ("x",)], "t string")
    got = [r["x"] for r in rows.select(events.event_time("t").alias("x")).collect()]
    assert got[0] == got[1] and got[0] is not None and got[2] is None


def test_preflight(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("hello",), ("world",)], "text string").coalesce(1).write.parquet(path)
    ok = preflight.check_parquet(spark, "s", [path], ["text", "none"])
    assert ok[2] and ok[4] == ["text"]
    name = next(p.name for p in (tmp_path / "p").iterdir() if p.name.endswith(".parquet"))
    assert not preflight.check_parquet(spark, "s", [path], ["text"], {name: "deadbeef"})[2]
    assert not preflight.check_parquet(spark, "s", [path], ["body"])[2]
    report = preflight.check_sources(spark, [{"name": "s", "paths": [path], "text_fields": ["text"]}, {"name": "t", "paths": [path + "x"], "text_fields": []}])
    assert not preflight.overall(report).first()["ok"] and preflight.overall(report, strict=False).first()["ok"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\nbroken\n{"text": "y"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "text string").where("text is not null").count() == 2
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "text string").count() == 0
    (tmp_path / "lines.txt").write_text("  a \n\n b\n")
    assert [r["text"] for r in readers.http_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b"]
    assert [r["term"] for r in readers.term_list(spark, str(tmp_path / "lines.txt"), 1).collect()] == ["a"]
    vectors = spark.createDataFrame([("tok", [1.0, 2.5])], "token string, vec array<float>")
    sinks.vector_lines(vectors, str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v")).collect() == vectors.collect()
    rows = spark.createDataFrame([("t", "s", 7)], "text string, source string, nbytes long")
    sinks.corpus_lines(rows, str(tmp_path / "c"))
    sinks.corpus_lines(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    sinks.corpus_summary(spark.createDataFrame([("s", 3, 1, 7, 17)], "source string, seen long, kept long, bytes long, total_bytes long"), str(tmp_path / "s"), 5)
    got = spark.read.json(str(tmp_path / "s")).first()
    assert (got["added_bytes"], got["total_bytes"], got["complete"]) == (7, 17, True)
    fields = spark.createDataFrame([(1, "q", ["c", "d"])], "i int, question string, context array<string>")
    assert [r["text"] for r in readers.every_field(fields, ["text", "context", "question"], "i").collect()] == ["c\nd", "q"]


def test_stream_dedup_is_repeatable(spark, tmp_path):
    schema = "doc_id long, text string"
    source = tmp_path / "in"
    spark.createDataFrame([(0, "a b c"), (1, "A b, c"), (2, "d")], schema).write.json(str(source))
    run = lambda: incremental.dedup_into(spark.readStream.schema(schema).json(str(source)), *(str(tmp_path / x) for x in ("store", "out", "state")), "doc_id").awaitTermination()
    run()
    spark.createDataFrame([(3, "a b c"), (4, "e")], schema).write.mode("append").json(str(source))
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]


def test_minhash_takes_no_lambda_for_each_permutation(spark):
    sets = spark.createDataFrame([(1, [7, 3, dedup.PRIME - 1]), (2, []), (3, [5]), (4, [3, 3])], "id long, v array<long>")
    moves = dedup.permutations(63)
    made = sets.select("id", "v", dedup.least_moved(F.col("v"), moves).alias("s"))
    for row in made.collect():
        assert row["s"] == [min(((x * a + b) % dedup.PRIME for x in row["v"]), default=None) for a, b in moves]
    plan = sets.select(dedup.minhash(F.transform("v", lambda x: x.cast("string")), 63).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") <= 4
