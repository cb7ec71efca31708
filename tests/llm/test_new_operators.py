"""Fill-in-the-middle, word BPE by a lexicon and centroid clustering against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from textmill.llm import clusters, infill, lexicon  # noqa: E402
from textmill.llm.queries import QUERIES  # noqa: E402

MODEL = P.path("word_bpe_49k.json")
CLASHES = "n long, form string, ids long, decoded long, cluster long, x long"
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a b"), (4, "x\n\n\ny"), (5, "a <P> b\nc"), (6, "a<\nS>b<S\nq<M"), (6, "a<\nS>b<S\nq<M"), (7, "é\u0000\x0b漢字 😀 \r\n İ ΣΑΣ ﬁ"), (None, "no\nid\n"), (8, "\n" * 50), (9, "<\n" * 30 + "<M"), (10, "z" * 50_000 + "\n" + "k\n" * 50_000), (11, "it's we'LL !'s ''s 'twas x'")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *[1] * 2, "f", *[1] * 3) for i, t in ODD], "doc_id long, text string, n_chars long, n long, form string, ids long, cluster long, x long").repartition(3)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_word_bpe"])
def test_empty_documents(name, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


# 11


def plain_infill(i, text, how=infill.Infill()):  # noqa: B008
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not t or any(x in t for x in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.percent:
        return i, len(units), "plain", None, None, t, sha(t), sha(t)
    form = "spm" if h[3] % 100 < how.spm else "psm"
    out = f"{how.prefix}{p}{how.suffix}{s}{how.middle}{m}" if form == "psm" else f"{how.suffix}{s}{how.prefix}{p}{how.middle}{m}"
    return i, len(units), form, len(p), len(m), out, sha(out), sha(t)


@pytest.mark.parametrize("how", [infill.Infill(), infill.Infill(seed=3, percent=40, spm=20, prefix="[a]", suffix="[b]", middle="[c]")])
def test_infill_of_odd_rows(odd, how):
    got = Counter(map(tuple, infill.fill_in_middle(odd, how).collect()))
    assert got == Counter(plain_infill(i, t, how) for i, t in ODD)


def test_infill_of_random_texts(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab<PSM>\n é") for _ in range(r.randrange(60)))) for i in range(3000)]
    got = {tuple(x) for x in infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {plain_infill(*x) for x in rows}
    forms = Counter(x[2] for x in got)
    assert forms["plain"] < 600 and abs(forms["psm"] - forms["spm"]) < 300


def test_marks_that_could_be_mistaken():
    with pytest.raises(ValueError):
        infill.Infill(prefix="aba", suffix="xyz", middle="uvw")
    with pytest.raises(ValueError):
        infill.Infill(prefix="<P>", suffix="<P>")


# 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def table(library):
    with open(MODEL, encoding="utf-8") as file:
        definition = file.read()
    return definition, *lexicon.character_tables(library)


def hard_texts():
    r = random.Random(5)
    pools = ["abcdefst'rvmld !.", "aé漢字😀 ＃İΣΑΣﬁſ́̈å각क़ÅKΩǅ", "'sstremvdl' ", "0123٣²½Ⅷ a", "  \t\n\r\x0b\x1c\x85​ ﻿᠎ x", "<|startoftext|> <|endoftext|>ab'", "\u0000\u0007ퟻ￿\U0001f600\U00020000\U000e0001x", "अआक्षิำ้ກ"]
    out = ["".join(r.choice(r.choice(pools) if i % 2 else pools[i % 8]) for _ in range(r.randrange(40))) for i in range(8000)]
    parts = ["<|startoftext|>", "<|endoftext|>", "<|", "'s", "'re", "'ll", " ", "é", "é", "İ", "x" * 60, "==" * 40]
    out += ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000)]
    return out + ["x" * 20_000, "á" * 2000, "-" * 10_000, "ab" * 9000, "1" * 3000, "", "r'l"]


@pytest.mark.parametrize("frequent", [[], ["the", "thee", "then", "s", "'s", "!", "ab", "abc", "xx", "1", "==", "漢字", "x" * 32]])
def test_lexicon_encodes_as_the_library(table, library, tmp_path, frequent):
    """Whatever the lexicon holds, nothing too."""
    definition, kinds, forms = table
    lexicon.save(lexicon.compiled(frequent, lexicon.Merges(definition), kinds, forms), str(tmp_path / "lexicon.bin"))
    own = lexicon.Lexicon(definition, lexicon.load(str(tmp_path / "lexicon.bin")))
    texts = hard_texts()
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for i in range(0, len(texts), 700) for x in own.encode_all(texts[i : i + 700])]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert all(own.decode(a) == library.decode(a, skip_special_tokens=False) for a in got[::7])


def test_transducer_is_minimal_and_exact():
    """It accepts the words with their outputs and no others; no two states have the same continuations."""
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(300)})
    outputs = {w: tuple(r.randrange(3) for _ in range(r.randrange(1, 4))) for w in words}
    states, first = lexicon.transducer(words, [outputs[w] for w in words])

    def run(word):
        at, out = first, ()
        for c in word:
            arc = next((a for a in states[at][0] if a[0] == c), None)
            if arc is None:
                return None
            at, out = arc[1], out + arc[2]
        return None if states[at][1] is None else out + states[at][1]

    every = [""]
    for _ in range(6):
        every += [w + c for w in every[-(3 ** len(every[-1])) :] for c in "abc"]
    assert all(run(w) == outputs.get(w) for w in every)

    def language(at):
        arcs, end = states[at]
        return frozenset([("", end)] if end is not None else []) | frozenset((c + w, out + o) for c, to, out in arcs for w, o in language(to))

    languages = [language(i) for i in range(1, len(states))]
    assert len(set(languages)) == len(languages) < sum(map(len, words))


def test_word_bpe_of_odd_rows(odd, spark, library):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in lexicon.encode_words(odd, MODEL, words=50).collect())
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, tuple(ids), text, len(ids), sha(" ".join(map(str, ids))), sha(text)] += 1
    assert got == want


def test_word_bpe_of_documents(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op12_word_bpe"](spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)))) and r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# 13


def plain_clusters(rows, k, rounds, dims, scale, seed):
    """Every distance in every round, in Python's integers."""
    import math

    kept = [(i, [math.floor(scale * float(c)) if abs(c) < 2**53 else scale * int(c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda x: (hashlib.sha256(f"{seed}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else centroids[j] for j, g in enumerate(own)]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    fits = lambda n: n if n < 1 << 63 else None
    lost = {j for _, d, j in found if d >= 1 << 63}
    inertia = lambda j: None if j in lost else fits(sums[j])
    total = None if any(inertia(j) is None for _, _, j in found) else fits(sum(sums.values()))
    return Counter((i, j, fits(d), inertia(j), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def cluster(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster long, x long").repartition(3)
    return clusters.cluster_vectors(df, **options)


def as_counter(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_groups_ties_and_odd_rows(spark, seed):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in middles[i % 5]]) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(400 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)]  # many alike, and many as near to two
    rows += [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 2.0, 3.0]), (503, [1.0, float("nan"), 2.0, 3.0]), (504, [float("inf"), 1.0, 1.0, 1.0]), (505, []), (None, [0.1, 0.2, 0.3, 0.4]), (7, rows[7][1])]
    options = dict(k=6, rounds=4, dims=4, scale=256, seed=seed)
    made = cluster(spark, rows, **options)
    assert as_counter(made) == plain_clusters(rows, **options)
    assert sum(x["scans"] for x in made.collect()) < 0.9 * 5 * made.count()  # the bounds spare scans


def test_clusters_of_very_large_components(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 0, 5, 12, 30]) for _ in range(3)]) for i in range(60)] + [(90, [1.7e308, -1.7e308, 0.0])]
    options = dict(k=4, rounds=3, dims=3, scale=256, seed=2)
    assert as_counter(cluster(spark, rows, **options)) == plain_clusters(rows, **options)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    options = dict(k=5, rounds=2, dims=2, scale=256, seed=2)
    assert as_counter(cluster(spark, rows, **options)) == plain_clusters(rows, **options)
    assert cluster(spark, [(1, [1.0])], **options).count() == 0


def test_bounds_hold_in_every_round(spark):
    """Upper bounds are no less than the distance to the own centroid, lower ones no more than to any other."""
    r = np.random.default_rng(3)
    x = (r.normal(size=(400, 8)) * 256).astype(np.int64)
    centroids = [x[i].tolist() for i in range(7)]
    cluster_, upper, lower, scans, old = np.full(400, -1, np.int32), np.zeros(400), np.zeros(400), np.zeros(400, np.int32), None
    for _ in range(6):
        now = clusters.Centroids(centroids)
        clusters.settle(x, cluster_, upper, lower, scans, now, *clusters.moved_by(old, now), clusters.halfway(now))
        every = np.sqrt(((x[:, None] - np.array(centroids)[None]) ** 2).sum(2))
        own = every[np.arange(400), cluster_]
        assert (cluster_ == every.argmin(1)).all() and (upper >= own).all()
        every[np.arange(400), cluster_] = np.inf
        assert (lower <= every.min(1)).all()
        old, centroids = now, [(x[cluster_ == j].sum(0) // max(1, (cluster_ == j).sum())).tolist() for j in range(7)]
    assert scans.sum() < 6 * 400
