"""Scores of predictions, and statistics of two runs."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import normalize_entity, strip
from textmill.operators.budget import running_before
from textmill.plans.shared import materialize


def correct(pred: Column | str, label: Column | str) -> Column:
    """1 or 0 whatever the case; null where there is no label."""
    p, y = (F.lower(strip(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))) for x in (pred, label))
    given = F.col(label) if isinstance(label, str) else label
    return F.when(given.isNotNull() & (given != ""), (p == y).cast("int"))


def correct_sample(pred: Column, label: Column) -> Column:
    """The sample score that the bootstrap gets: exact, and of rows without a label too."""
    return (strip(F.coalesce(pred, F.lit(""))) == strip(F.coalesce(label, F.lit("")))).cast("int")


def accuracy(df: DataFrame, by: str, pred: str = "pred", label: str = "label") -> DataFrame:
    hit = correct(pred, label)
    return df.groupBy(by).agg(F.count(hit).alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def span_scores(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Micro precision, recall and F1 and macro F1 of two arrays of spans; a row with neither has F1 1."""
    own = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalize_entity))
    sets = df.select(own(pred).alias("p"), own(gold).alias("g"))
    n = sets.select(F.size(F.array_intersect("p", "g")).alias("tp"), F.size(F.array_except("p", "g")).alias("fp"), F.size(F.array_except("g", "p")).alias("fn"))
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    s = n.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(F.when(d > 0, 2 * F.col("tp") / d).otherwise(1.0)).alias("macro"))
    return _prf(s).select("micro_p", "micro_r", "micro_f1", F.coalesce("macro", F.lit(0.0)).alias("macro_f1"))


def _prf(s: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    s = s.withColumn("micro_p", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("micro_r", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)))
    return s.withColumn("micro_f1", ratio(2 * F.col("micro_p") * F.col("micro_r"), F.col("micro_p") + F.col("micro_r")))


def set_scores(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Precision, recall and F1 of two arrays as sets, summed over rows."""
    p, r = F.array_distinct(pred), F.array_distinct(ref)
    s = df.select(F.size(F.array_intersect(p, r)).alias("tp"), F.size(F.array_except(p, r)).alias("fp"), F.size(F.array_except(r, p)).alias("fn")).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return _prf(s).select(F.col("micro_p").alias("precision"), F.col("micro_r").alias("recall"), F.col("micro_f1").alias("f1"))


def perplexity(nll: Column | str) -> Column:
    """exp of the mean; nulls and NaN are left out, infinite if nothing is left."""
    x = F.col(nll) if isinstance(nll, str) else nll
    return F.coalesce(F.exp(F.avg(F.when(~F.isnan(x), x))), F.lit(float("inf")))


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at the ranks round(p * (n - 1)), halves to the even one, of each group.

    Distinct values are counted, the counts summed in order of the values by ranges, and the
    values that hold a wanted rank picked. No group is gathered, however many values it has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_before(counts, "_by", ["_v"], "_n", "_before")
    sizes = upto.groupBy("_by").agg(F.sum("_n").alias("_all"))
    ranks = F.array(*[F.bround(F.lit(p) * (F.col("_all") - 1)).cast("long") for p in shares.values()])
    hit = upto.join(sizes.select(F.col("_by").alias("_b"), ranks.alias("_ranks")), F.col("_by").eqNullSafe(F.col("_b")))
    inside = lambda i: (F.get("_ranks", F.lit(i)) >= F.col("_before")) & (F.get("_ranks", F.lit(i)) < F.col("_before") + F.col("_n"))
    return hit.groupBy(F.col("_by").alias(by)).agg(*[F.max(F.when(inside(i), F.col("_v"))).alias(name) for i, name in enumerate(shares)])


def bleu_1(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Clipped unigram precision of two arrays of tokens over all rows, times the brevity penalty; 0 to 100.

    Tokens are counted by row and side and joined, so that a long text takes linear time.
    """
    rows = materialize(df.select(F.monotonically_increasing_id().alias("row"), F.col(pred).alias("p"), F.col(ref).alias("r")), "bleu-1-rows")
    counts = lambda side: rows.select("row", F.explode(side).alias("t")).groupBy("row", "t").count()
    hit = counts("p").join(counts("r").withColumnRenamed("count", "have"), ["row", "t"]).agg(F.coalesce(F.sum(F.least("count", "have")), F.lit(0)).alias("hit"))
    s = rows.agg(F.sum(F.size("p")).alias("c"), F.sum(F.size("r")).alias("r")).crossJoin(hit)  # one row each
    penalty = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return s.select(F.when(F.col("c") > 0, 100 * penalty * F.col("hit") / F.col("c")).otherwise(0.0).alias("bleu_1"))


# What the usual tokenizer of corpus BLEU (mteval 13a) puts spaces around, in order.
TOKENS_13A = [(r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")]
ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def tokens_13a(x: Column | str) -> Column:
    out = F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    for a, b in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES_13A]:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, put in TOKENS_13A:
        out = F.regexp_replace(out, pattern, put)
    return F.array_remove(F.split(out, r"[\x09-\x0D\x1C-\x20]+"), "")


def bleu(df: DataFrame, pred: str, ref: str, most: int = 4) -> DataFrame:
    """Corpus BLEU of two texts, 0 to 100: clipped n-gram precisions of 13a tokens, exponential smoothing, geometric mean, brevity penalty.

    N-grams are counted by row and side, joined by row and n-gram and summed, so a long text is
    no long array.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), tokens_13a(pred).alias("p"), tokens_13a(ref).alias("r"))
    rows = materialize(rows, "bleu-rows")
    grams = lambda side: rows.select("row", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size(side) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(side) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(side, i, n), " "))).otherwise(F.array().cast("array<string>")).alias("g")) for n in range(1, most + 1)])).alias("x")).select("row", "x.n", F.explode("x.g").alias("g")).groupBy("row", "n", "g").count()
    hits = grams("p").join(grams("r").withColumnRenamed("count", "have"), ["row", "n", "g"], "left").groupBy("n").agg(F.sum(F.least("count", F.coalesce("have", F.lit(0)))).alias("hit"), F.sum("count").alias("total"))
    one = hits.agg(F.map_from_entries(F.collect_list(F.struct("n", "hit"))).alias("hits"), F.map_from_entries(F.collect_list(F.struct("n", "total"))).alias("totals"))  # four rows
    s = rows.agg(F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("c"), F.coalesce(F.sum(F.size("r")), F.lit(0)).alias("q")).crossJoin(one)
    logs, misses = F.lit(0.0), F.lit(0)
    for n in range(1, most + 1):
        hit, total = (F.coalesce(F.try_element_at(c, F.lit(n)), F.lit(0)) for c in (F.col("hits"), F.col("totals")))
        misses = misses + (hit == 0).cast("int")
        logs = logs + F.log(F.when(hit > 0, hit / total).otherwise(1 / (F.pow(F.lit(2.0), misses) * total)))
    penalty = F.when(F.col("c") >= F.col("q"), F.lit(1.0)).otherwise(F.exp(1 - F.col("q") / F.col("c")))
    whole = (F.coalesce(F.try_element_at("totals", F.lit(most)), F.lit(0)) > 0) & (F.coalesce(F.try_element_at("hits", F.lit(1)), F.lit(0)) > 0)
    return s.select(F.when(whole, 100 * penalty * F.exp(logs / most)).otherwise(0.0).alias("bleu"))


VOWELS = "aeiou"
# The suffixes of the Porter stemmer's second, third and fourth steps and what takes their place.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [(s, "") for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()]


# Words whose stems follow no rule.
IRREGULAR = {"skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning"} | {w: w for w in ("sky", "news", "howe", "proceed", "exceed", "succeed")}


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word, with the usual extensions for short words in -ie and irregular ones."""
    if word in IRREGULAR:
        return IRREGULAR[word]

    def shape(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in VOWELS or (c == "y" and i and out[-1] == "c") else "c"
        return out

    measure = lambda w: len(re.findall("v+c+", shape(w)))
    short = lambda w: shape(w).endswith("cvc") and w[-1] not in "wxy"

    def step(w: str, table: list[tuple[str, str]], least: int) -> str:
        for end, put in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                own = w[: len(w) - len(end)]
                return own + put if measure(own) > least and not (end == "ion" and own[-1:] not in ("s", "t")) else w
        return w

    w = word
    if len(w) <= 2:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) and not (w.endswith("ies") and len(w) == 4) else w[:-1] if w.endswith("ies") or not w.endswith("ss") else w
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (end := "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else "") and "v" in shape(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short(w):
            w += "e"
    if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = step(step(step(w, STEP_2, 0), STEP_3, 0), STEP_4, 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors: a bit for each place of a, a step for each word of b."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Mean F of the longest common subsequence of stemmed words; words of three letters or fewer stay."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        words = lambda t: [stem(w) if len(w) > 3 else w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split()]
        both = [(words(x), words(y)) for x, y in zip(p.fillna(""), r.fillna(""), strict=True)]
        return pd.Series([2 * common_length(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in both])

    return df.select(score(pred, ref).alias("f")).agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("rouge_l"))


def mean_similarity(df: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], pred: str, ref: str) -> DataFrame:
    """Mean of a model's similarity of two texts, a hook: scorer() is called once in each Python worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = scorer()
        for p, r in batches:
            yield pd.Series(own(p.fillna("").tolist(), r.fillna("").tolist()), dtype="float64")

    return df.select(score(pred, ref).alias("f")).agg(F.avg("f").alias("mean_similarity"))


def suffix_likelihoods(df: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], row: str = "row", prompt: str = "prompt", letters: str = "ABCD") -> DataFrame:
    """(row, letter, variant, ll) of each letter's spellings behind each prompt, a hook for a model's likelihoods; best_variant() decides."""
    spellings = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(v).alias("variant")) for x in letters for v in (f" {x}", x)])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = scorer()
        for p, v in batches:
            yield pd.Series(own(p.fillna("").tolist(), v.tolist()), dtype="float64")

    return df.select(row, prompt, F.explode(spellings).alias("x")).select(row, "x.letter", "x.variant", score(prompt, "x.variant").alias("ll"))


def best_variant(df: DataFrame, row: str = "row", letter: str = "letter", ll: str = "ll") -> DataFrame:
    """(row, choice): the letter whose best variant has the largest likelihood; the first on a tie, empty if all are -inf."""
    best = df.groupBy(row, letter).agg(F.max(ll).alias("ll"))
    top = best.groupBy(row).agg(F.min_by(letter, F.struct(-F.col("ll"), letter)).alias("choice"), F.max("ll").alias("ll"))
    return top.select(row, F.when(F.col("ll") == float("-inf"), "").otherwise(F.col("choice")).alias("choice"))


def bootstrap(df: DataFrame, base: str, adapted: str, order: str, samples: int = 1000, seed: int = 17) -> DataFrame:
    """delta_mean, ci_low, ci_high and p_value_two_sided of mean(adapted) - mean(base).

    Indices are drawn by md5(seed, sample, place), so that any engine can repeat them; the
    Mersenne Twister's order can't be had in SQL. Rows are numbered by `order`, a whole number, range by range. A sample's draws
    are joined to the differences by number; both sides grow with the evaluated rows.
    """
    ones = df.select(F.lit(0).alias("_g"), order, (F.col(adapted) - F.col(base)).cast("double").alias("d"), F.lit(1).alias("_one"))
    numbered = running_before(ones, "_g", [order], "_one", "i").select("i", "d")
    n = df.count()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(float("nan"), float("nan"), float("nan"), 1.0)], "delta_mean double, ci_low double, ci_high double, p_value_two_sided double")
    draws = spark.range(samples * n).select((F.col("id") / n).cast("long").alias("b"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(n)).alias("i"))
    numbered = materialize(numbered, "bootstrap-rows")
    deltas = draws.join(numbered, "i").groupBy("b").agg((F.sum("d") / n).alias("d"))
    return _interval(numbered.agg((F.sum("d") / n).alias("delta_mean")), deltas, samples)


def _interval(mean: DataFrame, deltas: DataFrame, samples: int) -> DataFrame:
    """mean (delta_mean), one row, with the interval and the p-value of the samples' deltas (b, d), a number each."""
    own = deltas.agg(F.sort_array(F.collect_list("d")).alias("s"), F.avg((F.col("d") <= 0).cast("double")).alias("le"), F.avg((F.col("d") >= 0).cast("double")).alias("ge"))
    at = lambda p: F.get("s", F.lit(int(p * (samples - 1))))
    return mean.crossJoin(own).select("delta_mean", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p_value_two_sided"))


def share_of_block(block: int, upto: list[int], samples: int, seed: int) -> np.ndarray:
    """How many draws of each sample fall into a block, of blocks whose sizes sum up to upto[1], upto[2], ... (upto[0] is 0).

    The n draws are split in two halves of the blocks by a binomial draw, and on down to the block; a split's
    draw depends on seed and place alone, so every block finds its own share, and all shares sum to n.
    """
    lo, hi = 0, len(upto) - 1
    m = np.full(samples, upto[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).binomial(m, (upto[mid] - upto[lo]) / (upto[hi] - upto[lo]))
        m, lo, hi = (left, lo, mid) if block < mid else (m - left, mid, hi)
    return m


def draws_of_block(block: int, values: np.ndarray, counts: np.ndarray, m: np.ndarray, seed: int) -> np.ndarray:
    """The sum, in each sample, of m draws from a block's values, which come `counts` times each."""
    out, rng, step = np.zeros(len(m)), np.random.default_rng([seed, block, 1 << 40]), max(1, 2_000_000 // max(1, len(values)))
    for at in range(0, len(m), step):
        out[at : at + step] = rng.multinomial(m[at : at + step], counts / counts.sum()) @ values
    return out


def bootstrap_blocks(df: DataFrame, base: str, adapted: str, samples: int = 1000, seed: int = 17, per_block: int = 100_000) -> DataFrame:
    """bootstrap() without the product of rows and samples: exactly n draws a sample, split over blocks of rows.

    Differences are counted by block and value; each block draws for itself and returns a sum for each
    sample, so the shuffle has blocks times samples numbers. The same on any partitioning, as
    blocks go by the values' hash and rows of equal difference are alike. Rows without either score are left out.
    """
    rows = df.select((F.col(adapted) - F.col(base)).cast("double").alias("d")).where("d is not null")
    counted = rows.groupBy("d").agg(F.count("*").alias("n"))
    size = rows.count()
    blocks = max(1, -(-size // per_block))
    held = materialize(counted.select(F.pmod(F.xxhash64("d"), F.lit(blocks)).cast("int").alias("block"), "d", "n"), "bootstrap-values")
    sizes = {r["block"]: r["n"] for r in held.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # a number for each block
    if not size:
        return df.sparkSession.createDataFrame([(float("nan"), float("nan"), float("nan"), 1.0)], "delta_mean double, ci_low double, ci_high double, p_value_two_sided double")
    names = sorted(sizes)
    upto = [0, *np.cumsum([sizes[b] for b in names]).tolist()]
    place = {b: i for i, b in enumerate(names)}

    def draw(key, own):
        i, own = place[key[0].as_py()], own.sort_by("d")
        sums = draws_of_block(i, own["d"].to_numpy(), own["n"].to_numpy(), share_of_block(i, upto, samples, seed), seed)
        return pa.table({"b": pa.array(np.arange(samples)), "d": pa.array(sums)})

    deltas = held.groupBy("block").applyInArrow(draw, "b long, d double").groupBy("b").agg((F.sum("d") / size).alias("d"))
    return _interval(held.agg((F.sum(F.col("d") * F.col("n")) / size).alias("delta_mean")), materialize(deltas, "bootstrap-deltas"), samples)


def baseline_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, value, baseline, delta) of the metrics that both have."""
    return now.join(before.select("metric", F.col("value").alias("baseline")), "metric").select("metric", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"))


def paired(base: DataFrame, adapted: DataFrame) -> DataFrame:
    """(dataset, idx, base, adapted) of the datasets (dataset, idx, score) that both have, in equal numbers."""
    sizes = base.groupBy("dataset").agg(F.count("*").alias("n")).join(adapted.groupBy("dataset").agg(F.count("*").alias("m")), "dataset").where("n = m").select("dataset")
    both = base.select("dataset", "idx", F.col("score").alias("base")).join(adapted.select("dataset", "idx", F.col("score").alias("adapted")), ["dataset", "idx"])
    return both.join(sizes, "dataset", "left_semi")
