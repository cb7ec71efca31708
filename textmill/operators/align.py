"""Vectors: normalising, relative representations, alignment of vocabularies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.budget import running_before

# Where models of each type keep the rows of their input embeddings and of their output head.
EMBEDDING_ROWS = {"gpt_neox": "gpt_neox.embed_in.weight", "llama": "model.embed_tokens.weight", "mistral": "model.embed_tokens.weight", "qwen2": "model.embed_tokens.weight", "qwen2_moe": "model.embed_tokens.weight"}
HEAD_ROWS = {"gpt_neox": "embed_out.weight", "llama": "lm_head.weight", "mistral": "lm_head.weight", "qwen2": "lm_head.weight", "qwen2_moe": "lm_head.weight"}


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def normalized(v: Column | str) -> Column:
    """Length 1; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: x.cast("double") / F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v)))


def with_unit(df: DataFrame, vec: str, name: str = "unit") -> DataFrame:
    n = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col("_n"))
    return df.withColumn("_n", norm(vec)).withColumn(name, F.transform(vec, lambda x: x.cast("double") / n)).drop("_n")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gold_overlap(target: DataFrame, source: DataFrame) -> DataFrame:
    """(tgt_id, src_id) of the tokens (token, id) that both vocabularies have."""
    return target.select("token", F.col("id").alias("tgt_id")).join(source.select("token", F.col("id").alias("src_id")), "token").select("tgt_id", "src_id")


def normalize_gold(gold: DataFrame, order: str | None = None) -> DataFrame:
    """Keys and values (key, value) as integers, without those that are none; of a key's values the last in order counts, or the largest without one."""
    whole = lambda c: F.trim(F.col(c).cast("string")).try_cast("int")
    rows = gold.select(whole("key").alias("tgt_id"), whole("value").alias("src_id"), (F.col(order) if order else F.lit(0)).alias("_o")).where("tgt_id is not null and src_id is not null")
    return rows.groupBy("tgt_id").agg(F.max_by("src_id", F.struct("_o", "src_id")).alias("src_id"))


def pick_pivots(ids: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """n ids in a hashed order, which stands for a seeded shuffle."""
    return ids.orderBy(F.md5(F.concat_ws(":", F.lit(seed), id_col).cast("binary")), id_col).limit(n)


#: Source vectors, and queries, that a block holds at most; smaller tables are dealt into up to FEW blocks of SMALL rows, so that tasks are many.
BLOCK, QUERIES, SMALL, FEW = 32_768, 32_768, 4096, 4
#: Similarities that a task holds at once.
CELLS = 4 << 20


def n_blocks(rows: int, most: int) -> int:
    return max(1, -(-rows // most), min(FEW, -(-rows // SMALL)))


def top2(queries: DataFrame, source: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, best_id, best_sim, second_id, second_sim): the two largest inner products; ties go to the smaller id.

    Both sides are gathered in blocks, a pair of blocks is scored by matrix products in one task,
    and the blocks' best two are merged. Neither side is collected or broadcast, and a task
    holds one block of each, whatever their sizes. Every block of one side meets every block of the
    other, so what is shuffled is quadratic, divided by the rows of a block.
    """
    n_held, n_asked = n_blocks(source.count(), block), n_blocks(queries.count(), QUERIES)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = (F.col("id").alias("id"), F.col("vec").alias("vec"))
    held = source.select(part(n_held).alias("block"), every(n_asked).alias("asked"), *vectors)
    spread = queries.select(every(n_held).alias("block"), part(n_asked).alias("asked"), *vectors)

    def dense(column: pa.ChunkedArray) -> np.ndarray:
        flat = pc.list_flatten(column).to_numpy().astype(np.float64)
        return flat.reshape(len(column), -1)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, cands, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            own = right.sort_by("id")
            matrix, names = dense(own["vec"]), own["id"].to_numpy()
            step = max(1, CELLS // len(names))
            for start in range(0, left.num_rows, step):
                some = left.slice(start, step)
                sims, rows = np.round(dense(some["vec"]) @ matrix.T, 9), np.arange(some.num_rows)
                for _ in range(min(2, len(names))):  # the best, then the best of the rest; the first of equal ones has the smaller id
                    best = np.argmax(sims, axis=1)
                    ids.append(some["id"].to_numpy())
                    cands.append(names[best])
                    values.append(sims[rows, best].copy())
                    sims[rows, best] = -np.inf
        return pa.table({"id": pa.array(np.concatenate(ids), pa.int64()), "cand": pa.array(np.concatenate(cands), pa.int64()), "sim": pa.array(np.concatenate(values), pa.float64())})

    some = spread.groupBy("block", "asked").cogroup(held.groupBy("block", "asked")).applyInArrow(score, "id long, cand long, sim double")
    ranked = some.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "cand"))), 1, 2).alias("t"))
    at = lambda i, name: F.get("t", F.lit(i))[name]
    return ranked.select("id", at(0, "cand").alias("best_id"), (-at(0, "s")).alias("best_sim"), at(1, "cand").alias("second_id"), (-at(1, "s")).alias("second_sim"))


def align(target_ids: DataFrame, gold: DataFrame, target_vectors: DataFrame, source_vectors: DataFrame, n_source: int, unknown: int | None = None, seed: int = 0) -> DataFrame:
    """(tgt_id, src_id, method, margin): gold where known, hash-drawn where there is no vector, else the best inner product.

    Where the best is the unknown token, the second best is taken.
    """
    ids = target_ids.select(F.col("id").alias("tgt_id")).join(gold, "tgt_id", "left")
    vectors = target_vectors.select(F.col("id").alias("tgt_id"), F.col("vec").alias("vec"))
    rest = ids.where("src_id is null").drop("src_id").join(vectors, "tgt_id", "left")
    drawn = rest.where("vec is null").select("tgt_id", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "tgt_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n_source)).alias("src_id"), F.lit("random").alias("method"), F.lit(None).cast("double").alias("margin"))
    found = top2(rest.where("vec is not null").select(F.col("tgt_id").alias("id"), "vec"), source_vectors)
    chosen = F.when((F.col("best_id") == F.lit(unknown)) & F.col("second_id").isNotNull(), F.col("second_id")).otherwise(F.col("best_id")) if unknown is not None else F.col("best_id")
    queried = found.select(F.col("id").alias("tgt_id"), chosen.alias("src_id"), F.lit("query").alias("method"), (F.col("best_sim") - F.col("second_sim")).alias("margin"))
    known = ids.where("src_id is not null").select("tgt_id", F.col("src_id").cast("long"), F.lit("gold").alias("method"), F.lit(None).cast("double").alias("margin"))
    return known.unionByName(drawn).unionByName(queried)


def margin_stats(aligned: DataFrame) -> DataFrame:
    """Number, mean, median and 90 % point (linear between ranks) of the margins.

    The ranks' values are looked up in the counted, range-sorted margins; no task gathers them.
    """
    rows = aligned.where("margin is not null").select(F.lit(0).alias("_g"), "margin")
    counts = rows.groupBy("_g", "margin").agg(F.count("*").alias("_n"))
    upto = running_before(counts, "_g", ["margin"], "_n", "_before")
    whole = upto.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum(F.col("margin") * F.col("_n")) / F.sum("_n")).alias("mean"))
    rank = lambda p: F.lit(p) * (F.col("n") - 1)
    at = lambda k: F.max(F.when((k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")), F.col("margin")))
    ends = upto.crossJoin(F.broadcast(whole)).groupBy("n", "mean").agg(*[x for i, p in enumerate((0.5, 0.9)) for x in (at(F.floor(rank(p))).alias(f"a{i}"), at(F.ceil(rank(p))).alias(f"b{i}"))])  # one row beside each
    point = lambda i, p: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (rank(p) - F.floor(rank(p)))
    return ends.select("n", "mean", point(0, 0.5).alias("median"), point(1, 0.9).alias("p90"))


def gather_rows(mapping: DataFrame, weights: DataFrame, also: list[str] = ()) -> DataFrame:
    """Row tgt_id of the new matrix is row src_id of the old one (row_id, vec); `also` names further key columns of both."""
    also = list(also)
    return mapping.select(*also, "tgt_id", "src_id").join(weights.select(*also, F.col("row_id").alias("src_id"), "vec"), [*also, "src_id"]).select(*also, "tgt_id", "src_id", "vec")


def remap(tensors: DataFrame, mapping: DataFrame, model_type: str) -> DataFrame:
    """(tensor, row_id, vec): a model's tensors (tensor, row_id, vec) with the embedding and head rows gathered anew by mapping (tgt_id, src_id)."""
    if model_type not in EMBEDDING_ROWS:
        raise ValueError(f"unknown model type {model_type!r}")
    names = [EMBEDDING_ROWS[model_type], HEAD_ROWS[model_type]]
    moved = gather_rows(mapping.crossJoin(mapping.sparkSession.createDataFrame([(n,) for n in names], "tensor string")).select("tensor", "tgt_id", "src_id"), tensors, ["tensor"])
    return moved.select("tensor", F.col("tgt_id").alias("row_id"), "vec").unionByName(tensors.where(~F.col("tensor").isin(names)).select("tensor", "row_id", "vec"))


def invert(mapping: DataFrame) -> DataFrame:
    """(src_id, tgt_id): the first target of each source."""
    return mapping.groupBy("src_id").agg(F.min("tgt_id").alias("tgt_id"))


def shuffled(mapping: DataFrame, n_source: int, fraction: float, seed: int = 0) -> DataFrame:
    """An ablation: a hash-drawn share of the rows gets a hash-drawn source."""
    draw = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{s}"), "tgt_id").cast("binary")), 1, 8), 16, 10).cast("long")
    changed = draw("a") < int(fraction * (1 << 32))
    return mapping.withColumn("src_id", F.when(changed, F.pmod(draw("b"), F.lit(n_source))).otherwise(F.col("src_id"))).withColumn("changed", changed)


def permuted(mapping: DataFrame, n_source: int, seed: int = 0) -> DataFrame:
    """An ablation: every row gets the source of another one, by a seeded permutation of the source ids modulo n_source.

    The permutation is an affine one, whose factor has no divisor in common with n_source.
    """
    import math

    factor = next(a for a in range(2 * (n_source // 3) + 1 + 2 * seed, 4 * n_source + 8) if math.gcd(a, n_source) == 1)
    return mapping.withColumn("src_id", F.pmod(F.col("src_id") * F.lit(factor) + F.lit(seed + 1), F.lit(n_source)))


def quality(target_lines: DataFrame, references: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """(order, mapped, reference, coverage): token ids of target texts taken back to the source vocabulary, beside the source's own.

    target_lines (order, ids) and references (order, ids); the mapping is inverted, the first
    target of each source counts, and ids that it lacks are dropped. bleu_1 of the two columns is
    the alignment's score.
    """
    back = mapping.groupBy("tgt_id").agg(F.min("src_id").alias("src_id"))
    each = target_lines.select(order, F.size("ids").alias("n"), F.posexplode("ids").alias("at", "tgt_id")).join(back, "tgt_id", "left")
    # An id's place joins it back to its text; a text's ids come together again, as many as it had.
    lines = each.groupBy(order, "n").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("src_id").isNotNull(), F.struct("at", "src_id")))), lambda x: x["src_id"]).alias("mapped"))
    return lines.join(references.select(order, F.col("ids").alias("reference")), order).select(order, "mapped", "reference", (F.size("mapped") / F.greatest("n", F.lit(1))).alias("coverage"))


def coverage(vectors: DataFrame, vocabulary: DataFrame, least: float = 0.5) -> DataFrame:
    have = vocabulary.join(vectors.select("id").distinct().withColumn("has", F.lit(1)), "id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("has"), F.lit(0)).alias("covered"))
    return have.select("n", "covered", (F.col("covered") / F.greatest("n", F.lit(1))).alias("ratio")).withColumn("enough", F.col("ratio") >= least)


def parse_vectors(lines: DataFrame, value: str = "value") -> DataFrame:
    """(token, vec) of lines "<token> f1 ... fd"."""
    parts = F.split(F.col(value), " ")
    return lines.select(parts.alias("p")).select(F.get("p", F.lit(0)).alias("token"), F.transform(F.filter("p", lambda x, i: i > 0), lambda x: x.cast("float")).alias("vec"))


