"""Centroid clustering of integer vectors, with Hamerly's bounds.

Vectors are turned into integers once and written; every round is one pass over the written rows.
A row keeps its vector, its centroid, one upper bound of the distance to it and one lower bound of
the distance to the second-nearest one. The centroids' drift loosens both. A row whose upper bound
stays under the lower one, or under half the way from its centroid to the next, can't change; one
that is in doubt has its own distance taken anew, and if it still is, gets a full scan in exact
integers. Sums change by the rows that moved alone. The driver holds the centroids and their sums,
and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, map_arrow, materialize

#: Components beyond it are kept as decimal texts and computed with as Python's integers; distances of those within it fit 64 bits.
WIDE = 1 << 27
#: What a bound is widened by wherever it is rounded: some units in a double's last place.
SLACK = 2.0**-48
LIMB = 32
INTEGERS = "vec_id long, x array<long>, wide array<string>"
STATE = f"{INTEGERS}, cluster int, before int, upper double, lower double, scans int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"


def floor_scaled(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)  # a smaller x times a scale of 2^n loses nothing


def integer_vectors(df: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x, wide) of the vectors with exactly `dims` components, none of them null or not finite.

    x has the components floor(scale * x), scale a power of two; where one is beyond WIDE, x is null and `wide` has them as texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            sized = vectors.filter(pa.compute.equal(pa.compute.list_value_length(vectors), dims)).flatten()
            ids = batch.column("vec_id").filter(pa.compute.equal(pa.compute.list_value_length(vectors), dims))
            flat = sized.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
            good = np.isfinite(flat).all(1)
            flat, ids = flat[good], ids.filter(pa.array(good))
            wide = (np.abs(flat) > WIDE / scale).any(1)
            near = np.floor(np.where(wide[:, None], 0.0, flat) * scale).astype(np.int64)
            at = np.arange(len(flat) + 1, dtype=np.int32) * dims
            x = pa.ListArray.from_arrays(pa.array(at), pa.array(near.ravel()))
            far = [[str(floor_scaled(c, scale)) for c in row.tolist()] if w else None for row, w in zip(flat, wide, strict=True)]
            yield pa.record_batch([ids, pa.compute.if_else(pa.array(~wide), x, pa.scalar(None, x.type)), pa.array(far, pa.list_(pa.string()))], names=["vec_id", "x", "wide"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")), run, INTEGERS)


def matrices(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each row is within WIDE, the rows that are, the others as Python's integers)."""
    x = batch.column("x")
    near = x.is_valid().to_numpy(zero_copy_only=False)
    far = [[int(c) for c in row] for row in batch.column("wide").filter(pa.array(~near)).to_pylist()]
    return near, x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), np.array(far, dtype=object).reshape(-1, dims)


class Centroids:
    """Exact squared distances to the centroids, which are lists of Python's integers."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.rows, self.k = rows, len(rows)
        self.most = max((abs(c) for row in rows for c in row), default=0)
        self.exact = np.array(rows, dtype=object).reshape(self.k, -1)
        self.kinds: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def typed(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            c = self.exact.astype(kind)
            self.kinds[kind] = c, (c * c).sum(1)
        return self.kinds[kind]

    def kind(self, x: np.ndarray) -> type:
        """The fastest type that holds every sum on the way without rounding."""
        if x.dtype == object:
            return object
        most = max(int(np.abs(x).max(initial=0)), self.most)
        return np.float64 if 4 * x.shape[1] * most**2 <= 1 << 53 else np.int64 if most <= WIDE and x.shape[1] <= 128 else object

    def scan(self, x: np.ndarray) -> np.ndarray:
        """A row of distances to all centroids for each row of x."""
        kind = self.kind(x)
        if kind is object:
            return np.array([((self.exact - row) ** 2).sum(1) for row in x.astype(object)], dtype=object).reshape(len(x), self.k)
        c, squares = self.typed(kind)
        x = x.astype(kind)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T)) + squares

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The distance of each row to its own centroid."""
        kind = self.kind(x)
        off = x.astype(kind) - (self.exact if kind is object else self.typed(kind)[0])[cluster]
        return (off * off).sum(1)


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite where there is no such double."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([_root(int(s)) for s in squares.ravel()], np.float64).reshape(squares.shape)


def _root(square: int) -> float:
    return math.sqrt(square) if square.bit_length() < 1000 else math.inf


def moved_by(old: Centroids | None, new: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(each centroid's drift, the largest drift of the others), from above."""
    if old is None:
        return np.zeros(new.k), np.zeros(new.k)
    drift = root(((old.exact - new.exact) ** 2).sum(1)) * (1 + SLACK)
    return drift, np.array([np.delete(drift, j).max(initial=0.0) for j in range(new.k)])


def halfway(new: Centroids) -> np.ndarray:
    """Half the distance from each centroid to its nearest other one, from below."""
    apart = root(np.array([((new.exact - row) ** 2).sum(1) for row in new.exact], dtype=object).reshape(new.k, new.k))
    np.fill_diagonal(apart, np.inf)
    return np.nan_to_num(apart.min(1), posinf=0.0) / 2 * (1 - SLACK) if new.k > 1 else np.full(1, np.inf)


def settle(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, new: Centroids, drift: np.ndarray, others: np.ndarray, half: np.ndarray) -> None:
    """One round for rows of one kind, in place. A row that has no centroid yet has cluster -1."""
    known = cluster >= 0
    with np.errstate(invalid="ignore"):  # infinities less each other: no bound, so a scan
        upper[known] = (upper[known] + drift[cluster[known]]) * (1 + SLACK)
        lower[known] = lower[known] - others[cluster[known]]
        lower[known] -= np.abs(lower[known]) * SLACK
        # Strictly under the bound: no other centroid is as near, so ties can't be decided otherwise.
        doubt = np.flatnonzero(~(known & (upper < np.maximum(lower, half[cluster]))))
    again = doubt[cluster[doubt] >= 0]
    upper[again] = root(new.own(x[again], cluster[again])) * (1 + SLACK)
    doubt = doubt[~((cluster[doubt] >= 0) & (upper[doubt] < np.maximum(lower[doubt], half[cluster[doubt]])))]
    if not len(doubt):
        return
    found = new.scan(x[doubt])
    nearest = np.array([min(range(new.k), key=row.__getitem__) for row in found], np.int32) if found.dtype == object else found.argmin(1).astype(np.int32)
    at = np.arange(len(doubt))
    upper[doubt] = root(found[at, nearest]) * (1 + SLACK)
    roots = root(found)
    roots[at, nearest] = np.inf
    lower[doubt] = roots.min(1) * (1 - SLACK)
    cluster[doubt] = nearest
    scans[doubt] += 1


def assign(rows: DataFrame, old: list[list[int]] | None, new: list[list[int]], dims: int) -> DataFrame:
    """rows, as STATE, under the new centroids; the bounds that come in are those under the old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(new)
        (drift, others), half = moved_by(Centroids(old) if old else None, now), halfway(now)
        for batch in batches:
            before = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            columns = [before.copy(), *(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower", "scans"))]
            near, x, far = matrices(batch, dims)
            for mask, own in ((near, x), (~near, far)):
                for i in range(0, len(own), 4096):
                    at = np.flatnonzero(mask)[i : i + 4096]
                    part = [c[at] for c in columns]
                    settle(own[i : i + 4096], *part, now, drift, others, half)
                    for c, p in zip(columns, part, strict=True):
                        c[at] = p
            cluster, upper, lower, scans = columns
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), batch.column("wide"), pa.array(cluster), pa.array(before), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())], names=[c.split()[0] for c in STATE.split(", ")])

    return map_arrow(rows, run, STATE)


def limbs(value: int) -> list[tuple[int, int]]:
    """(place, digit) of a number to the base 2^LIMB, digits with its sign; sums of digits at one place are sums of the numbers."""
    sign, value, out = (1 if value >= 0 else -1), abs(value), []
    while value:
        if value & ((1 << LIMB) - 1):
            out.append((len(out), sign * (value & ((1 << LIMB) - 1))))
        else:
            out.append((len(out), 0))
        value >>= LIMB
    return [x for x in out if x[1]]


def changes(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """What the rows that moved change in each centroid's sums and, at last, its number of rows.

    Each task sends one number for each centroid and component, and so does each of the groups that come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            near, x, far = matrices(batch, dims)
            for name, sign in (("cluster", 1), ("before", -1)):
                cluster = batch.column(name).to_numpy(zero_copy_only=False)
                for mask, own in ((near, x), (~near, far)):
                    for j in np.unique(cluster[mask]):
                        if j >= 0:
                            at = cluster[mask] == j
                            total[j, :dims] += sign * own[at].sum(0).astype(object)
                            total[j, dims] += sign * int(at.sum())
        out = [(j, i, place, digit) for j in range(k) for i in range(dims + 1) for place, digit in limbs(int(total[j, i]))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["cluster", "i", "place", "digit"])

    moved = state.where("cluster <> before").select("x", "wide", "cluster", "before")
    found = map_arrow(moved, run, "cluster int, i int, place int, digit long").groupBy("cluster", "i", "place").agg(F.sum("digit").alias("digit")).collect()
    out = [[0] * (dims + 1) for _ in range(k)]
    for r in found:
        out[r["cluster"]][r["i"]] += r["digit"] << (LIMB * r["place"])
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k smallest hashes of `seed:vec_id`; a null id counts as an empty text, equal ids go by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) if r["x"] is not None else [int(c) for c in r["wide"]] for r in rows.orderBy(order, "x", "wide").limit(k).collect()]


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """RESULT: the nearest centroid of each kept vector after `rounds` rounds, its squared distance, and sums of these.

    Null vectors, those of another length and those with a null or non-finite component are left
    out; other columns are not read. Rows with a null id stay, repeated rows count as often as they come;
    of equally near centroids the one with the smaller number counts. Fewer than k vectors
    make as many centroids; none give an empty result. A distance or a sum that no long holds is null.
    `scans` is the number of full scans the vector had. No vector is shuffled: every round is a
    pass over written rows, whose place decides nothing, so skew has no hold; of the sums each
    task sends at most k * (dims + 1) numbers of a limb each.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, dims, scale, id_col, vec_col), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    state = vectors.selectExpr("*", "int(null) as cluster", "int(null) as before", "double(0) as upper", "double(0) as lower", "0 as scans")
    written, old, sums = vectors, None, [[0] * (dims + 1) for _ in centroids]
    for _ in range(rounds):
        state = materialize(assign(state, old, centroids, dims), "clusters")
        discard(written)
        written, old = state, centroids
        sums = [[a + b for a, b in zip(own, change, strict=True)] for own, change in zip(sums, changes(state, len(centroids), dims), strict=True)]
        centroids = [[s // own[dims] for s in own[:dims]] if own[dims] else was for own, was in zip(sums, centroids, strict=True)]
    last = materialize(distances(assign(state, old, centroids, dims), centroids, dims), "distances")
    discard(written)
    found = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()  # k rows at most
    inertia = {r["cluster"]: None if r["beyond"] or r["sum"] is None else int(r["sum"]) for r in found}
    held = lambda n: n if n is not None and n < 1 << 63 else None
    total = None if None in inertia.values() else held(sum(inertia.values()))
    rows = [(j, held(n), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, n in inertia.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def distances(state: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(vec_id, cluster, distance, scans): exact squared distances, null beyond a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centroids(centroids)
        for batch in batches:
            near, x, far = matrices(batch, dims)
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows, dtype=object)
            for mask, own in ((near, x), (~near, far)):
                if len(own):
                    out[mask] = now.own(own, cluster[mask])
            found = [int(v) for v in out.tolist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("cluster"), pa.array([v if v < 1 << 63 else None for v in found], pa.int64()), batch.column("scans")], names=["vec_id", "cluster", "distance", "scans"])

    return map_arrow(state.select("vec_id", "x", "wide", "cluster", "scans"), run, "vec_id long, cluster int, distance long, scans int")
