"""Centroid clustering by Lloyd's rounds in whole numbers, with Exponion's search.

Each vector keeps an upper bound on the distance to its centroid and a lower bound on the distance to any
other. While the upper one is the smaller, or smaller than half of the gap to the nearest other centroid,
nothing is computed. Otherwise only centroids are scanned that lie within a ball of radius
2 * upper + gap around the vector's own one, taken from that centroid's sorted list of neighbours;
the radius is inclusive, so a tied centroid is inside. Comparisons are of whole numbers; bounds are
rounded outward, so that rounding can only cause more scans.

A round is one pass over a table of packed vectors with their state, which writes the next such table in
the shared folder; the table before goes. No vector is shuffled. What the driver gathers is the sum and
count of the vectors that changed their centroid: centroids x components numbers. A round after
which no centroid moved is the last one that needs to run: all later ones would repeat it.

Defined cases: a vector is left out if it is null, hasn't the wanted number of components, or has one that
is null, not finite or, times SCALE, beyond 2^27 either way, where squared distances leave the range of a
long. A null vec_id is hashed as an empty one; equal hashes (repeated rows) are put in order by components.
With fewer vectors than centroids wanted there are as many centroids as vectors; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heathgrid.shared import drop, keep, written

SCALE = 1024
LARGEST = 1 << 27
ROUNDING = 1e-12
#: The lower bound where there is no other centroid.
FAR = 1e300
#: Vectors that a kernel looks at together.
PIECE = 4096


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, x (the components as int32 in a row of bytes) of every vector that is kept."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= LARGEST / SCALE))
    kept = vectors.where((F.size(x) == size) & fine).select("vec_id", scaled.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4")
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), batch.num_rows, [None, pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows.cast(pa.binary())], names=["vec_id", "x"])

    return kept.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, x binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow column of packed ones."""
    if not len(column):
        return np.zeros((0, size), dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, size)


def first_centroids(vectors: DataFrame, k: int, salt: str, size: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:vec_id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    order = [np.frombuffer(r.x, dtype="<i4").astype(np.int64) for r in vectors.select(h.alias("h"), "x", F.hex("x").alias("tie")).orderBy("h", "tie").limit(k).collect()]
    return np.array(order, dtype=np.int64).reshape(-1, size)


class Search:
    """Centroids with what the bounds need: distances between them, each one's sorted neighbours, their last moves."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.at = centroids
        apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], dtype=np.float64).reshape(len(centroids), -1)
        apart = np.sqrt(apart)
        np.fill_diagonal(apart, -1.0)  # itself comes first
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.reach = np.take_along_axis(apart, self.order, axis=1)
        self.gap = self.reach[:, 1] * (1 - ROUNDING) if len(centroids) > 1 else np.full(len(centroids), np.inf)
        moves = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + ROUNDING)
        self.moves = moves
        ranked = np.argsort(-moves, kind="stable")
        # the largest move of any other centroid
        self.others = np.full(len(moves), moves[ranked[0]] if len(moves) else 0.0)
        if len(moves):
            self.others[ranked[0]] = moves[ranked[1]] if len(moves) > 1 else 0.0

    def squared(self, x: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        d = x.astype(np.int64) - self.at[j]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of each vector and its new bounds; own: the one before, -1 for none."""
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        old = own >= 0
        upper[old] = (upper[old] + self.moves[own[old]]) * (1 + ROUNDING)
        lower[old] = lower[old] - self.others[own[old]] - ROUNDING * (lower[old] + self.others[own[old]])
        open_ = ~old
        open_[old] = upper[old] >= np.maximum(lower[old], self.gap[own[old]] / 2)
        there = np.flatnonzero(open_ & old)
        exact = self.squared(x[there], own[there])
        upper[there] = np.sqrt(exact.astype(np.float64)) * (1 + ROUNDING)
        left = upper[there] >= np.maximum(lower[there], self.gap[own[there]] / 2)
        todo = np.concatenate([np.flatnonzero(~old), there[left]])
        if len(todo):
            self.scan(x, todo, own, upper, lower)
        return own, upper, lower

    def scan(self, x: np.ndarray, todo: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Looks at the centroids of each vector's ball and sets own, upper and lower."""
        start = np.maximum(own[todo], 0)
        within = np.full(len(todo), len(self.at))
        for c in np.unique(own[todo]):
            if c >= 0:
                mine = own[todo] == c
                radius = (2 * upper[todo[mine]] + self.reach[c, min(1, len(self.at) - 1)]) * (1 + ROUNDING)
                within[mine] = np.searchsorted(self.reach[c] * (1 - ROUNDING), radius, side="right")
        most = np.iinfo(np.int64).max
        best, which, second = np.full(len(todo), most), np.full(len(todo), len(self.at)), np.full(len(todo), most)
        for step in range(int(within.max(initial=0))):
            live = np.flatnonzero(within > step)
            j = self.order[start[live], step]
            d = self.squared(x[todo[live]], j)
            wins = (d < best[live]) | ((d == best[live]) & (j < which[live]))
            second[live] = np.where(wins, best[live], np.minimum(second[live], d))
            best[live], which[live] = np.where(wins, d, best[live]), np.where(wins, j, which[live])
        own[todo] = which
        upper[todo] = np.sqrt(best.astype(np.float64)) * (1 + ROUNDING)
        lower[todo] = np.where(second == most, FAR, np.sqrt(second.astype(np.float64)) * (1 - ROUNDING))


def assigned(state: DataFrame, search: Search, size: int) -> DataFrame:
    """The vectors with their centroid (own), the one before (was) and bounds."""
    told = {"own", "upper", "lower"} <= set(state.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PIECE):
                batch = whole.slice(k, PIECE)
                n = batch.num_rows
                was = batch.column("own").to_numpy() if told else np.full(n, -1, dtype=np.int32)
                upper, lower = (batch.column(c).to_numpy() if told else np.zeros(n) for c in ("upper", "lower"))
                own, upper, lower = search.nearest(matrix(batch.column("x"), size), was, upper, lower)
                columns = [batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "own", "was", "upper", "lower"])

    return state.mapInArrow(run, f"vec_id {dict(state.dtypes)['vec_id']}, x binary, own int, was int, upper double, lower double")


def changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to each one's sum and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, own, was = matrix(batch.column("x"), size), batch.column("own").to_numpy(), batch.column("was").to_numpy()
            for c in np.unique(np.concatenate([own, was[was >= 0]])):
                sums[c] += x[own == c].sum(axis=0, dtype=np.int64) - x[was == c].sum(axis=0, dtype=np.int64)
                counts[c] += (own == c).sum() - (was == c).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(sums.tolist(), type=pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = state.where("own != was").select("x", "own", "was").mapInArrow(run, "c int, n long, s array<long>")
    counted = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    sums, counts = np.zeros((k, size), dtype=object), np.zeros(k, dtype=object)
    for r in counted.collect():
        sums[r.c], counts[r.c] = [r[f"s{i}"] for i in range(size)], r.n
    return sums, counts


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", size: int = 64, note: Callable[[int], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """The vectors with their centroid `own`, after that many rounds and one more assignment; and the centroids.

    note: gets the number of each round that ran. The table of the result stays until release().
    """
    spark, held = vectors.sparkSession, []
    state = written(packed(vectors, size), held)
    centroids = first_centroids(state, k, salt, size)
    if not len(centroids):
        keep(held)
        return assigned(state, Search(np.zeros((1, size), dtype=np.int64)), size), centroids
    sums, counts = np.zeros((len(centroids), size), dtype=object), np.zeros(len(centroids), dtype=object)
    before = None
    for turn in range(rounds + 1):
        state = written(assigned(state, Search(centroids, before), size), held)
        drop(spark, held[:-1])
        del held[:-1]
        if note:
            note(turn)
        if turn == rounds:
            break
        more, n = changes(state, len(centroids), size)
        sums, counts = sums + more, counts + n
        before, centroids = centroids, np.array([[int(s) // int(m) for s in row] if m else c.tolist() for row, m, c in zip(sums, counts, centroids, strict=True)], dtype=np.int64)
        if (before == centroids).all():
            break
    keep(held)
    return state, centroids


def report(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    spark = vectors.sparkSession
    state, centroids = cluster(vectors, k, rounds, salt, size)
    search = Search(centroids) if len(centroids) else Search(np.zeros((1, size), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            d = search.squared(matrix(batch.column("x"), size), own)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(d)], names=["vec_id", "cluster", "distance"])

    told = state.select("vec_id", "x", "own").mapInArrow(run, f"vec_id {dict(state.dtypes)['vec_id']}, cluster int, distance long")
    sums = told.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    found = [(r.cluster, r.d, sum(x.d for x in sums), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    each = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
