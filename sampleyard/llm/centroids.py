"""Operator 12: exact integer centroid clustering (k-means) with float32 screening.

Components become integers ``floor(scale * x)``.  In each round every task multiplies its vectors with the
centroids in float32, and each score ``|c|^2 - 2 x.c`` gets an interval that provably holds the exact
value: the products' rounding is bounded by ``gamma * |x| * |c|``.  A vector whose lowest interval overlaps no
other is assigned; the others' shortlisted distances are recomputed in exact integers, ties going to the lowest
number.  Sums per centroid are exact too: they travel as limbs of 32 bits, which Spark adds up, so the driver
gets ``centroids * dimensions`` sums a round whatever the number of vectors.

Components of 2**26 and more (scaled) leave float32 and 64-bit products; vectors that hold them are
decided in Python integers, and so are centroids for which a bound on norms does not already rule them out.

Defined results: a vector that is null, has another number of components, or holds a null or non-finite one
is left out; repeated rows each count and get a row; fewer vectors than centroids make fewer centroids, of equal
ones the lower number gets all; a null id hashes as the empty string; a distance, sum or inertia beyond 64 bits is null,
though the assignment is exact; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, written

#: Scaled components below this stay exact in float32 norms' bounds and in 64-bit squared distances (dimensions up to 256).
WIDE = 1 << 26
_LIMB = 32


@dataclass
class Centroids:
    """Integer centroids with what screening needs: their float32 forms, exact squared norms and error bounds."""

    rows: list[list[int]]

    def __post_init__(self):
        self.narrow = np.array([max(map(abs, c), default=0) < WIDE for c in self.rows], bool)
        held = [c if ok else [0] * len(c) for c, ok in zip(self.rows, self.narrow, strict=True)]
        self.ints = np.array(held, np.int64).reshape(len(held), len(held[0]) if held else 0)
        self.singles = self.ints.astype(np.float32)
        # below 2**60, so exact in int64 and within one part in 2**53 as doubles
        self.squares = (self.ints * self.ints).sum(axis=1).astype(np.float64)
        self.norms = np.sqrt(self.squares) * (1 + 1e-12)
        self.wide_norms = {j: float(min(isqrt(sum(x * x for x in self.rows[j])), 10**300)) for j in np.flatnonzero(~self.narrow).tolist()}

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid for integer vectors with components below WIDE."""
        n, dims = vectors.shape
        singles = vectors.astype(np.float32)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).astype(np.float64)) * (1 + 1e-12)
        # conversion of both sides and dims products and sums, each off by at most 2**-24 of its size, with room to spare
        gamma = (dims + 8) * 2.0**-24
        scores = self.squares - 2.0 * (singles @ self.singles.T).astype(np.float64)
        slack = 2.0 * gamma * norms[:, None] * self.norms + 2.0**-50 * (self.squares + np.abs(scores)) + 1e-6
        low, high = scores - slack, scores + slack
        low[:, ~self.narrow] = np.inf
        high[:, ~self.narrow] = np.inf
        best = high.min(axis=1)
        listed = low <= best[:, None]
        for j, norm in self.wide_norms.items():  # |x - c| is at least |c| - |x|
            gap = np.maximum(norm * (1 - 1e-9) - norms, 0)
            listed[:, j] = ~(gap * gap * (1 - 1e-9) - norms * norms > best) if self.narrow.any() else True
        number = listed.argmax(axis=1)
        for row in np.flatnonzero(listed[:, ~self.narrow].any(axis=1)).tolist():
            number[row] = exact_nearest(vectors[row].tolist(), self.rows, np.flatnonzero(listed[row]).tolist())[0]
            listed[row] = False
        unsure = np.flatnonzero(listed.sum(axis=1) > 1)
        if len(unsure):
            least = np.full(len(unsure), np.iinfo(np.int64).max)
            for j in np.flatnonzero(self.narrow).tolist():
                own = np.flatnonzero(listed[unsure, j])
                off = vectors[unsure[own]] - self.ints[j]
                exact = np.einsum("ij,ij->i", off, off)
                closer = exact < least[own]  # strictly: of equal ones the lowest number stays
                least[own[closer]] = exact[closer]
                number[unsure[own[closer]]] = j
        off = vectors - self.ints[number]
        distance = np.einsum("ij,ij->i", off, off)
        return number, distance


def exact_nearest(vector: list[int], centroids: list[list[int]], among: list[int] | None = None) -> tuple[int, int]:
    """(number, squared distance) in Python integers, of any size; lowest number on ties."""
    numbers = range(len(centroids)) if among is None else among
    distance, number = min((sum((x - c) ** 2 for x, c in zip(vector, centroids[j], strict=True)), j) for j in numbers)
    return number, distance


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(indices and int64 rows of vectors below WIDE, then indices and Python integer rows of the wide ones) of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    wide = (np.abs(scaled) >= WIDE).any(axis=1)
    rows = [[_floor(float(x), scale) for x in row] for row in values[wide]]
    return np.flatnonzero(~wide), scaled[~wide].astype(np.int64), np.flatnonzero(wide), rows


def _floor(x: float, scale: int) -> int:
    """floor(scale * x) without rounding."""
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def usable(vectors: DataFrame, dims: int, vector_col: str) -> DataFrame:
    """Rows whose vector has ``dims`` components, none null or non-finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite)


def _limbs(number: int, key: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(cluster, dimension, limb, value) whose values times 2**(32 * limb) add up to ``number``."""
    sign, left, at = (1 if number >= 0 else -1), abs(number), 0
    while left:
        yield (*key, at, sign * (left & ((1 << _LIMB) - 1)))
        left, at = left >> _LIMB, at + 1


def first_centroids(kept: DataFrame, count: int, seed: int, scale: int, id_col: str, vector_col: str) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:id``, in that order; of rows with one id the lesser vector comes first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("digest"), F.col(vector_col).alias("vector")).orderBy("digest", "vector").limit(count).collect()
    return [[_floor(float(x), scale) for x in r["vector"]] for r in rows]


def update(kept: DataFrame, centroids: Centroids, dims: int, scale: int, vector_col: str) -> Centroids:
    """Centroids of one round: the floor of each cluster's mean; an empty cluster keeps its own."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.rows)
        counts, sums = [0] * k, [[0] * dims for _ in range(k)]
        for b in batches:
            _, rows, _, wide = integers(b.column(0), dims, scale)
            if len(rows):
                number, _ = centroids.nearest(rows)
                order = np.argsort(number, kind="stable")
                present, starts = np.unique(number[order], return_index=True)
                added = np.add.reduceat(rows[order], starts, axis=0).tolist()
                for j, more, n in zip(present.tolist(), added, np.bincount(number)[present].tolist(), strict=True):
                    counts[j] += n
                    sums[j] = [a + x for a, x in zip(sums[j], more, strict=True)]
            for row in wide:
                j, _ = exact_nearest(row, centroids.rows)
                counts[j] += 1
                sums[j] = [a + x for a, x in zip(sums[j], row, strict=True)]
        limbs = [x for j in range(k) for d, s in enumerate([*sums[j], counts[j]]) for x in _limbs(s, (j, d))]
        columns = zip(*limbs, strict=True) if limbs else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "dim", "limb", "value"])

    found = kept.select(vector_col).mapInArrow(partial, "cluster int, dim int, limb int, value long").groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect()
    totals: dict[tuple[int, int], int] = {}
    for r in found:
        key = (r["cluster"], r["dim"])
        totals[key] = totals.get(key, 0) + (r["value"] << (_LIMB * r["limb"]))
    return Centroids([[totals.get((j, d), 0) // n for d in range(dims)] if (n := totals.get((j, dims), 0)) else c for j, c in enumerate(centroids.rows)])


def assigned(kept: DataFrame, centroids: Centroids, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, cluster, distance) of every kept vector."""
    id_type, most = kept.schema[id_col].dataType.simpleString(), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, wide_at, wide = integers(b.column(1), dims, scale)
            clusters, distances = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            if len(rows):
                clusters[at], distances[at] = centroids.nearest(rows)
            # a narrow vector whose nearest centroid is wide has its distance in Python integers as well
            again = [*zip(wide_at.tolist(), wide, strict=True), *((i, r.tolist()) for i, r in zip(at, rows, strict=True) if not centroids.narrow[clusters[i]])]
            over = np.zeros(b.num_rows, bool)
            for i, row in again:
                clusters[i], exact = exact_nearest(row, centroids.rows)
                over[i] = exact > most
                distances[i] = 0 if over[i] else exact
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clusters), pa.array(distances, mask=over)], names=[id_col, "cluster", "distance"])

    return kept.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {id_type}, cluster int, distance long")


def cluster(
    vectors: DataFrame, count: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector after ``rounds`` rounds."""
    if not 1 <= dims <= 256:
        raise ValueError("between 1 and 256 dimensions")
    spark = vectors.sparkSession
    kept = bounded_batches(written(usable(vectors.select(id_col, vector_col), dims, vector_col), "vectors"), 8192, "8m")
    centroids = Centroids(first_centroids(kept, count, seed, scale, id_col, vector_col))
    if centroids.rows:
        for _ in range(rounds):
            centroids = update(kept, centroids, dims, scale, vector_col)
    placed = written(assigned(kept, centroids, dims, scale, id_col, vector_col), "assigned")
    drop_table(kept)

    def total(value: str, n: str) -> F.Column:
        """A sum in 64 bits, null beyond them or where a part is null."""
        return F.expr(f"CASE WHEN count({value}) = {n} THEN try_cast(sum(CAST({value} AS DECIMAL(38, 0))) AS LONG) END")

    by_cluster = placed.groupBy("cluster").agg(total("distance", "count(*)").alias("cluster_inertia")).collect()  # one row a centroid
    inertias = {r["cluster"]: r["cluster_inertia"] for r in by_cluster}
    whole = None if None in inertias.values() else sum(inertias.values())
    whole = whole if whole is not None and whole < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.rows]
    stats = spark.createDataFrame([(j, inertias.get(j), whole, d) for j, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(stats), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
