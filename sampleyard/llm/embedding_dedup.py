"""Operator 4: near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label and length are compared by cosine.  Equal vectors become one class first.
Directions are rotated to the principal axes of a bounded sample (this only orders the work; any
rotation keeps products), classes are ranged by their first coordinate and cut into blocks of
bounded bytes.  Two blocks are compared only when their ranges come close enough on the first axis
(unit vectors of cosine t are at most sqrt(2 - 2t) apart) and the bound from their boxes in the
leading coordinates and their greatest suffix norms reaches the threshold; what is dropped so is
never shipped.  Neighbouring blocks form groups, and a block is shipped once for each group that it
meets.  Within a pair of blocks, tile by tile, leading coordinates are multiplied first; what the
rest can add is bounded by the product of the suffix norms, and tiles or pairs that cannot reach the
threshold are dropped before the next coordinates.  Survivors are computed again in double precision
from the original components, so rotation and rounding never decide.  A task returns link counts and
a spanning forest of the links, never the pairs; components come from the forests.

Where vectors have no preferred direction no bound on blocks can hold, and all blocks of a label
are compared: work then grows with the square of a label's distinct vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing and are kept; vectors of different lengths never
link; equal vectors link; components of any finite size count (they are scaled by powers of two,
which changes no cosine); null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, join_totals, spread_sql_conf, written
from .components import components

TILE = 256
LEADING = 16
#: Added to every bound, against rounding.
SLACK = 1e-6
#: Components in a block at most, and blocks in a group (a power of two): a task holds two groups.
BLOCK_VALUES = 131_072
GROUP = 8


def scaled(a: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by powers of two, exactly, so that no square over- or underflows."""
    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1])


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes (columns), the most varying first."""
    unit = scaled(sample)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, np.argsort(values)[::-1]]


def _axes(classes: DataFrame, limit: int) -> dict[int, np.ndarray]:
    """Axes by vector length, from at most about ``limit`` vectors."""
    by_length: dict[int, list] = {}
    total = classes.count()
    share = F.pmod(F.xxhash64("vector", F.lit("axes")), F.lit(1 << 30)) < int(min(1.0, limit / max(total, 1)) * (1 << 30))
    for r in classes.where(share).select("vector").toArrow().column("vector").to_pylist():  # classes have distinct vectors in a label
        by_length.setdefault(len(r), []).append(r)
    return {d: principal_axes(np.array(v, dtype=np.float64)) for d, v in sorted(by_length.items())}


def close_pairs(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of a and b with cosine >= threshold; ``same``: a is b, only i < j."""
    dim = ua.shape[1]
    cuts = [0, *range(LEADING, dim, LEADING), dim]
    tails_a, tails_b = (np.sqrt(np.maximum(0, np.cumsum((u * u)[:, ::-1], axis=1)[:, ::-1])) for u in (ua, ub))
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    found_i, found_j = [], []
    for x in range(0, len(ua), TILE):
        for y in range(x if same else 0, len(ub), TILE):
            ta, tb = ua[x : x + TILE], ub[y : y + TILE]
            product = np.zeros((len(ta), len(tb)))
            alive = None
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if alive is None or len(alive[0]) > product.size // 8:
                    product += ta[:, lo:hi] @ tb[:, lo:hi].T
                else:
                    product[alive] += np.einsum("ij,ij->i", ta[alive[0], lo:hi], tb[alive[1], lo:hi])
                if hi < dim:
                    bound = product + tails_a[x : x + TILE, hi][:, None] * tails_b[y : y + TILE, hi][None, :]
                else:
                    bound = product
                possible = bound >= threshold - SLACK
                if alive is not None:
                    was = np.zeros_like(possible)
                    was[alive] = True
                    possible &= was
                alive = np.nonzero(possible)
                if not len(alive[0]):
                    break
            i, j = alive[0] + x, alive[1] + y
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65536):
                pi, pj = i[at : at + 65536], j[at : at + 65536]
                exact = np.einsum("ij,ij->i", a[pi], b[pj]) / (norm_a[pi] * norm_b[pj]) >= threshold
                found_i.append(pi[exact])
                found_j.append(pj[exact])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def forest(i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """Least reachable node of each of ``count`` nodes by the edges (i, j)."""
    label = np.arange(count)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 2048, axes_sample: int = 4096) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    parts = spread_sql_conf(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # the key is given once, in a written table
    classes = written(
        rows.where("usable").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id()), "vector-classes"
    )
    axes = spark.sparkContext.broadcast(_axes(classes, axes_sample))
    label_type = rows.schema["label"].dataType.simpleString()

    def matrix(column: pa.Array, length: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)

    def rotated(a: np.ndarray) -> np.ndarray:
        """Unit vectors of scaled rows, on the axes."""
        unit = a / np.linalg.norm(a, axis=1, keepdims=True)
        known = axes.value.get(a.shape[1])
        return unit if known is None else unit @ known

    def first_coordinate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.names.index("vector"))
            lengths = np.array([len(v) for v in column], dtype=np.int64)
            at = np.zeros(len(lengths))
            for d in np.unique(lengths):
                own = np.nonzero(lengths == d)[0]
                at[own] = rotated(scaled(matrix(column.take(pa.array(own)), int(d))))[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int32()), pa.array(at)], names=[*b.schema.names, "dim", "at"])

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def block() -> pa.RecordBatch:
            label, dim = held[0][0], held[0][1]
            raw = scaled(np.array([r[5] for r in held], dtype=np.float64))
            unit = rotated(raw)
            lead = unit[:, :LEADING]
            rest = float(np.sqrt(np.square(unit[:, LEADING:]).sum(axis=1)).max())
            integers = [np.array([r[k] for r in held], np.int64).tobytes() for k in (3, 4)]
            values = [[label], [dim], [lead.min(axis=0)], [lead.max(axis=0)], [rest], [integers[0]], [integers[1]], [raw.tobytes()]]
            held.clear()
            floats = pa.list_(pa.float64())
            kinds = (kind, pa.int32(), floats, floats, pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["label", "dim", "lows", "highs", "rest", "keys", "weights", "raw"])

        kind = None
        for b in batches:
            kind = kind or b.schema.field("label").type
            for r in zip(*(b.column(c).to_pylist() for c in ("label", "dim", "at", "key", "weight", "vector")), strict=True):
                if held and (held[0][:2] != r[:2] or len(held) >= min(block_rows, max(1, BLOCK_VALUES // r[1]))):
                    yield block()
                held.append(r)
        if held:
            yield block()

    placed = classes.select("label", "key", "weight", "vector").mapInArrow(
        first_coordinate, f"label {label_type}, key long, weight long, vector {rows.schema['vector'].dataType.simpleString()}, dim int, at double"
    )
    order = ["label", "dim", "at"]
    blocks = written(
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(blocks_of, f"label {label_type}, dim int, lows array<double>, highs array<double>, rest double, keys binary, weights binary, raw binary")
        .withColumn("block", F.monotonically_increasing_id()),
        "vector-blocks",
    )

    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    cell = lambda x: F.floor(x / reach)
    meta = blocks.select("label", "dim", "block", "rest", "lows", "highs", F.col("lows")[0].alias("lo"), F.col("highs")[0].alias("hi"))
    left = meta.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") + reach)))).select("label", "dim", "cell", F.col("block").alias("i"), *(F.col(c).alias(f"l{c}") for c in ("lo", "hi", "lows", "highs", "rest")))
    right = meta.withColumn("cell", cell(F.col("lo"))).select("label", "dim", "cell", F.col("block").alias("j"), "lo", "lows", "highs", "rest")
    most = F.expr("aggregate(sequence(0, size(lows) - 1), 0D, (sum, k) -> sum + greatest(llows[k] * lows[k], llows[k] * highs[k], lhighs[k] * lows[k], lhighs[k] * highs[k])) + lrest * rest")
    pairs = (
        left.join(right, ["label", "dim", "cell"])
        .where((F.col("lo") <= F.col("lhi") + reach) & ((F.col("llo") < F.col("lo")) | ((F.col("llo") == F.col("lo")) & (F.col("i") <= F.col("j")))))
        .where(most >= threshold - SLACK)
        .select("i", "j", F.floor(F.col("i") / GROUP).alias("gi"), F.floor(F.col("j") / GROUP).alias("gj"))
    )
    shipped = (
        pairs.select("gi", "gj", F.col("i").alias("block"), F.col("j").alias("partner"))
        .unionByName(pairs.select("gi", "gj", F.col("j").alias("block"), F.lit(None).cast("long").alias("partner")))
        .groupBy("gi", "gj", "block")
        .agg(F.collect_list("partner").alias("partners"))  # at most GROUP
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def cell_links() -> Iterator[pa.RecordBatch]:
            unit = {k: rotated(raw) for k, (_, _, _, raw) in held.items()}
            for first, (partners, ki, wi, a) in held.items():
                for second in partners:
                    _, kj, wj, b = held[second]
                    i, j = close_pairs(a, b, unit[first], unit[second], threshold, first == second)
                    if first == second:
                        keys, weights = ki, wi
                    else:
                        keys, weights, j = np.concatenate([ki, kj]), np.concatenate([wi, wj]), j + len(ki)
                    links = np.bincount(i, weights[j], len(keys)) + np.bincount(j, weights[i], len(keys))
                    label = forest(i, j, len(keys))
                    own, moved = np.nonzero(links)[0], np.nonzero(label != np.arange(len(keys)))[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([keys[own], keys[moved]])),
                            pa.array(np.concatenate([keys[own], keys[label[moved]]])),
                            pa.array(np.concatenate([links[own].astype(np.int64), np.zeros(len(moved), np.int64)])),
                        ],
                        names=["a", "b", "links"],
                    )

        for b in batches:
            for gi, gj, block, partners, dim, keys, weights, raw in zip(*(b.column(c).to_pylist() for c in ("gi", "gj", "block", "partners", "dim", "keys", "weights", "raw")), strict=True):
                if (gi, gj) != at:
                    yield from cell_links()
                    at, held = (gi, gj), {}
                held[block] = (partners, np.frombuffer(keys, np.int64), np.frombuffer(weights, np.int64), np.frombuffer(raw, np.float64).reshape(-1, dim))
        yield from cell_links()

    compared = (
        shipped.join(bounded_batches(blocks).select("block", "dim", "keys", "weights", "raw"), "block")
        .repartition(parts, "gi", "gj")
        .sortWithinPartitions("gi", "gj")
        .mapInArrow(compare, "a long, b long, links long")
    )
    found = written(compared, "vector-links")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("key"), "links")
    grouped = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("group"))
    table = classes.select("key", "rep", "weight").join(links, "key", "left").join(grouped, "key", "left").withColumn("group", F.coalesce("group", "key"))
    table = written(table, "vector-grouped")
    firsts = table.groupBy("group").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    known = join_totals(table, firsts, "group", table.count()).select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = written(classes.select("label", "vector", "key", F.col("weight").alias("n")).join(known, "key").drop("key"), "vector-known")
    for done in (classes, blocks, found, grouped, table):
        drop_table(done)
    usables = rows.where("usable").select("id", "label", "vector")
    linked = join_totals(usables, known, ["label", "vector"], known.agg(F.sum("n")).first()[0] or 0).select("id", "n_links", F.coalesce("first", "id").alias("component_id"))
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
