"""Operator 3: self-join of documents by the Jaccard similarity of their word n-gram sets.

1. Every document is profiled where it lies: shingle set, its hash (documents with equal sets
   form a class), and MinHash values folded into bands.  Bands and rows are chosen for a target
   recall at the threshold.  The profile table has no texts and no sets.
2. Classes meet by band hash.  A bucket is never gathered: it is reduced to its least member (its
   leader), combined before the shuffle, and each member is paired with the leader.  A group of
   near copies falls into many buckets but has few leaders, so it is examined a few times instead
   of once per band.  All pairs of a bucket lie in its leader's star.
3. Stars are cut into chunks by a hash, and each pair of chunks is a cell, so that no task gets
   more than two chunks; full n-gram sets are rebuilt for the classes in stars only.  A task
   counts the intersections of all pairs in a cell by matrix products over their common shingles,
   and returns each class' link count and a spanning forest of the links, never the pairs.  A pair
   is counted in the star of the least leader that both have.
4. Connected components over the forests give every class its group.

Defined results: a text without words (null, empty) links with nothing and is its own class;
texts of fewer than ``n`` words have one shingle, all their words; repeated rows are copies and
link with each other; null ids are kept (a group's id is its least non-null id); of each group one
row stays, also where ids are null or repeated; an empty table gives an empty table; other columns
pass or are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, bounded_batches, drop_table, join_totals, mix64, slices, spread_sql_conf, texts_of, written, written_with
from .components import components
from .shingles import minhash, multipliers, shingle_set

#: Most classes and shingles (on average) in a chunk; a cell has two chunks.  A star's sets are shipped
#: once for each of its chunks, so chunks are as large as a task can hold with ease.
CHUNK_CLASSES = 1024
CHUNK_SHINGLES = 1_000_000
#: Classes whose pairs are counted at once within a cell.
TILE = 128
#: Columns of the 0/1 matrices multiplied at once.
STRIPE = 4096


def banding(threshold: float, recall: float, low: float = 0.3, noise: float = 0.15) -> tuple[int, int]:
    """(bands, rows): the fewest rows for which pairs at ``low`` meet at most at ``noise``, with bands enough for ``recall`` at the threshold."""
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if 1 - (1 - low**rows) ** bands <= noise:
            break
    return bands, rows


def set_key(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def profile(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, key, n_shingles, bands array<long>); without words: key null, no bands."""
    id_type = docs.schema[id_col].dataType.simpleString()
    a, b = multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for whole in batches:
            for batch in slices(whole, 128):
                sets = [shingle_set(t, n) for t in texts_of(batch.column(1))]
                sizes = np.array([len(s) for s in sets])
                full = np.nonzero(sizes)[0]
                folded: list = [[] for _ in sets]
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    values = minhash(np.concatenate([sets[i] for i in full]), starts, a, b)
                    h = np.zeros((len(full), bands), dtype=np.uint64) + lane
                    for r in range(rows):
                        h = mix64(h ^ mix64(values[:, r::rows]))
                    for i, row in zip(full, h.view(np.int64), strict=True):
                        folded[i] = row
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(folded, pa.list_(pa.int64()))],
                    names=[id_col, "key", "n_shingles", "bands"],
                )

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, key long, n_shingles int, bands array<long>")


def _stars(classes: DataFrame, total: int) -> DataFrame:
    """Distinct (leader, key) over all buckets of two classes or more; a leader is in its own star."""
    banded = classes.select("key", F.explode("bands").alias("bucket"))
    led = banded.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return join_totals(banded, led, "bucket", total).select("leader", "key").distinct()


def _repeated(profiled: DataFrame, id_col: str) -> DataFrame:
    """(__id, __n) of the ids that several rows have, and of null ids."""
    return profiled.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1 or __id is null")


def _not_often(docs: DataFrame, repeated: DataFrame, total: int, id_col: str) -> DataFrame:
    """``docs`` without the rows of the (at most ``HOT``) ids that very many of the ``total`` repeated rows have: they would meet in one task for nothing."""
    often = repeated.where("__id is not null").where(F.col("__n") > total / HOT)
    return docs.join(F.broadcast(often), docs[id_col] == often["__id"], "left_anti") if total else docs


def _keyed(docs: DataFrame, repeated: DataFrame, total: int, id_col: str, text_col: str, n: int) -> DataFrame:
    """The rows of ``docs`` with null or repeated ids, and their set's hash as ``__key``: ids do not tell these apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                found = (shingle_set(t, n) for t in texts_of(b.column(b.schema.names.index(text_col))))
                keys = pa.array([set_key(s) if len(s) else None for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "__key"])

    rows = docs.where(F.col(id_col).isNull())
    if total:
        again = repeated.where("__id is not null")
        met = join_totals(docs, again.withColumnRenamed("__id", id_col), id_col, total, "__n")
        rows = rows.unionByName(met.select(*docs.columns))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__key", T.LongType())]))


def _sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, again: Row, id_col: str, text_col: str, n: int) -> DataFrame:
    """(key, shingles binary) of the wanted (rep, key): each is rebuilt from the text of one row of its class.

    Where only one row has the id it is found by the id, and else by the set's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                keys, out = [], []
                for key, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    found = shingle_set(text, n)
                    if len(found) and set_key(found) == key:
                        keys.append(key)
                        out.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["key", "shingles"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > 0)
    plain = wanted
    if again["ids"]:
        # a class has one row here, so an id has at most its distinct texts
        plain = wanted.join(repeated, F.col("rep").eqNullSafe(F.col("__id")), "left_anti")
    # ``wanted`` grows with the corpus: one plan at every size
    found = _not_often(rows, repeated, again["rows"], "__id").join(plain.hint("merge"), F.col("__id") == F.col("rep")).select("key", "__text")
    if plain is not wanted:
        others = wanted.join(repeated, F.col("rep").eqNullSafe(F.col("__id")), "left_semi").select("key")
        keyed = _keyed(rows, repeated, again["rows"], "__id", "__text", n).where("__key is not null").groupBy("__key").agg(F.min("__text").alias("__text"))
        found = found.unionByName(keyed.join(others.hint("merge"), F.col("__key") == F.col("key")).select("key", "__text"))
    return found.mapInArrow(run, "key long, shingles binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over values that two sets or more have."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    owner, column = owner[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(shared.sum())
    for at in range(0, width, STRIPE):
        lo, hi = np.searchsorted(column, [at, at + STRIPE])
        m = np.zeros((len(sets), min(STRIPE, width - at)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least reachable index of each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _linked(sets: list[np.ndarray], lesser: list[np.ndarray], sides: np.ndarray, threshold: float, diagonal: bool) -> np.ndarray:
    """Which pairs of a cell reach the threshold and have no lesser common leader, tile by tile."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    linked = np.zeros((count, count), dtype=bool)
    tiles = [np.arange(at, min(at + TILE, count)) for at in range(0, count, TILE)]
    for x, rows in enumerate(tiles):
        for columns in tiles[x:]:
            if not diagonal and len(np.unique(sides[np.concatenate([rows, columns])])) == 1:
                continue
            both = rows if columns is rows else np.concatenate([rows, columns])
            if len(both) == 2:
                shared = float(np.isin(sets[both[0]], sets[both[1]], assume_unique=True).sum())
                common = np.array([[0.0, shared], [shared, 0.0]])
            else:
                common = common_counts([sets[i] for i in both])
            own = common / (sizes[both][:, None] + sizes[both][None, :] - common) >= threshold
            np.fill_diagonal(own, False)
            if not diagonal:
                own &= sides[both][:, None] != sides[both][None, :]
            if own.any() and any(len(lesser[i]) for i in both):
                own &= common_counts([lesser[i] for i in both]) == 0
            if own.any():
                linked[np.ix_(both, both)] |= own
    return linked


def examine(leader: int, keys: np.ndarray, sides: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], leaders: list[np.ndarray], threshold: float, diagonal: bool) -> list[tuple[int, int, int]]:
    """Rows (a, b, links) of one cell: (key, key, rows linked) for linked classes, (a, b, 0) for forest edges."""
    lesser = [x[x < leader] for x in leaders]  # a pair with a lesser common leader counts there
    linked = _linked(sets, lesser, sides, threshold, diagonal)
    if not linked.any():
        return []
    links = linked @ weights
    label = _forest(linked)
    out = [(int(k), int(k), int(c)) for k, c in zip(keys, links, strict=True) if c]
    return out + [(int(keys[i]), int(keys[r]), 0) for i, r in enumerate(label) if i != r]


def _verify(cells: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """(a, b, links) from rows (leader, i, j, side, key, weight, leaders, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        at = None
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(held) > 1:
                leader, i, j = at
                side, weight, leaders, raw = zip(*held.values(), strict=True)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
                out.extend(examine(leader, np.array(list(held)), np.array(side), np.array(weight), sets, [np.array(x) for x in leaders], threshold, i == j))

        def flush() -> pa.RecordBatch:
            a, b, links = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], names=["a", "b", "links"])

        for whole in batches:
            for batch in slices(whole, 512):
                for leader, i, j, side, key, weight, leaders, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (leader, i, j) != at:
                        close()
                        at, held = (leader, i, j), {}
                    held[key] = (side, weight, leaders, raw)
                yield flush()
        close()
        yield flush()

    return (
        cells.select("leader", "i", "j", "side", "key", "weight", "leaders", "shingles")
        .repartition(partitions, "leader", "i", "j")
        .sortWithinPartitions("leader", "i", "j", "side")
        .mapInArrow(run, "a long, b long, links long")
    )


def _groups(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, int, DataFrame, DataFrame, Row]:
    """(profile table, its rows, class table, repeated ids, their number ``ids`` and ``rows`` of those that are not null): the profile has a row number; the class table is (key, rep, rep_row, weight, group, group_id, group_key, group_row, class_links).

    ``group_row`` is the row that stays, ``group_key`` its class: of the group's least id, then the least class and row.
    """
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall)
    every = F.count("*").alias("n")
    profiled, of_profiles = written_with(profile(docs, id_col, text_col, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "ngram-profiles", every)
    met = F.coalesce(F.sum(F.when(F.col("__id").isNotNull(), F.col("__n"))), F.lit(0)).alias("rows")
    repeated, again = written_with(_repeated(profiled, id_col), "ngram-repeated", F.count("*").alias("ids"), met)
    head = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "row")).alias("head")
    classes, of_classes = written_with(
        profiled.where("key is not null").groupBy("key").agg(head, F.count("*").alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("key", F.col("head.id").alias("rep"), F.col("head.row").alias("rep_row"), "weight", "n_shingles", "bands"),
        "ngram-classes", every,
    )
    distinct = of_classes["n"]
    stars, of_stars = written_with(_stars(classes, distinct * bands), "ngram-stars", every)
    about = classes.select("key", "rep", "rep_row", "weight", "n_shingles")
    members = written(stars.groupBy("key").agg(F.collect_list("leader").alias("leaders")).join(about, "key"), "ngram-members")  # at most `bands` leaders each
    sets = _sets(docs, members.select("key", "rep"), repeated, again, id_col, text_col, n)
    sized = stars.join(members.select("key", "n_shingles"), "key").groupBy("leader").agg(
        F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / CHUNK_CLASSES), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("m")
    )
    chunk = F.pmod(F.xxhash64("key", "leader"), F.col("m")).cast("int")
    cells = (
        join_totals(stars, sized, "leader", of_stars["n"])
        .withColumn("side", chunk)
        .withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
        .select("leader", "key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
        .join(members.select("key", "weight", "leaders"), "key")
        .join(sets, "key")
    )
    found = written(_verify(cells, threshold, spread_sql_conf(spark)), "ngram-links")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("key"), "links")
    grouped = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("group"))
    table = about.join(links, "key", "left").join(grouped, "key", "left").select("key", "rep", "rep_row", "weight", F.coalesce("group", "key").alias("group"), F.coalesce("links", F.lit(0)).alias("class_links"))
    table = written(table, "ngram-grouped")
    drop_table(grouped)
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "key", "rep_row")).alias("first")
    firsts = table.groupBy("group").agg(first, F.count("*").alias("n")).select("group", F.col("first.rep").alias("group_id"), F.col("first.key").alias("group_key"), F.col("first.rep_row").alias("group_row"), "n")
    groups = written(join_totals(table, firsts, "group", distinct), "ngram-groups")
    for done in (stars, members, found, table, classes):
        drop_table(done)
    return profiled, of_profiles["n"], groups, repeated, again


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, class_id, n_links, kept, n_shingles).

    ``n_links`` counts the other rows whose n-gram sets have Jaccard similarity ``threshold`` or more
    with this row's; ``class_id`` is the least id reachable by links; ``kept`` marks one row of that id.
    """
    profiled, total, table, _, _ = _groups(docs, id_col, text_col, n, threshold, recall)
    worded = join_totals(profiled.where("key is not null"), table.withColumn("n", F.col("weight")), "key", total)
    worded = worded.select(F.col(id_col), F.col("group_id").alias("class_id"), (F.col("class_links") + F.col("weight") - 1).alias("n_links"), (F.col("row") == F.col("group_row")).alias("kept"), "n_shingles")
    bare = profiled.where("key is null").select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "n_shingles")
    return worded.select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"), "n_links", "kept", "n_shingles").unionByName(bare)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group: a row of least id (of several such rows, one).

    Rows without words are groups of their own and all stay.
    """
    profiled, _, table, repeated, again = _groups(docs, id_col, text_col, n, threshold, recall)
    heads = written(table.where("key = group_key").select(F.col("key").alias("__head"), F.col("group_id").alias("__id")), "ngram-heads")
    bare = profiled.where("key is null").select(F.lit(None).cast("long").alias("__head"), F.col(id_col).alias("__id"))
    own = heads.unionByName(bare)
    if not again["ids"]:
        return docs.join(own.hint("merge"), docs[id_col] == own["__id"]).select(*[docs[c] for c in docs.columns])
    own = own.join(repeated.select(F.col("__id").alias("__again")), F.col("__id").eqNullSafe(F.col("__again")), "left_anti")
    rows = _not_often(docs, repeated, again["rows"], id_col)
    single = rows.join(own.hint("merge"), rows[id_col] == own["__id"]).select(*[rows[c] for c in docs.columns])
    keyed = _keyed(docs, repeated, again["rows"], id_col, text_col, n)
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias("__row")
    met = keyed.where("__key is not null").groupBy("__key", F.col(id_col).alias("__own")).agg(one)
    met = met.join(heads.hint("merge"), (F.col("__key") == F.col("__head")) & F.col("__own").eqNullSafe(F.col("__id"))).select("__row.*")
    return single.unionByName(met).unionByName(keyed.where("__key is null").select(*docs.columns))
