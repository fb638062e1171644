"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Test items of at most ``SHORT`` shingles are looked up exactly: of m shingles at least k must be
shared, so one of any m - k + 1 is, and these few, the rarest among the items, are indexed.  Longer
items are partitioned by size (powers of two of their shingle counts).  For each size class
documents are searched in sliding windows just longer than the class, so that an item's Jaccard
similarity with the window that holds it stays high however long the document is; the number of
MinHash functions follows from the target recall at the worst such similarity.  A window is a
candidate for an item when they agree in any function.  Candidates are verified exactly: the
share of the item's shingles that occur anywhere in the whole document.

Documents are read where they lie, and nothing of them is shuffled.  Items are sent to the tasks in
blocks of about ``block_items`` distinct items (dealt by hash), one block at a time: each has a pass of
its own over the documents, after which it is given up, so neither driver nor task holds more than one.

Defined results: null or empty texts and items match nothing; an item of fewer than ``n`` words
matches only a document of the same words; repeated documents or items each give their rows;
empty tables give an empty table; null ids are kept; other columns pass or are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop_table, slices, texts_of, written
from .shingles import multipliers, shingle_hashes, shingle_set

#: Shingles in a block; windows begin at blocks.
BLOCK = 16
#: Shingles up to which items are looked up exactly.
SHORT = 16
MASK = np.uint64(0xFFFF)


def size_class(shingles: int) -> int:
    """Smallest power of two, ``BLOCK`` at least, that holds so many shingles."""
    return max(BLOCK, 1 << max(0, shingles - 1).bit_length())


def functions_needed(threshold: float, recall: float) -> int:
    """MinHash functions for which a window agrees with a just-contained item of its class at least once with ``recall``.

    The worst case of a class is its least item, of one shingle over half its size, in a window one block
    longer than the class; of all classes it is the least, as the block weighs most there.
    """
    size = 2 * SHORT
    least = size // 2 + 1
    worst = threshold * least / (size + BLOCK + (1 - threshold) * least)
    return math.ceil(math.log(1 - recall) / math.log(1 - worst))


def needed(size: int, threshold: float) -> int:
    """Shared shingles with which an item of ``size`` reaches the threshold."""
    return next((k for k in range(1, size + 1) if k / size >= threshold), size + 1)


class ItemIndex:
    """Rare shingles of the short items of a block, and MinHash values of the others by size class, with tables to find what shares one."""

    def __init__(self, sets: list[np.ndarray], count: int, threshold: float):
        self.sets = sets
        short = [i for i, s in enumerate(sets) if 0 < len(s) <= SHORT]
        often = Counter(h for i in short for h in sets[i].tolist())
        rare = [(h, i) for i in short for h in sorted(sets[i].tolist(), key=lambda h: (often[h], h))[: len(sets[i]) - needed(len(sets[i]), threshold) + 1]]
        rare.sort()
        self.rare, self.rare_items = np.array([h for h, _ in rare], dtype=np.uint64), np.array([i for _, i in rare], dtype=np.int64)
        self.rare_quick = np.zeros(int(MASK) + 1, dtype=bool)
        self.rare_quick[(self.rare >> np.uint64(48)) & MASK] = True
        self.a, self.b = multipliers(count, seed=11)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size in sorted({size_class(len(s)) for s in sets if len(s) > SHORT}):
            members = np.array([i for i, s in enumerate(sets) if len(s) > SHORT and size_class(len(s)) == size])
            lanes = []
            for k in range(count):
                values = np.array([(sets[i] * self.a[k] + self.b[k]).min() for i in members], dtype=np.uint64)
                order = np.argsort(values, kind="stable")
                quick = np.zeros(int(MASK) + 1, dtype=bool)
                quick[(values >> np.uint64(48)) & MASK] = True
                lanes.append((values[order], members[order], quick))
            self.classes[size] = lanes

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs in which a window and an item agree; documents are hashes in text order."""
        full = [(i, h) for i, h in enumerate(docs) if len(h)]
        if not full:
            return set()
        starts, owners, at = [], [], 0
        for i, h in full:
            own = np.arange(0, len(h), BLOCK)
            starts.append(own + at)
            owners.append(np.full(len(own), i))
            at += len(h)
        hashes, starts, owner = np.concatenate([h for _, h in full]), np.concatenate(starts), np.concatenate(owners)
        found: set[tuple[int, int]] = set()
        if len(self.rare):
            hit = np.nonzero(self.rare_quick[(hashes >> np.uint64(48)) & MASK])[0]
            left, right = (np.searchsorted(self.rare, hashes[hit], side) for side in ("left", "right"))
            whose = np.repeat([i for i, _ in full], [len(h) for _, h in full])[hit]
            for d, lo, hi in zip(whose[right > left], left[right > left], right[right > left], strict=True):
                found.update((int(d), int(m)) for m in self.rare_items[lo:hi])
        for k in range(len(self.a) if self.classes else 0):
            least = np.minimum.reduceat(hashes * self.a[k] + self.b[k], starts)
            width = 1
            for size, lanes in self.classes.items():  # ascending: each window starts from the shorter one's minimum
                while width < size // BLOCK + 1:
                    step = min(width, size // BLOCK + 1 - width)
                    if step < len(least):  # a window that runs into the next document only adds candidates
                        least[:-step] = np.minimum(least[:-step], least[step:])
                    width += step
                values, members, quick = lanes[k]
                hit = np.nonzero(quick[(least >> np.uint64(48)) & MASK])[0]
                if not len(hit):
                    continue
                left = np.searchsorted(values, least[hit], "left")
                right = np.searchsorted(values, least[hit], "right")
                for w, lo, hi in zip(hit[right > left], left[right > left], right[right > left], strict=True):
                    found.update((int(owner[w]), int(m)) for m in members[lo:hi])
        return found


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
    block_items: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item id, n_shared, n_item, containment) for every document that holds ``threshold`` of an item's shingles.

    Ids may be of any type; where both columns have one name the item's is called ``item_<name>``.
    """
    found = T.StructType([
        docs.schema[id_col],
        T.StructField(item_col if item_col != id_col else f"item_{item_col}", items.schema[item_col].dataType),
        *(T.StructField(c, T.LongType()) for c in ("n_shared", "n_item")),
        T.StructField("containment", T.DoubleType()),
    ])
    rows = bounded_batches(docs).select(id_col, text_col)
    out = None
    for block, last in _blocks(items, item_col, item_text_col, block_items):
        own = rows.mapInArrow(_search(block, n, threshold, recall, found.names), found)
        own = own if last else _freed(own, block)
        out = own if out is None else out.unionByName(own)
    return docs.sparkSession.createDataFrame([], found) if out is None else out


def uncontaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block_items: int = 20_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item.

    With one block of items rows are filtered where they lie.  With more, rows are numbered once in a written table; each
    block's pass writes the numbers of the rows it hits, and these rows are left out by one join.
    """
    rows, hits, tables = None, [], []
    for block, last in _blocks(items, item_col, item_text_col, block_items):
        if last and rows is None:
            return bounded_batches(docs).mapInArrow(_filter(block, n, threshold, recall, text_col), docs.schema)
        if rows is None:
            rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "contamination-rows")
        found = bounded_batches(rows.select(ROW, text_col)).mapInArrow(_hits(block, n, threshold, recall), f"{ROW} long")
        hits.append(written(found, "contamination"))
        block.destroy()
    if rows is None:
        return docs
    every = written(reduce(DataFrame.unionByName, hits).distinct(), "contamination-hits")
    for done in hits:
        drop_table(done)
    return rows.join(every, ROW, "left_anti").drop(ROW)


#: The number of a row while it is searched for several blocks of items.
ROW = "__contamination_row"


def _freed(found: DataFrame, block: Broadcast) -> DataFrame:
    """``found`` as a written table, after which its block of items is given up."""
    found = written(found, "contamination")
    block.destroy()
    return found


def _blocks(items: DataFrame, item_col: str, item_text_col: str, block_items: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of tables (id, text, copies) of about ``block_items`` items each, one made at a time, and whether it is the last."""
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).groupBy("id", "text").agg(F.count("*").alias("copies"))
    rows = written(rows, "contamination-items")
    blocks = math.ceil(rows.count() / block_items)
    try:
        for k in range(blocks):
            own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
            yield items.sparkSession.sparkContext.broadcast(own.toArrow().sort_by("text")), k == blocks - 1
    finally:  # every block that was asked for is on its way
        drop_table(rows)


_KEPT: dict = {}


def _index(block: Broadcast, key: tuple) -> tuple[pa.Table, ItemIndex]:
    """The block's items and their index, made once in a worker for all tasks of a query."""
    if key not in _KEPT:
        _KEPT.clear()
        _, n, threshold, recall = key
        items = block.value
        _KEPT[key] = items, ItemIndex([shingle_set(t, n) for t in items["text"].to_pylist()], functions_needed(threshold, recall), threshold)
    return _KEPT[key]


def _verified(texts: list[str], index: ItemIndex, n: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """(document, item, shared, size) of the candidates that hold."""
    hashes = [shingle_hashes(t, n) for t in texts]
    out = []
    for d, i in sorted(index.candidates(hashes)):
        shared, size = int(np.isin(index.sets[i], hashes[d]).sum()), len(index.sets[i])
        if shared / size >= threshold:
            out.append((d, i, shared, size))
    return out


def _search(block: Broadcast, n: int, threshold: float, recall: float, names: list[str]):
    key = (uuid.uuid4().hex, n, threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = _index(block, key)
        copies = items["copies"].to_pylist()
        for whole in batches:
            for b in slices(whole, 64):
                hits = [h for h in _verified(texts_of(b.column(1)), index, n, threshold) for _ in range(copies[h[1]])]
                docs, whose, shared, size = (pa.array([h[k] for h in hits], pa.int64()) for k in range(4))
                ids = items["id"].take(whose).combine_chunks()
                yield pa.RecordBatch.from_arrays([b.column(0).take(docs), ids, shared, size, pa.array([h[2] / h[3] for h in hits], pa.float64())], names=names)

    return run


def _filter(block: Broadcast, n: int, threshold: float, recall: float, text_col: str):
    key = (uuid.uuid4().hex, n, threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = _index(block, key)
        for whole in batches:
            for b in slices(whole, 64):
                hit = {h[0] for h in _verified(texts_of(b.column(b.schema.names.index(text_col))), index, n, threshold)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

    return run


def _hits(block: Broadcast, n: int, threshold: float, recall: float):
    key = (uuid.uuid4().hex, n, threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = _index(block, key)
        for whole in batches:
            for b in slices(whole, 64):
                hit = sorted({h[0] for h in _verified(texts_of(b.column(1)), index, n, threshold)})
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64()))], names=[ROW])

    return run
