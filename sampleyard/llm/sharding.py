"""Operator 9: reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers in (id, size, crc) order: a range shuffle of ids and digests only (no
text moves), positions inside each range, and the ranges' offsets from one count per range.  A
keyed Feistel network over the least even number of bits that covers the row count, walked
again while it lands outside the count, is a permutation of the numbers, so
``shard = permuted % shards`` and ``slot = permuted // shards`` can be computed for any row from
its number, and back, without a table.  The law is ``rows``: shard sizes differ by one at most.

Defined results: a null id sorts first; a null text has size 1 and the checksum of no bytes;
equal rows get neighbouring numbers and are placed like others; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, spread_sql_conf, written

ROUNDS = 4


def _half_bits(total: int) -> int:
    return max(1, (max(total - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[np.uint64]:
    return [mix64(np.array([seed * 1_000_003 + r + 1], dtype=np.uint64))[0] for r in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, total: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..total-1 at ``numbers`` (``back``: its inverse), by cycle walking."""
    bits, keys = _half_bits(total), _keys(seed)
    out = _network(numbers.astype(np.uint64), bits, keys, back)
    while (outside := out >= total).any():
        out[outside] = _network(out[outside], bits, keys, back)
    return out.astype(np.int64)


def place(numbers: np.ndarray, total: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of rows by their numbers."""
    moved = permute(numbers, total, seed)
    return moved % shards, moved // shards


def row_at(shard: np.ndarray, slot: np.ndarray, total: int, shards: int, seed: int) -> np.ndarray:
    """The row number that is in ``slot`` of ``shard``."""
    return permute(slot * shards + shard, total, seed, back=True)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number): gapless numbers from 0 in (id, size, crc) order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    # written once: range bounds come from a sample, so a second run could cut elsewhere
    ranged = written(
        rows.repartitionByRange(spread_sql_conf(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")),
        "row-numbers",
    )
    # one row per range, at most as many as there are shuffle partitions
    offsets = ranged.groupBy("__part").count().select(
        "__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before")
    )
    return ranged.join(F.broadcast(offsets), "__part").select(id_col, "size", "text_crc32", (F.col("__before") + F.col("__at")).alias("row_number"))


def assign(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot) for every row of ``docs``."""
    if shards < 1:
        raise ValueError("at least one shard")
    rows = numbered(docs, id_col, text_col)
    total = rows.agg(F.count("*")).first()[0]
    id_type = docs.schema[id_col].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot = place(b.column("row_number").to_numpy(), total, shards, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=[*b.schema.names, "shard", "slot"])

    return rows.mapInArrow(placed, f"`{id_col}` {id_type}, size long, text_crc32 long, row_number long, shard int, slot long")
