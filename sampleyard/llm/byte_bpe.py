"""Operator 2: byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text of up to ``chunk_chars`` characters is encoded where it is.  A longer text is cut into
chunks that overlap; chunks are dealt over all tasks and pre-tokenised there.  Two neighbouring
chunks agree from the first position in their overlap that both have as a pre-token boundary
(the pattern looks at nothing before a boundary), so the text is cut there and each piece, from
cut to cut, is encoded by itself.  Where no common boundary lies in an overlap (one pre-token is
longer than it), the rest of that text from the last certain cut on is encoded as one piece, so
the result is always that of encoding the whole text.  Decoding concatenates the tokens' bytes.

Defined results: a null or empty text has no ids; repeated rows each get a result; an empty
table gives an empty table; a null id is kept; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of

#: Boundaries this close to a chunk's end may still move with the text behind it: the pattern
#: looks one character past a token, and a contraction takes up to three characters.
LOOKAHEAD = 3

_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The worker's encoder, built once for each vocabulary and pattern."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})
    return _ENCODINGS[key]


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of pre-tokens that no text behind ``text`` can move; with ``last``, all of them and the end."""
    ends = [m.end() for m in pattern.finditer(text)]
    sure = len(text) if last else len(text) - LOOKAHEAD
    return [0, *(e for e in ends if e <= sure)]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    """A list column from Python lists, by way of one flat array."""
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _id_batch(key_columns: list[pa.Array], names: list[str], ids: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*key_columns, _lists(ids)], names=[*names, "ids"])


def encode(
    docs: DataFrame,
    ranks_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 16_384,
    overlap_chars: int = 256,
) -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``; ids as the tiktoken library gives for the whole text."""
    if overlap_chars <= LOOKAHEAD or chunk_chars <= overlap_chars:
        raise ValueError("an overlap must be longer than the lookahead, and a chunk longer than its overlap")
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:  # on the driver; the tasks get its bytes
        vocabulary = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def encode_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary.value, pattern)
        for whole in batches:
            for b in slices(whole, 256):
                names = b.schema.names[:-1]
                yield _id_batch(b.columns[:-1], names, [enc.encode_ordinary(t) for t in texts_of(b.column(len(names)))])

    short = bounded_batches(rows).where(F.length("__text") <= chunk_chars).mapInArrow(encode_text, f"`{id_col}` {id_type}, ids array<int>")

    long = rows.where(F.length("__text") > chunk_chars).withColumn("__key", F.unhex(F.sha2("__text", 256)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 16):
                out: list[tuple] = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    starts = range(0, len(text), chunk_chars)
                    out += [(key, k, k == len(starts) - 1, text[s : s + chunk_chars + overlap_chars]) for k, s in enumerate(starts)]
                for at in range(0, len(out), 64):
                    columns = zip(*out[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                        names=["key", "k", "last", "chunk"],
                    )

    chunks = (
        long.select("__key", "__text")
        .mapInArrow(cut, "key binary, k int, last boolean, chunk string")
        .groupBy("key", "k")  # deals the chunks out; equal texts have equal chunks
        .agg(F.first("last").alias("last"), F.first("chunk").alias("chunk"))
    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for whole in batches:
            for b in slices(whole, 64):
                heads, tails = [], []
                for k, last, text in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    found, base = boundaries(text, compiled, last), k * chunk_chars
                    heads.append([base + p for p in found if p < overlap_chars])
                    tails.append([base + p for p in found if p >= chunk_chars])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))], names=["key", "k", "head", "tail"]
                )

    marks = chunks.mapInArrow(pretokenise, "key binary, k int, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("key").orderBy("k")
    met = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        marks.select("key", "k", met.alias("to"), F.lead("k").over(order).isNull().alias("end"))
        # of the chunks before this one, the first that did not meet its neighbour
        .withColumn("lost", F.min(F.when(F.col("to").isNull() & ~F.col("end"), F.col("k"))).over(so_far))
        .select(
            F.col("key").alias("ckey"),
            F.col("k").alias("ck"),
            F.coalesce("lost", "k").alias("piece"),
            F.coalesce(F.lag("to").over(order), F.lit(0)).alias("from"),
            "to",
            (F.col("lost").isNotNull() | (F.col("to").isNull() & ~F.col("end"))).alias("merged"),
        )
    )
    pieces = chunks.join(cuts, (F.col("key") == F.col("ckey")) & (F.col("k") == F.col("ck")))
    base = F.col("k").cast("long") * chunk_chars
    own = F.when(F.col("piece") == F.col("k"), F.col("from")).otherwise(base)
    apart = pieces.where(~F.col("merged")).select(
        "key",
        "piece",
        F.substring("chunk", (own - base + 1).cast("int"), (F.coalesce("to", base + F.length("chunk")) - own).cast("int")).alias("__text"),
    )
    joined = (
        pieces.where("merged")
        .select("key", "piece", "k", F.substring("chunk", (own - base + 1).cast("int"), F.when(F.col("last"), F.length("chunk")).otherwise((base + chunk_chars - own).cast("int"))).alias("part"))
        .groupBy("key", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select("key", "piece", F.array_join(F.col("parts.part"), "").alias("__text"))
    )
    by_text = (
        apart.unionByName(joined)
        .mapInArrow(encode_text, "key binary, piece int, ids array<int>")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
        .select("key", F.flatten("parts.ids").alias("ids"))
    )
    of_long = long.select(F.col(id_col), F.col("__key").alias("key")).join(by_text, "key").select(id_col, "ids")
    return short.unionByName(of_long)


def decode(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the tokens' bytes one after the other; null ids count as none."""
    spark = encoded.sparkSession
    with open(ranks_file, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    id_type = encoded.schema[id_col].dataType.simpleString()

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in parse_ranks(vocabulary.value).items()}.__getitem__
        for whole in batches:
            for b in slices(whole, 256):
                lists = b.column(1)
                flat = lists.flatten().to_numpy().tolist()  # null lists add nothing
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()]).tolist()
                texts = [b"".join(map(token, flat[a:z])) for a, z in pairwise(ends)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(join_bytes, f"`{id_col}` {id_type}, ids array<int>, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Counts and hashes by which two encodings compare without shipping them, and the columns of ``keep``."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(keep or []),
    )
