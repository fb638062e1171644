"""Operator 10: token ids in Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned by id and encoded once.  Each task streams its ids, documents in
ascending id order and each closed by an end id, into one Arrow IPC file (the stream format
with a footer): record batches of ``batch_rows`` sequences, column ``ids``
fixed_size_list<uint16 or uint32>[seq_len] and column ``mask`` fixed_size_list<bool>[seq_len]
(true: a real token; only the end of a file is padded).  Batches are not compressed and, but for
a file's last, equally long, so a memory-mapped file gives any token, sequence or mask without
copying or decoding.  A file appears under its name only when complete, by rename, and every attempt
at a task has a name of its own, so nothing is ever replaced.  A table of (file, id, start in file,
number of tokens) is written beside the files; Spark keeps the rows of one attempt only, and these say which
files count.  A document's global start adds the tokens of all files before its own.

Defined results: a null or empty text is the end id alone; a null id sorts first; rows with one
id are ordered by a hash of their text; an empty table makes no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, spread_sql_conf, texts_of

#: A worker's caches are emptied at this many entries, so they are bounded whatever the corpus.
CACHE_PIECES = 700_000
#: The split pattern of vocabularies that drop white space, and what it comes to on lower-case ASCII.
SPACELESS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
_LATIN_SPLIT = regex.compile(SPACELESS_SPLIT).findall
#: Text below this needs no composing and lower-cases letter by letter.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_WORKER: dict = {}


class PieceEncoder:
    """Encodes texts by the tokenizers library, asking it once for each distinct pre-token.

    With a vocabulary that drops white space, spaces and line ends always end a pre-token and the
    normaliser joins nothing across them, so a text's ids are those of the pieces between them,
    and a piece's ids are those the library's model gives for the pre-tokens that the library's
    normaliser and pre-tokenizer make of it (pieces of Latin letters are lower-cased and split
    here by the same pattern).  Pieces and pre-tokens are remembered.  Other vocabularies get
    whole texts.
    """

    def __init__(self, spec: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        # strings of added tokens in a text are single ids to the library; texts that may hold one are left to it
        self.marks = tuple({t["content"][:2] for t in json.loads(spec).get("added_tokens", [])})
        self.apart = drops_spaces(spec) and all(m.lower() == m.upper() for m in self.marks)
        self.dtype, self.pieces, self.tokens = dtype, {}, {}

    def _pre_token(self, token: str) -> bytes:
        raw = self.tokens.get(token)
        if raw is None:
            width = self.dtype.itemsize
            self.tokens[token] = raw = b"".join([t.id.to_bytes(width, "little") for t in self.model.tokenize(token)])
        return raw

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        plain = piece.isprintable()  # controls are left to the library
        if plain and piece.isascii():
            return b"".join([self._pre_token(t) for t in _ASCII_SPLIT(piece.lower())])
        if plain and max(piece) < _LATIN_END:
            split = [t.encode().decode("latin-1").translate(_BYTE_LETTERS) for t in _LATIN_SPLIT(piece.lower())]
            return b"".join([self._pre_token(t) for t in split])
        split = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece))
        return b"".join([self._pre_token(t) for t, _ in split])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        if len(self.tokens) > CACHE_PIECES:
            self.tokens = {}
        self.model, self.normalizer, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        known, out = self.pieces, []
        for text in texts:
            if any([m in text for m in self.marks]):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            split = text.replace("\n", " ").split(" ")
            try:
                out.append(b"".join([known[p] for p in split]))
            except KeyError:
                for piece in set(split):
                    if piece not in known:
                        known[piece] = self._piece(piece)
                out.append(b"".join([known[p] for p in split]))
        return out


def drops_spaces(spec: str) -> bool:
    """Whether the vocabulary normalises by NFC, white space and case, and splits by the known pattern, dropping white space."""
    said = json.loads(spec)
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (said.get("normalizer") or {}).get("normalizers", [])]
    splits = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [p.get("type") for p in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": SPACELESS_SPLIT}, "Removed", True)
        and not (splits[1].get("add_prefix_space") or splits[1].get("use_regex"))
        and said["model"]["type"] == "BPE"
        and not said.get("post_processor")
    )


def _encoder(spec: str, dtype: np.dtype) -> PieceEncoder:
    key = zlib.crc32(spec.encode()), len(spec), dtype.str
    if key not in _WORKER:
        _WORKER[key] = PieceEncoder(spec, dtype)
    return _WORKER[key]


class _Writer:
    """Streams ids into one IPC file of full sequences, padding the last."""

    def __init__(self, uri: str, dtype: np.dtype, seq_len: int, batch_rows: int, pad_id: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.dtype, self.seq_len, self.step, self.pad_id = dtype, seq_len, seq_len * batch_rows, pad_id
        self.item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = self.fs.open_output_stream(self.partial)
        self.ipc = pa.ipc.new_file(self.out, self.schema)
        self.held, self.n_held, self.tokens = [], 0, 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.n_held += len(raw) // self.dtype.itemsize
        if self.n_held >= self.step:
            ids = np.frombuffer(b"".join(self.held), self.dtype)
            full = len(ids) // self.step * self.step
            for at in range(0, full, self.step):
                self._batch(ids[at : at + self.step], self.step)
            self.held, self.n_held = [ids[full:].tobytes()], len(ids) - full

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.ipc.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.tokens += real

    def close(self) -> None:
        if self.n_held:
            ids = np.frombuffer(b"".join(self.held), self.dtype)
            short = -len(ids) % self.seq_len
            self._batch(np.concatenate([ids, np.full(short, self.pad_id, self.dtype)]), len(ids))
        self.ipc.close()
        self.out.close()
        self.fs.move(self.partial, self.path)


def write_token_files(
    docs: DataFrame,
    tokenizer_file: str,
    out_uri: str | None = None,
    end_id: int = 1,
    pad_id: int = 0,
    seq_len: int = 2048,
    batch_rows: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files and their index; returns the index (part, file, id, at, n_tokens), reread from its table.

    ``out_uri`` is a folder of any file system that both Spark and pyarrow know (by default a new
    one in the shared folder).  Ids are two bytes wide where the vocabulary allows.
    """
    spark = docs.sparkSession
    out_uri = out_uri or new_path(spark, "token-files")
    with open(tokenizer_file, encoding="utf-8") as f:
        text_spec = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(text_spec).get_vocab_size(), end_id + 1, pad_id + 1)
    dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    spec = spark.sparkContext.broadcast(text_spec)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64("__text")]
    ranged = rows.repartitionByRange(spread_sql_conf(spark), *order).sortWithinPartitions(*order)
    end = dtype.type(end_id).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        writer, at = None, 0
        for whole in batches:
            for b in slices(whole, 256):
                writer = writer or _Writer(f"{out_uri}/{name}", dtype, seq_len, batch_rows, pad_id)
                starts, counts = [], []
                for raw in _encoder(spec.value, dtype).encode(texts_of(b.column(1))):
                    writer.add(raw + end)
                    starts.append(at)
                    counts.append(len(raw) // dtype.itemsize + 1)
                    at += counts[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(starts), pa.int32()), pa.array([name] * len(starts)), b.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                    names=["part", "file", id_col, "at", "n_tokens"],
                )
        if writer:
            writer.close()

    ranged.mapInArrow(write, f"part int, file string, `{id_col}` {id_type}, at long, n_tokens long").write.parquet(f"{out_uri}/index.parquet")
    index = spark.read.schema(f"part int, file string, `{id_col}` {id_type}, at long, n_tokens long").parquet(f"{out_uri}/index.parquet")
    return index.withColumn("file", F.concat(F.lit(f"{out_uri}/"), "file"))


class TokenFile:
    """Random access to one file: memory-mapped where it is local, ranged reads elsewhere."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.ipc = pa.ipc.open_file(self.source)
        field = self.ipc.schema.field("ids").type
        self.seq_len, self.dtype = field.list_size, np.dtype(field.value_type.to_pandas_dtype())
        self.step = self.ipc.get_batch(0).num_rows * self.seq_len if self.ipc.num_record_batches else 1
        self._kept: tuple[int, np.ndarray] | None = None

    def _values(self, k: int) -> np.ndarray:
        if self._kept is None or self._kept[0] != k:
            self._kept = (k, self.ipc.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self._kept[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of the i-th sequence."""
        k, row = divmod(i, self.step // self.seq_len)
        batch = self.ipc.get_batch(k)
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on; a view while they lie in one batch."""
        parts = []
        while count > 0:
            k, at = divmod(start, self.step)
            part = self._values(k)[at : at + count]
            if not len(part):
                raise ValueError("past the end of the file")
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, self.dtype), *parts])

    def close(self) -> None:
        self._kept = self.ipc = None
        self.source.close()


def _each_document(b: pa.RecordBatch, opened: dict) -> Iterator[np.ndarray]:
    for uri, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
        if uri not in opened:
            for other in list(opened):
                opened.pop(other).close()
            opened[uri] = TokenFile(uri)
        yield opened[uri].tokens(at, n)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before this one."""
    # one row per file: no more than shuffle partitions
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return index.join(F.broadcast(totals), "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def read_documents(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids array<int>) of every document, read back from the files."""
    id_type = index.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for whole in batches:
            for b in slices(whole, 256):
                ids = [x.astype(np.int32) for x in _each_document(b, opened)]
                yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "start", "ids"])

    return with_starts(index).select(id_col, "start", "file", "at", "n_tokens").mapInArrow(read, f"`{id_col}` {id_type}, start long, ids array<int>")


def read_digests(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, computed from what the files hold."""
    id_type = index.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for whole in batches:
            for b in slices(whole, 1024):
                sums, counts = [], []
                for ids in _each_document(b, opened):
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    counts.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col), b.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"]
                )

    return with_starts(index).select(id_col, "start", "file", "at", "n_tokens").mapInArrow(read, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def files_of(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(file, tokens): one row per file."""
    return index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
