"""Operator 11: SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text's symbols are its characters, after a white-space mark is put before it and in place of every
space.  An agenda holds each adjacent pair of symbols whose joined text is a piece, best score first and
leftmost first among equals; the best pair is joined, its neighbours' new pairs enter, and outdated
entries are passed over, until none is left.  A character that is no piece becomes its bytes' pieces.

No join can cross two characters that stand side by side in no piece.  So a text is cut before
each mark that follows another character (no piece has one inside), each such segment where its
character pairs allow it, and every distinct part goes through the agenda once in a worker's cache.
The segments that a batch adds to the cache are given to the sentencepiece library too, all of a
batch in one call, and must come out alike.  Decoding is the library's.

Defined results: a null or empty text has the begin and end ids alone and decodes to an empty text;
repeated rows each get a result; a null id is kept; an empty table gives an empty table; other columns
are ignored.  Models with other normalisers, without byte fallback or with user-defined pieces are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of

#: What the library writes for a space.
MARK = "▁"
#: A worker's caches are emptied at this many entries, so they are bounded whatever the corpus.
CACHE_SEGMENTS = 600_000

#: Parts of so many characters at most have their agenda in a list, which is quicker than a heap where it is short.
SHORT = 24
#: The rank of a pair that is no piece.
NONE = 1 << 40

_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*").findall
_WORKER: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces and scores of one model, the library's processor, and what this worker has encoded so far."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        said = sentencepiece_model_pb2.ModelProto()
        said.ParseFromString(raw)
        kind = said.SentencePiece
        plain = not said.normalizer_spec.precompiled_charsmap and said.normalizer_spec.add_dummy_prefix and not said.normalizer_spec.remove_extra_whitespaces
        if said.trainer_spec.model_type != said.trainer_spec.BPE or not plain or not said.trainer_spec.byte_fallback or said.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte fallback, a leading space mark and no normalisation is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in said.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.library = SentencePieceProcessor(model_proto=raw)
        normal = {p.piece: (k, p.score) for k, p in enumerate(said.pieces) if p.type == kind.NORMAL}
        self.ids = {piece: k.to_bytes(4, "little") for piece, (k, _) in normal.items()}
        self.bytes = {int(p.piece[3:5], 16): k.to_bytes(4, "little") for k, p in enumerate(said.pieces) if p.type == kind.BYTE}
        steps = {s: k for k, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.rank = {piece: steps[s] for piece, (_, s) in normal.items() if len(piece) > 1}
        self.pairs = {a + b for piece in normal for a, b in pairwise(piece)}
        self.marks_apart = not any(pair[1] == MARK and pair[0] != MARK for pair in self.pairs)
        self.begin, self.end = (k.to_bytes(4, "little") for k in (self.library.bos_id(), self.library.eos_id()))
        self.segments: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _agenda(self, part: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece.  An entry is a pair's rank, then its place; it is outdated if the pair there has another rank."""
        rank, end = self.rank.get, len(part)
        agenda = [(found << 32) | at for at in range(end - 1) if (found := rank(part[at : at + 2])) is not None]
        if not agenda:
            return list(part)
        symbols, after, before = list(part), list(range(1, end + 1)), list(range(-1, end - 1))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if right == end or not symbols[at] or rank(pair := symbols[at] + symbols[right]) != entry >> 32:
                continue
            symbols[at], symbols[right] = pair, ""
            after[at] = behind = after[right]
            if behind < end:
                before[behind] = at
                if (found := rank(pair + symbols[behind])) is not None:
                    heappush(agenda, (found << 32) | at)
            ahead = before[at]
            if ahead >= 0 and (found := rank(symbols[ahead] + pair)) is not None:
                heappush(agenda, (found << 32) | ahead)
        return [s for s in symbols if s]

    def _short(self, part: str) -> list[str]:
        """As :meth:`_agenda`, for few symbols: the agenda is a list of the pairs' ranks by place, and no entry of it gets outdated."""
        rank, symbols = self.rank, list(part)
        agenda = [rank.get(pair, NONE) for pair in map(add, part, part[1:])]
        while agenda and (best := min(agenda)) != NONE:
            at = agenda.index(best)  # the leftmost
            symbols[at] = pair = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank.get(pair + symbols[at + 1], NONE)
            if at:
                agenda[at - 1] = rank.get(symbols[at - 1] + pair, NONE)
        return symbols

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            ids = self.ids
            symbols = self._short(part) if len(part) <= SHORT else self._agenda(part)
            self.parts[part] = known = b"".join([ids[s] if s in ids else b"".join([self.bytes[x] for x in s.encode()]) for s in symbols])
        return known

    def _segment(self, segment: str) -> bytes:
        pairs = self.pairs
        cuts = [k for k, pair in enumerate(map(add, segment, segment[1:]), 1) if pair not in pairs]
        return b"".join([self._part(segment[a:z]) for a, z in pairwise([0, *cuts, len(segment)])]) if cuts else self._part(segment)

    def _split(self, text: str) -> list[str]:
        """Segments without their first mark."""
        if not self.marks_apart:
            return [text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in _SEGMENTS(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        if max(len(self.segments), len(self.parts)) > CACHE_SEGMENTS:
            self.segments, self.parts = {}, {}
        known = self.segments
        splits = [self._split(text) if text else [] for text in texts]
        new = list(set().union(*splits).difference(known))
        for s in new:
            known[s] = self._segment(MARK + s)
        self.check(new)
        return [b"".join([self.begin, *[known[s] for s in split], self.end]) for split in splits]

    def check(self, segments: list[str]) -> None:
        """Every segment's ids against the library's, which puts the first mark itself; raises where they differ."""
        segments = [s for s in segments if s]  # for an empty text the library puts no mark
        own, found = [self.segments[s] for s in segments], self.library.encode(segments, num_threads=1)
        if [len(x) // 4 for x in own] == list(map(len, found)) and np.fromiter(chain.from_iterable(found), "<u4").tobytes() == b"".join(own):
            return
        wrong = next(s for s, x, ids in zip(segments, own, found, strict=True) if np.array(ids, "<u4").tobytes() != x)
        raise AssertionError(f"the library encodes {wrong!r} otherwise")


def _model(raw: bytes) -> PieceModel:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _WORKER:
        _WORKER[key] = PieceModel(raw)
    return _WORKER[key]


def _broadcast(df: DataFrame, model_file: str):
    with open(model_file, "rb") as f:  # on the driver; the tasks get its bytes
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``, begin and end ids included, as the library gives them."""
    raw, id_type = _broadcast(docs, model_file), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for whole in batches:
            for b in slices(whole, 128):
                ids = model.encode(texts_of(b.column(1)))
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return bounded_batches(docs.select(F.col(id_col), F.col(text_col).alias("__text"))).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def _each(lists: pa.ListArray) -> list[np.ndarray]:
    flat = lists.flatten().to_numpy()  # null lists add nothing
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
    return [flat[a:z] for a, z in pairwise(ends)]


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded string) by the library's decode; null ids count as none."""
    raw, id_type = _broadcast(encoded, model_file), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _model(raw.value).library
        for whole in batches:
            for b in slices(whole, 128):
                texts = library.decode([x.tolist() for x in _each(b.column(1))], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")


def digests(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids, and the text that the library decodes from them, by their hashes."""
    raw, id_type = _broadcast(encoded, model_file), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _model(raw.value).library
        for whole in batches:
            for b in slices(whole, 128):
                ids = _each(b.column(1))
                texts = library.decode([x.tolist() for x in ids], num_threads=1)
                hashes = [[hashlib.sha256(x).hexdigest() for x in made] for made in ((i.astype("<u4").tobytes() for i in ids), (t.encode() for t in texts))]
                columns = [b.column(0), pa.array(list(map(len, ids)), pa.int64()), *(pa.array(h, pa.string()) for h in hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
