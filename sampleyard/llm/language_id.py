"""Operator 8: language identification by compression with per-language zstandard dictionaries.

Whole training texts of each language become ``parts`` raw-content dictionaries of ``dict_bytes``
bytes each.  A text's UTF-8 bytes, all of them in lower case, are compressed once with every
dictionary; the language whose dictionaries leave the fewest bytes together is chosen.  Several
dictionaries of different texts settle what one would leave to chance, as sizes are whole bytes.  Ties go to the
language with more training text.  The score turns the size differences, in bytes for a dictionary,
into probabilities (a byte is ``2 ** (8 / temperature)``), and a row is rejected when it has no letters or the
runner-up is within ``min_margin`` of the best.

Defined results: a null text or one without letters (Unicode category L) is ``und`` with score 0
and rejected; equal texts get equal results; with no labelled text every row is ``und``; an empty
table gives an empty table; other columns pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def encoded(text: str) -> bytes:
    """All bytes of a text, letters in lower case: what dictionaries hold and what is compressed."""
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    """Dictionaries of each language, in descending order of the languages' training text."""

    languages: list[str]
    dictionaries: list[list[bytes]]
    level: int = 6
    temperature: float = 8.0

    def __post_init__(self):
        self._compress = None

    def __getstate__(self):
        return {**self.__dict__, "_compress": None}

    def _compressors(self) -> list[list]:
        if self._compress is None:

            def compressor(raw: bytes):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

            self._compress = [[compressor(raw) for raw in parts] for parts in self.dictionaries]
        return self._compress

    def sizes(self, text: str) -> np.ndarray:
        """Per language, the mean size of the text's bytes under its dictionaries."""
        data = encoded(text)
        return np.array([sum([len(c(data)) for c in parts]) / len(parts) for parts in self._compressors()])

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is the runner-up's excess over the best, as a share of the runner-up's size."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        weight = np.exp2(-(sizes - sizes[best]) * 8 / self.temperature)
        second = np.partition(sizes, 1)[1]
        return self.languages[best], float(1 / weight.sum()), float((second - sizes[best]) / second)


def dealt(texts: list[bytes], parts: int, dict_bytes: int) -> list[bytes]:
    """Dictionaries of whole texts: each goes to the emptiest one that has room for it; where none has, the first has the shortest text's beginning."""
    held: list[list[bytes]] = [[] for _ in range(parts)]
    sizes = [0] * parts
    for t in texts:
        at = sizes.index(min(sizes))
        if sizes[at] + len(t) <= dict_bytes:
            held[at].append(t)
            sizes[at] += len(t)
    if not any(sizes) and texts:
        held[0].append(min(texts, key=len)[:dict_bytes])
    return [b"\n".join(x) for x in held if x]


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 64 * 1024, parts: int = 3, **settings) -> LanguageModel:
    """Dictionaries from rows where ``learn`` holds and the language is not null.

    The sample is bounded by ``parts * dict_bytes`` bytes per language, whatever the corpus' size: distinct
    whole texts in the order of a hash, as many as fit.  A text counts once, however often it is repeated,
    and every language keeps one text at least, so none is lost.  Where a language has only texts longer than
    a dictionary, the first ``dict_bytes`` bytes of its shortest one are learned.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.octet_length(text_col).cast("long").alias("n"), F.pmod(F.xxhash64(text_col), F.lit(1 << 40)).alias("h")
    )
    fits = F.col("n") <= dict_bytes
    shares = (
        rows.groupBy("lang", "h", "n").agg(F.lit(1).alias("one"))  # distinct texts, by hash and size
        .groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.when(fits, F.col("n"))).alias("fitting"), F.count(F.when(fits, True)).alias("texts"), F.min(F.when(fits, F.col("h"))).alias("first"), F.min(F.struct("n", "h")).alias("shortest"))
        .collect()
    )
    wanted = F.lit(False)
    for r in shares:  # three times what is needed, so that the sample nearly always fills its dictionaries
        if r["texts"]:
            cut = max(int(min(1.0, max(3 * parts * dict_bytes / r["fitting"], 24 / r["texts"])) * (1 << 40)), r["first"] + 1)
            wanted = wanted | ((F.col("lang") == r["lang"]) & fits & (F.col("h") < cut))
        else:
            wanted = wanted | ((F.col("lang") == r["lang"]) & (F.col("n") == r["shortest"]["n"]) & (F.col("h") == r["shortest"]["h"]))
    texts: dict[str, list[bytes]] = {}
    for r in rows.where(wanted).select("lang", "h", "text").dropDuplicates().orderBy("h", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(encoded(r["text"]))
    volume = {r["lang"]: r["n"] for r in shares}
    order = sorted(texts, key=lambda lang: (-volume[lang], lang))
    return LanguageModel(order, [dealt(texts[lang], parts, dict_bytes) for lang in order], **settings)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.001) -> DataFrame:
    """(id, lang_pred, score, margin, accepted) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1024):
                found = [model.classify(t) for t in b.column(1).to_pylist()]
                lang, score, margin = (pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))
                accepted = pa.array([f[0] != UNKNOWN and f[2] >= min_margin for f in found])
                yield pa.RecordBatch.from_arrays([b.column(0), lang, score, margin, accepted], names=[id_col, "lang_pred", "score", "margin", "accepted"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double, margin double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = 0.001) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`identify` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                found = [model.classify(t) for t in b.column(b.schema.names.index(text_col)).to_pylist()]
                yield b.filter(pa.array([f[0] != UNKNOWN and f[2] >= min_margin for f in found], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
