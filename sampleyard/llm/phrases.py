"""Operator 13: phrase collocations, mined from sorted fixed-width keys of word ids.

Words are counted per language in one pass.  Those with ``min_count`` occurrences get 32-bit ids; texts are
encoded by this dictionary, broken at ends of pieces and at all other words, which no frequent phrase can hold.
Every position gives one key, the language's number and the ids of the next ``max_words`` words up to a break,
six big-endian 32-bit numbers for five words.  Tasks radix-sort their keys, count runs of equal ones and ship
each range of keys as one block to where the range is sorted again; there one scan counts the runs of
every prefix, so one sort gives all lengths.  A prefix at either end of a range may go on in the next: such
counts are kept whatever they are and added up afterwards.  Ranges are cut at keys of a sample, which
settles their sizes only; equal keys of a task are one, so copies make no large range.

A dictionary of at most ``dictionary_words`` words and ``dictionary_bytes`` bytes is broadcast.  Beyond that the most
frequent words are, and occurrences of the others are joined with the rest of the dictionary by shuffle.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows each count; ties go
as the order says (score, count, phrase), so ranks are gapless; an empty table, or one without frequent phrases,
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_table, slices, spread_sql_conf, texts_of, written

UNKNOWN = "und"
#: Counters are handed to Spark at this many words, and keys are sorted by so many at a time, so a task's memory is bounded.
COUNTED_WORDS, SORTED_KEYS = 200_000, 1_000_000
#: Keys that a range of the second sort is meant to hold, and ranges for each shuffle partition.
RANGE_KEYS, RANGES = 400_000, 4
#: Keys of the sample that cuts the ranges: for each range, and the most that the driver takes.  Beyond MOST_RANGES ranges hold more keys.
SAMPLE, MOST_SAMPLED, MOST_RANGES = 100, 1_000_000, 100_000

_BREAK = b"."
_PIECE_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8, and a full stop at each end of a piece."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_PIECE_ENDS).replace(_BREAK, b" . ").split()


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, f): occurrences of each word per language, and of all words together in a row with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in counted.items():
                words.pop(_BREAK, None)
                found, counts = [*words, None], [*words.values(), sum(words.values())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "f"])
            counted.clear()

        for whole in batches:
            for b in slices(whole, 256):
                for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    counted.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, counted.values())) > COUNTED_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return bounded_batches(rows).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered_words(counts: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f, id) of the words with ``min_count`` occurrences and of the languages' totals (null word); ids from 1, gapless."""
    at = F.monotonically_increasing_id()
    kept = written(counts.where(F.col("word").isNull() | (F.col("f") >= min_count)).withColumn("__part", F.spark_partition_id()).withColumn("__at", at.bitwiseAND((1 << 33) - 1)), "phrase-words")
    # one row for each part of the table, no more than shuffle partitions
    sizes = kept.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return kept.join(F.broadcast(before), "__part").select("lang", "word", "f", (F.col("__before") + F.col("__at") + 1).alias("id"))


def head_count(words: DataFrame, most_words: int, most_bytes: int) -> int:
    """The least count such that words of this count or more are at most so many, and so many bytes."""
    step = F.floor(F.log2("f") * 16)
    steps = words.where(F.col("word").isNotNull()).groupBy(step.alias("step")).agg(F.min("f").alias("f"), F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size"))
    least, n, size = (1 << 63) - 1, 0, 0
    for r in sorted(steps.collect(), key=lambda r: -r["step"]):  # at most 16 rows for each doubling of the count
        n, size = n + r["n"], size + r["size"]
        if n > most_words or size > most_bytes:
            break
        least = r["f"]
    return least


def encoded(docs: DataFrame, words: DataFrame, dictionary_words: int, dictionary_bytes: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang_no, ids binary): each text's words as little-endian 32-bit ids, zero for a break."""
    spark = docs.sparkSession
    least = head_count(words, dictionary_words, dictionary_bytes)
    dictionary: dict[str, dict[bytes, int]] = {}
    for r in words.where(F.col("word").isNotNull() & (F.col("f") >= least)).select("lang", "word", "id").toLocalIterator():
        dictionary.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
    known = spark.sparkContext.broadcast(dictionary)
    tail = words.where(F.col("word").isNotNull() & (F.col("f") < least)).select("lang", "word", "id")
    apart = not tail.isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                ids, others = [], []
                for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                    split = tokens(text)
                    found = np.fromiter(map(known.value.get(lang, {}).get, split, repeat(0)), "<u4", len(split))
                    ids.append(found.tobytes())
                    if apart:
                        others.append([{"at": at, "word": split[at].decode("utf-8", "surrogatepass")} for at in np.flatnonzero(found == 0).tolist() if split[at] != _BREAK])
                columns = [b.column(0), pa.array(ids, pa.binary())]
                if apart:
                    columns.append(pa.array(others, pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "ids", "others"][: len(columns)])

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    made = bounded_batches(rows).mapInArrow(run, "lang string, ids binary" + (", others array<struct<at: int, word: string>>" if apart else ""))
    if apart:
        made = _with_tail(written(made.withColumn("row", F.monotonically_increasing_id()), "phrase-texts"), tail)
    totals = words.where(F.col("word").isNull()).select("lang", F.col("id").alias("lang_no"))
    return made.join(_few(totals), "lang").select("lang_no", "ids")


def _with_tail(texts: DataFrame, tail: DataFrame) -> DataFrame:
    """The ids of words outside the broadcast dictionary put in: their occurrences, none of a very frequent word, are joined by shuffle."""
    found = texts.select("row", "lang", F.explode("others").alias("o")).select("row", "lang", "o.at", "o.word").join(tail, ["lang", "word"])
    found = found.groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("found"))  # of one text

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for raw, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held = np.frombuffer(raw, "<u4").copy()
                for o in more or []:
                    held[o["at"]] = o["id"]
                ids.append(held.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["lang", "ids"])

    return texts.join(found, "row", "left").select("lang", "ids", "found").mapInArrow(fill, "lang string, ids binary")


#: Languages up to this number are joined by broadcast.
FEW = 100_000


def _few(totals: DataFrame) -> DataFrame:
    return F.broadcast(totals) if totals.limit(FEW + 1).count() <= FEW else totals


def windows(lang_no: int, ids: np.ndarray, width: int) -> np.ndarray:
    """One key for each position with a frequent word and another behind it: the language, then up to ``width`` ids before a break."""
    padded = np.concatenate([ids, np.zeros(width, np.uint32)])
    at = np.flatnonzero((ids != 0) & (padded[1 : len(ids) + 1] != 0))
    keys = np.empty((len(at), width + 1), np.uint32)
    keys[:, 0], going = lang_no, np.ones(len(at), bool)
    for k in range(width):
        column = padded[at + k]
        going &= column != 0
        keys[:, k + 1] = np.where(going, column, 0)
    return keys


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows by their columns, first column first: stable passes over 16-bit digits, last digit first; constant digits are skipped."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for digit in (keys[:, column] & 0xFFFF, keys[:, column] >> 16):
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit.astype(np.uint16)[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def packed(keys: np.ndarray) -> np.ndarray:
    """Rows as fixed-width binary keys, which compare like the rows."""
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * keys.shape[1]}").ravel()


def prefix_counts(keys: np.ndarray, counts: np.ndarray, min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, keys, counts) of the prefixes of a sorted range that reach ``min_count`` or touch an end of the range."""
    changed = np.zeros(len(keys), bool)
    changed[0] = True
    changed[1:] = keys[1:, 0] != keys[:-1, 0]
    for words in range(1, keys.shape[1]):
        changed[1:] |= keys[1:, words] != keys[:-1, words]
        if words < 2:
            continue
        starts = np.flatnonzero(changed)
        total = np.add.reduceat(counts, starts)
        wanted = (keys[starts, words] != 0) & ((total >= min_count) | (starts == 0) | (starts == starts[-1]))
        found = np.zeros((int(wanted.sum()), keys.shape[1]), np.uint32)
        found[:, : words + 1] = keys[starts[wanted], : words + 1]
        yield words, found, total[wanted]


def phrase_counts(texts: DataFrame, words: DataFrame, min_count: int, max_words: int, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(key binary, words int, f long) of every phrase of 2 to ``max_words`` words with ``min_count`` occurrences."""
    total = words.where(F.col("word").isNotNull()).agg(F.sum("f")).first()[0] or 0
    ranges, width = min(MOST_RANGES, max(1, -(-total // range_keys))), 4 * (max_words + 1)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = min(ranges * SAMPLE, MOST_SAMPLED) / max(total, 1)
        for b in batches:
            for at, (lang_no, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                keys = windows(lang_no, np.frombuffer(raw, "<u4"), max_words)
                chosen = np.random.default_rng([at, len(raw), len(keys)]).random(len(keys)) < share
                yield pa.RecordBatch.from_arrays([pa.array(packed(keys[chosen]).tolist(), pa.binary())], names=["key"])

    # about SAMPLE keys for each range; equal ones once
    cuts = np.array(sorted({bytes(r["key"]).ljust(width, b"\0") for r in texts.mapInArrow(sampled, "key binary").distinct().collect()}) if ranges > 1 else [], f"S{width}")
    cuts = cuts[np.linspace(0, len(cuts), ranges + 1)[1:-1].astype(int)] if len(cuts) else cuts
    held = texts.sparkSession.sparkContext.broadcast(np.unique(cuts))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held_keys, squeeze = 0, zstandard.ZstdCompressor(level=1).compress

        def blocks() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(waiting) if waiting else np.empty((0, max_words + 1), np.uint32)
            waiting.clear()
            if not len(keys):
                return
            keys, counts = runs(keys, np.ones(len(keys), np.int64))
            part = np.searchsorted(held.value, packed(keys), side="right")
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                # by columns, each as differences: sorted ones have many equal and small ones
                steps = np.diff(keys[a:z].T, axis=1, prepend=np.uint32(0))
                columns = [squeeze(np.ascontiguousarray(steps).tobytes()), squeeze(counts[a:z].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["part", "keys", "counts"])

        for b in batches:
            for lang_no, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                waiting.append(windows(lang_no, np.frombuffer(raw, "<u4"), max_words))
                held_keys += len(waiting[-1])
                if held_keys > SORTED_KEYS:
                    yield from blocks()
                    held_keys = 0
        yield from blocks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, unsqueeze = None, [], zstandard.ZstdDecompressor().decompress

        def counted() -> Iterator[pa.RecordBatch]:
            if waiting:
                keys, counts = runs(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
                waiting.clear()
                for n, found, f in prefix_counts(keys, counts, min_count):
                    raw = pa.Array.from_buffers(pa.binary(width), len(found), [None, pa.py_buffer(found.astype(">u4").tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([raw, pa.array(np.full(len(f), n, np.int32)), pa.array(f)], names=["key", "words", "f"])

        for b in batches:
            for own, raw, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != part:
                    yield from counted()
                    part = own
                steps = np.frombuffer(unsqueeze(raw), np.uint32).reshape(max_words + 1, -1)
                waiting.append((np.cumsum(steps, axis=1, dtype=np.uint32).T, np.frombuffer(unsqueeze(n), np.int64)))
        yield from counted()

    shipped = texts.mapInArrow(ship, "part int, keys binary, counts binary").repartition(max(1, -(-ranges // RANGES)), "part").sortWithinPartitions("part")
    return shipped.mapInArrow(count, "key binary, words int, f long").groupBy("key", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def _number(key: Column | str, at: Column | int) -> Column:
    """The ``at``-th 32-bit number of a key."""
    return F.conv(F.hex(F.substring(F.col(key) if isinstance(key, str) else key, F.lit(1) + 4 * F.lit(at) if isinstance(at, int) else 4 * at + 1, F.lit(4))), 16, 10).cast("long")


def scored(counts: DataFrame, words: DataFrame, max_words: int, absorb_percent: int) -> DataFrame:
    """(key, words, a, l, r, n, score) of the phrases that no longer one absorbs, each by its lowest-scoring cut."""
    zeros, lang = F.lit(bytes(4 * max_words)), F.substring("key", 1, 4)

    def part(first: Column | int, length: Column) -> Column:
        """The key of ``length`` words from word ``first`` (0-based) on."""
        return F.concat(lang, F.substring(F.col("key"), F.lit(5) + 4 * first, 4 * length), F.substring(zeros, F.lit(1), 4 * (max_words - length)))

    totals = words.where(F.col("word").isNull()).select(F.col("id").alias("lang_no"), F.col("f").alias("n"), "lang")
    single = words.where(F.col("word").isNotNull()).join(_few(totals.select("lang", "lang_no")), "lang")
    hexed = lambda c: F.lpad(F.hex(c), 8, "0")
    single = single.select(F.concat(F.unhex(F.concat(hexed(F.col("lang_no")), hexed(F.col("id")))), F.lit(bytes(4 * (max_words - 1)))).alias("part"), "f")
    known = counts.select(F.col("key").alias("part"), "f").unionByName(single)

    # slot k: the first k words of a cut; slot max_words + k: the rest
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.col("words") - 1),
            lambda k: F.array(
                F.struct(k.alias("slot"), part(F.lit(0), k).alias("part")),
                F.struct((k + max_words).alias("slot"), part(k, F.col("words") - k).alias("part")),
            ),
        )
    )
    wanted = counts.select("key", F.explode(cuts).alias("cut")).select("key", "cut.slot", "cut.part")
    values = wanted.join(known, "part").select("key", "slot", "f")
    own = counts.select("key", F.lit(0).alias("slot"), "f")
    longer = counts.where(F.col("words") > 2).select(F.explode(F.array(part(F.lit(0), F.col("words") - 1), part(F.lit(1), F.col("words") - 1))).alias("key"), F.lit(max_words).alias("slot"), "f")
    at = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("f")))
    rows = (
        values.unionByName(own)
        .unionByName(longer)
        .groupBy("key")
        .agg(at(0).alias("a"), at(max_words).alias("over"), *(at(k).alias(f"l{k}") for k in range(1, max_words)), *(at(max_words + k).alias(f"r{k}") for k in range(1, max_words)))
        .where(F.col("over").isNull() | (F.col("over") * 100 < F.lit(absorb_percent) * F.col("a")))
        .withColumn("lang_no", _number("key", 0))
        .join(_few(totals), "lang_no")
    )
    # decimals of up to 38 digits: exact up to 10**17 words
    score = lambda k: F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l{k} AS DECIMAL(18, 0)) * CAST(r{k} AS DECIMAL(18, 0)))")
    best = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)))))
    return rows.withColumn("best", best).select("key", "lang", "a", "best.l", "best.r", "n", "best.score")


def mine(
    docs: DataFrame,
    min_count: int = 100,
    max_words: int = 5,
    absorb_percent: int = 100,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    dictionary_words: int = 500_000,
    dictionary_bytes: int = 16 << 20,
    range_keys: int = RANGE_KEYS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    if not 2 <= max_words <= 15 or min_count < 1:
        raise ValueError("phrases have 2 to 15 words and occur at least once")
    words = numbered_words(word_counts(docs, text_col, lang_col), min_count)
    texts = written(encoded(docs, words, dictionary_words, dictionary_bytes, text_col, lang_col), "phrase-ids")
    counts = written(phrase_counts(texts, words, min_count, max_words, range_keys), "phrase-counts")
    drop_table(texts)
    found = scored(counts, words, max_words, absorb_percent)
    # best of each of some parts of a language, so that its last ranking sees few rows; ties stay until phrases are spelt out
    order = [F.col("score").desc(), F.col("a").desc()]
    found = found.withColumn("__rank", F.rank().over(Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(16))).orderBy(*order))).where(F.col("__rank") <= top).drop("__rank")
    found = written(found, "phrases-scored")
    ids = found.select("key", F.posexplode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda k: _number("key", k)), lambda x: x > 0)).alias("at", "id"))
    spelt = ids.join(words.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    ranked = found.join(spelt, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
