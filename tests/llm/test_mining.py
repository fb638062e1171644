"""Operators 11, 12 and 13: against their library, plain Python integers and brute-force counts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from sampleyard.llm import centroids, phrases, queries, sentence_pieces

from . import odd

MODEL = P.path("piece_bpe_32k.model")
MARKS = ["", " ", "  ", "   a  b ", "▁", "▁▁ a", "a▁b", "\x00a", "\n\n x\ty", "é中\U0001f600 " * 700, "<s> </s> <0x41> <unk>", "a" * 20000, " " * 3000 + "x", "1234567890" * 400, "ab" * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_sentence_pieces_are_the_librarys(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, odd.MEDIUM, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op11_sentence_pieces(spark, odd.MEDIUM).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_agendas_in_a_list_and_in_a_heap_agree(monkeypatch):
    """op11: short parts have their agenda in a list; the symbols are those of the heap, ties and characters without a piece too."""
    model = sentence_pieces.PieceModel(open(MODEL, "rb").read())
    rng = random.Random(4)
    for _ in range(4000):
        part = "".join(rng.choice("aaaeinst\u2581rdlhe\u00e9\u4e2d") for _ in range(rng.randrange(1, 2 * sentence_pieces.SHORT)))
        assert model._short(part) == model._agenda(part)
    texts = ["".join(rng.choice("aab enthe \n") for _ in range(80)) for _ in range(50)]
    wanted = model.encode(texts)
    for short in (0, 1000):
        monkeypatch.setattr(sentence_pieces, "SHORT", short)
        assert sentence_pieces.PieceModel(open(MODEL, "rb").read()).encode(texts) == wanted


def test_sentence_pieces_of_odd_rows(spark, library):
    docs = odd.odd_documents(spark).union(odd.documents(spark, [(50 + i, t, None) for i, t in enumerate(MARKS)]))
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL), MODEL).collect()
    key = lambda x: (str(x[0]), x[1])
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], ids, library.decode(ids)))
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=key) == sorted(want, key=key)
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0


def test_a_segment_that_differs_from_the_library_is_noticed():
    model = sentence_pieces.PieceModel(open(MODEL, "rb").read())
    model.rank = dict(zip(model.rank, reversed(model.rank.values()), strict=True))
    with pytest.raises(AssertionError, match="the library encodes"):
        model.encode(["some words that a reversed order of merges joins otherwise"])


def test_caches_are_emptied_and_results_stay(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_SEGMENTS", 5)
    model = sentence_pieces.PieceModel(open(MODEL, "rb").read())
    for t in ["one two three four five six", "seven eight nine", "one two again and again"]:
        assert model.encode([t]) == [np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()]
        assert len(model.segments) < 12


def plain_clusters(rows, count, rounds, scale=1024):
    """The contract by itself: (id, cluster, distance) and centroids, all in Python integers."""
    from fractions import Fraction
    from math import floor

    ints = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v in rows]
    first = sorted(ints, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    held = [v for _, v in first[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(held)) for _, v in ints]

    for _ in range(rounds):
        placed = assign()
        for j in range(len(held)):
            own = [v for (_, v), (_, k) in zip(ints, placed, strict=True) if k == j]
            if own:
                held[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(ints, assign(), strict=True)], held


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance string")


@pytest.mark.parametrize("kind", ["ties", "close", "wide", "mixed"])
def test_centroids_are_exact(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "ties":
        made = rng.integers(-2, 3, (120, 4)) / 1024
    elif kind == "close":  # differences far below float32's step
        made = 30_000 + rng.integers(0, 3, (120, 4)) / 1024
    else:
        made = rng.normal(size=(120, 4)) * 10.0 ** rng.choice([0, 3, 9, 25] if kind == "wide" else [0, 0, 0, 12], (120, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    got = centroids.cluster(vectors(spark, rows), count=5, rounds=4, dims=4).collect()
    want, held = plain_clusters(rows, 5, 4)
    most = (1 << 63) - 1
    assert len(got) == len(want)
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in got} == {(i, j, d if d <= most else None) for i, j, d in want}
    assert {r["cluster"]: r["centroid_sha256"] for r in got} == {j: hashlib.sha256(",".join(map(str, held[j])).encode()).hexdigest() for _, j, _ in want}
    for r in got:
        own = [d for _, j, d in want if j == r["cluster"]]
        assert r["cluster_inertia"] == (sum(own) if max(own) <= most and sum(own) <= most else None)


def test_screening_intervals_hold_the_exact_scores():
    rng = np.random.default_rng(5)
    for size in (3, 1 << 12, (1 << 26) - 1):
        x, c = rng.integers(-size, size + 1, (300, 64)), rng.integers(-size, size + 1, (9, 64))
        c[8] = c[2]
        number, distance = centroids.Centroids(c.tolist()).nearest(x)
        assert [(int(j), int(d)) for j, d in zip(number, distance, strict=True)] == [centroids.exact_nearest(v, c.tolist()) for v in x.tolist()]


def test_centroids_of_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0])]
    good = [(7, [0.5, 0.25]), (7, [0.5, 0.25]), (7, [-1.0, 3.0]), (None, [0.0, 0.0])]
    got = centroids.cluster(vectors(spark, bad + good), count=8, rounds=3, dims=2).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(plain_clusters(good, 8, 3)[0], key=key)
    assert centroids.cluster(vectors(spark, bad), dims=2).collect() == []
    assert centroids.cluster(vectors(spark, good).limit(0), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_centroids_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, odd.SMALL, "embeddings").collect()]
    want, _ = plain_clusters(rows, 8, 10)
    got = queries.op12_centroids(spark, odd.SMALL).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    assert {r["inertia"] for r in got} == {sum(d for *_, d in want)}


def plain_phrases(rows, min_count, top, max_words=5):
    """The contract by itself, over (text, lang) rows."""
    grams, found = {}, []
    for text, lang in rows:
        counts = grams.setdefault(lang or "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for size in range(1, max_words + 1):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in sorted(grams.items()):
        n = sum(c for g, c in f.items() if len(g) == 1)
        kept = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        inside = Counter()
        for g, c in kept.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inside[g[i : i + size]] = max(inside[g[i : i + size]], c)
        out = []
        for g, a in kept.items():
            if 100 * inside[g] < 100 * a:
                score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                out.append((-score, -a, " ".join(g).encode(), left, right))
        found += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(out)[:top], 1)]
    return found


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"range_keys": 500}, {"dictionary_words": 150}, {"dictionary_words": 0, "range_keys": 3000}, {"dictionary_bytes": 300}])
def test_phrases_are_those_of_brute_force(spark, settings):
    docs = queries.table(spark, odd.SMALL, "documents")
    want = plain_phrases([(r["text"], r["lang"]) for r in docs.collect()], 6, 150)
    assert len(want) > 200
    assert found(phrases.mine(docs, min_count=6, top=150, **settings)) == sorted(want)


def test_phrases_of_repeats_ties_and_control_characters(spark):
    texts = ["a b c a b c a b" * 3, "x\x01 y. x y, x\x01\ty;x y", "A É b\x0bc d\x0cc d c d", "one. two! three? four", "same words here same words here " * 40, None, "", " \t "]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("en", None, "und")]
    docs = odd.documents(spark, rows + rows)
    want = plain_phrases([(t, lang) for _, t, lang in rows + rows], 2, 7)
    for settings in ({}, {"range_keys": 5}, {"dictionary_words": 1}):
        assert found(phrases.mine(docs, min_count=2, top=7, **settings)) == sorted(want)


def test_phrases_of_odd_rows_and_none(spark):
    docs = odd.odd_documents(spark)
    assert found(phrases.mine(docs, min_count=3, top=2000)) == sorted(plain_phrases([(r["text"], r["lang"]) for r in docs.collect()], 3, 2000))
    assert found(phrases.mine(docs, min_count=10**9)) == [] and found(phrases.mine(docs.limit(0))) == []


def test_radix_order_and_runs():
    keys = np.random.default_rng(1).choice([0, 1, 65535, 65536, 2**32 - 1], (4000, 3)).astype(np.uint32)
    once, counts = phrases.runs(keys, np.ones(len(keys), np.int64))
    want = Counter(map(tuple, keys.tolist()))
    assert list(zip(map(tuple, once.tolist()), counts.tolist(), strict=True)) == sorted(want.items())
    assert (np.sort(phrases.packed(keys)) == phrases.packed(keys[phrases.radix_order(keys)])).all()
