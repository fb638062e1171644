"""Operators 1, 3 and 4 against brute force."""

import itertools
import math
import random
from decimal import Decimal

import numpy as np

from sampleyard.llm import components, decontamination, embedding_dedup, ngram_join, queries

from . import odd


def test_ngram_join_finds_what_brute_force_finds(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, odd.SMALL, "documents").collect()}
    links = list(odd.jaccard_links(texts))
    least = odd.linked_groups(texts, links)
    assert links
    got = {r["doc_id"]: r for r in queries.op3_ngram_join(spark, odd.SMALL).collect()}
    assert len(got) == len(texts)
    for i in texts:
        assert (got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (sum(i in x for x in links), least[i], least[i] == i)


def test_ngram_join_of_chains_and_hubs(spark):
    """Near copies that differ in a few words, some linked only by way of others, cut into many chunks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words), "en"))
    before = ngram_join.CHUNK_CLASSES, ngram_join.TILE
    ngram_join.CHUNK_CLASSES, ngram_join.TILE = 16, 8
    try:
        got = {r["doc_id"]: r for r in ngram_join.jaccard_join(odd.documents(spark, rows)).collect()}
    finally:
        ngram_join.CHUNK_CLASSES, ngram_join.TILE = before
    texts = {i: t for i, t, _ in rows}
    links = list(odd.jaccard_links(texts))
    least = odd.linked_groups(texts, links)
    assert {i: (r["n_links"], r["class_id"]) for i, r in got.items()} == {i: (sum(i in x for x in links), least[i]) for i in texts}


def test_ngram_join_of_odd_rows(spark):
    docs = odd.odd_documents(spark)
    got = ngram_join.jaccard_join(docs).collect()
    assert len(got) == docs.count()
    assert [r["n_links"] for r in got if r["doc_id"] == 1] == [3, 3]  # a copy, another id and the row with a null id
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] in (3, 4)] == [(3, 0), (4, 0)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6, 7, 8, 9} <= set(ids)
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_decontamination_finds_what_brute_force_finds(spark):
    docs = {r["doc_id"]: odd.shingles(r["text"]) for r in queries.table(spark, odd.SMALL, "documents").collect()}
    items = {r["item_id"]: odd.shingles(r["text"]) for r in queries.table(spark, odd.SMALL, "benchmark").collect()}
    wanted = {(d, i, len(x & y)) for d, x in docs.items() for i, y in items.items() if y and len(x & y) >= 0.8 * len(y)}
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in queries.op1_decontamination(spark, odd.SMALL).collect()}
    assert wanted and got == wanted
    clean = decontamination.uncontaminated(queries.table(spark, odd.SMALL, "documents"), queries.table(spark, odd.SMALL, "benchmark"), block_items=50)
    assert {r["doc_id"] for r in clean.collect()} == set(docs) - {d for d, _, _ in wanted}


def test_decontamination_inside_long_documents_and_of_odd_rows(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(f"n{rng.randrange(9999)}" for _ in range(n))
    items = [(i, " ".join(f"q{i}_{k}" for k in range(n)), "k") for i, n in enumerate((5, 9, 20, 21, 40, 90, 300))]
    docs = odd.documents(spark, [(i, f"{noise(3000)} {t} {noise(2000)}", "en") for i, t, _ in items])
    bench = spark.createDataFrame([*items, (100, None, "k"), (101, "", "k"), (0, items[0][1], "k"), (102, "two words", None)], "item_id long, text string, doc_id string")
    got = decontamination.contaminated(docs.union(odd.odd_documents(spark)), bench, block_items=3)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted([(0, 0), *((i, i) for i, _, _ in items)])
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 == decontamination.contaminated(docs.limit(0), bench).count()
    left = decontamination.uncontaminated(odd.odd_documents(spark), bench)
    assert left.columns == docs.columns and left.count() == odd.odd_documents(spark).count()


def test_decontamination_by_ids_of_any_type(spark):
    text = " ".join(f"q{k}" for k in range(30))
    ids = [("int", [1, 2, None]), ("string", ["a", "b", None]), ("decimal(9,2)", [Decimal("1.50"), Decimal("2.00"), None]), ("struct<a:int>", [(1,), (2,), None]), ("double", [0.5, 1.5, None])]
    for kind, (a, b, c) in ids:
        items = spark.createDataFrame([(a, text), (b, "other words than those of the rest"), (c, text), (a, text)], f"item_id {kind}, text string")
        docs = odd.documents(spark, [(1, f"so {text} it", "en"), (None, text, "en"), (3, "nothing here", "en")])
        for block_items in (1, 100):
            got = decontamination.contaminated(docs, items, block_items=block_items).collect()
            assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted(((d, i) for d in (1, None) for i in items.where("item_id is not null").limit(1).collect()[0][:1] * 2 + (None,)), key=str)
        assert decontamination.contaminated(docs, items).schema["item_id"].dataType == items.schema["item_id"].dataType
        same = items.withColumnRenamed("item_id", "doc_id")
        assert decontamination.contaminated(docs, same, item_col="doc_id").columns[:2] == ["doc_id", "item_doc_id"]
        assert decontamination.contaminated(docs, same, item_col="doc_id").count() == 6
        assert [r["doc_id"] for r in decontamination.uncontaminated(docs, items, block_items=1).collect()] == [3]


def test_recall_of_contained_items_against_brute_force(spark):
    """Items with a fifth of their shingles lost, their parts apart: what lies scattered counts in the exact step only."""
    rng = random.Random(11)
    docs, sets = [], []
    for i in range(300):
        words = [f"i{i}_{k}" for k in range(rng.choice((10, 20, 40, 80)))]
        sets.append(decontamination.shingle_set(" ".join(words), 5))
        cut = len(words) // 2 if i % 2 else 0  # odd items are cut in two, which loses four shingles at most
        noise = [f"n{rng.randrange(9999)}" for _ in range(600)]
        docs.append(" ".join(noise[:200] + words[:cut] + noise[200 : 200 + rng.choice((0, 3, 9)) if cut else 200] + words[cut:] + noise[400:]))
    index = decontamination.ItemIndex(sets, decontamination.functions_needed(0.8, 0.9999), 0.8)
    wanted = {(d, i) for d, t in enumerate(docs) for i, s in enumerate(sets) if d == i and np.isin(s, decontamination.shingle_hashes(t, 5)).mean() >= 0.8}
    got = {(d, i) for d, i, _, _ in decontamination._verified(docs, index, 5, 0.8)}
    assert len(wanted) > 200 and got <= wanted and len(got) >= 0.99 * len(wanted)


def test_recall_of_the_join_at_its_threshold(spark):
    """Pairs planted at similarities of 0.80 to 0.85: at least 0.9 of those of brute force are linked (as good as all)."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = [f"p{i}_{k}" for k in range(100)]
        other = list(words)
        at = rng.randrange(10, 80)
        other[at : at + rng.choice((5, 6, 7))] = [f"z{i}_{k}" for k in range(rng.choice((5, 6, 7)))]
        rows += [(2 * i, " ".join(words), "en"), (2 * i + 1, " ".join(other), "en")]
    sets = {i: odd.shingles(t) for i, t, _ in rows}
    near = [(i, i + 1) for i in range(0, 300, 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) <= 0.85]
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_join(odd.documents(spark, rows)).collect()}
    assert len(near) > 60 and sum(got[b] == a for a, b in near) >= 0.98 * len(near)


def brute_vectors(rows, threshold=0.93):
    usable = {i: (label, np.array(v)) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for (a, (la, x)), (b, (lb, y)) in itertools.combinations(sorted(usable.items()), 2):
        if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            yield a, b


def test_embeddings_against_brute_force(spark):
    table = queries.table(spark, odd.SMALL, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    links = list(brute_vectors(rows))
    least = odd.linked_groups([i for i, _, _ in rows], links)
    counts = {i: 0 for i, _, _ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_embedding_dedup(spark, odd.SMALL).collect()}
    assert got == {i: (counts[i], least[i], least[i] == i) for i in counts}


def test_embeddings_of_odd_rows_and_small_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.12 * rng.normal(size=12)], i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 12, 1), (203, [float("nan")] * 12, 1), (204, [None] * 12, 1), (205, [float("inf")] + [1.0] * 11, 1), (206, rows[0][1], None), (207, rows[1][1], 1), (208, rows[1][1], 1), (209, [1.0, 2.0], 1), (210, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, key string")
    links = list(brute_vectors(rows))
    least = odd.linked_groups([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table, block_rows=16).collect()}
    assert links and got == {r[0]: (sum(r[0] in x for x in links), least[r[0]]) for r in rows}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_any_size_and_in_many_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 8))
    rows = [(i, [float(x) for x in (base[i % 8] + 0.2 * rng.normal(size=8)) * 10.0 ** rng.integers(-170, 200)], 0) for i in range(150)]
    rows += [(900, [1e-310, 2e-310] + [0.0] * 6, 0), (901, [1e-200, 2e-200] + [0.0] * 6, 0), (902, [1e200, 2e200] + [0.0] * 6, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    plain = [(i, [x / max(map(abs, v)) for x in v], label) for i, v, label in rows]
    links = list(brute_vectors(plain))
    least = odd.linked_groups([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table, block_rows=4).collect()}
    assert got[901][0] >= 2 and got == {r[0]: (sum(r[0] in x for x in links), least[r[0]]) for r in rows}


def test_components_of_a_path_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_short_items_at_any_place_of_long_documents():
    """Items of 5 to 40 words, at many places; those of few shingles are never lost."""
    rng = random.Random(8)
    texts = [" ".join(f"s{i}_{k}" for k in range(5 + i % 36)) for i in range(360)]
    docs = []
    for t in texts:
        at = rng.randrange(400)
        docs.append(" ".join([*(f"n{rng.randrange(9999)}" for _ in range(at)), t, *(f"n{rng.randrange(9999)}" for _ in range(500 - at))]))
    sets = [decontamination.shingle_set(t, 5) for t in texts]
    index = decontamination.ItemIndex(sets, decontamination.functions_needed(0.8, 0.9999), 0.8)
    assert [(d, i) for d, i, _, _ in decontamination._verified(docs, index, 5, 0.8)] == [(i, i) for i in range(360)]
    partly = [" ".join([*t.split()[: len(t.split()) - (len(s) // 5)], "other", "words"]) for t, s in zip(texts, sets, strict=True)]
    assert [(d, i) for d, i, _, _ in decontamination._verified(partly, index, 5, 0.8)] == [(i, i) for i in range(360)]


def test_one_row_of_null_and_repeated_ids_stays(spark):
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "else"]), " ".join(f"o{i}" for i in range(60))
    nulls = [(None, a, "x"), (None, other, "x"), (7, near, "x"), (None, None, "x")]
    alone = [(None, f"p{i} " + " ".join(f"v{i % 3}_{k}" for k in range(60)), "x") for i in range(9)]  # three groups of null ids
    again = [(20, " ".join(f"r{k}" for k in range(60)), "x"), (20, " ".join(f"r{k}" for k in range(1, 60)), "y"), (20, "not like the others at all but of the same id", "x"), (21, " ".join(f"r{k}" for k in range(61)), "x")]
    copies = [(30, "five words make one shingle", "x"), (30, "Five words make one shingle!", "y")]
    for rows, want in ((nulls, [None, None, 7]), (alone, [None] * 3), (again, [20, 20]), (copies, [30]), (nulls + alone + again + copies, [None] * 5 + [7, 20, 20, 30])):
        docs = odd.documents(spark, rows)
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)
        marked = [r["doc_id"] for r in ngram_join.jaccard_join(docs).collect() if r["kept"]]
        assert sorted(marked, key=str) == sorted(want, key=str)
