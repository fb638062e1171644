"""Awkward inputs that every corpus operator must take, shared by the tests of this folder."""

import itertools

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
#: Columns of documents and, besides, names that operators use themselves.
EXTRA = "key long, id string, score double, label string, kept boolean, words string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PROSE = "the quick brown fox jumps over the lazy dog while seven old friends watch from the hill"


def documents(spark, rows):
    """Documents of (doc_id, text, lang) with the extra columns set."""
    made = [(i, t, lang, "web", len(t or ""), 7, "x", 0.5, "y", False, None) for i, t, lang in rows]
    return spark.createDataFrame(made, SCHEMA)


def odd_documents(spark):
    """Nulls in every column, empty, blank, very long, repeated and tied rows."""
    long = " ".join(f"word{i % 977} {PROSE}" for i in range(1500))
    return documents(
        spark,
        [(1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE, "en"), (3, None, None), (4, "", "en"), (5, "   \n\t ", None), (None, PROSE + " again", None), (None, None, None), (6, long, "en"), (7, "one", None), (8, "12 34 !!", "de"), (9, "\x00 é中\U0001f600 a", None)],
    )


def shingles(text, n=5):
    import re

    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def linked_groups(ids, links):
    """Least id reachable from each id by brute force."""
    least = {i: i for i in ids}
    for _ in ids:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return least


def jaccard_links(texts, threshold=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
            yield a, b
