"""The corpus queries that DuckDB can state, as SQL over the same tables."""

from __future__ import annotations

import string


def _lowered(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def phrases(min_count: int = 100, max_words: int = 5, top: int = 2000) -> str:
    """Operator 13: every n-gram counted by grouping, every cut scored in 128-bit integers."""
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_lowered("coalesce(text, '')")} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, {max_words} + 1)) AS size FROM split WHERE len(w) > 0),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM sized WHERE len(w) >= size),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {min_count}),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.size = c.k AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.size = c.size - c.k AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand WHERE size > 2))),
absorbed AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inside o ON o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= 100 * c.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best ANTI JOIN absorbed USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""


def centroids(count: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Operator 12: the rounds one after the other, all in integers."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS d, v FROM kept ORDER BY d LIMIT {count}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT row, c, d FROM (
    SELECT row, c, list_sum(list_transform(range(1, {dims} + 1), lambda k: (x.v[k] - y.v[k]) * (x.v[k] - y.v[k]))) AS d FROM kept x, c{i} y)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(x ORDER BY k) AS v FROM (
      SELECT c, k, (s - ((s % n) + n) % n) // n AS x FROM (
        SELECT c, k, sum(v[k])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, v, unnest(range(1, {dims} + 1)) AS k FROM a{i} JOIN kept USING (row)) GROUP BY c, k)) GROUP BY c) m USING (c))"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(o.v, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM {last} JOIN kept USING (row) JOIN c{rounds} o USING (c)"""


def _shingled(table: str, key: str, n: int) -> str:
    """CTE body of (row, key, g): the distinct shingles of each text; of one with fewer words all of them together."""
    runs = f"list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' ')))"
    return rf"""SELECT row, {key}, unnest(CASE WHEN len(w) >= {n} THEN {runs} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g
  FROM (SELECT row_number() OVER () AS row, {key}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM {table})"""


def contaminated(n: int = 5, threshold: float = 0.8) -> str:
    """Operator 1: shingles of documents and items joined and counted, without windows or hashes."""
    return f"""WITH d AS MATERIALIZED ({_shingled("documents", "doc_id", n)}),
i AS MATERIALIZED ({_shingled("benchmark", "item_id", n)}),
sizes AS (SELECT row, count(*) AS n_item FROM i GROUP BY row),
met AS (SELECT d.row AS doc, i.row AS item, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared::DOUBLE / n_item AS containment FROM met JOIN sizes ON row = item WHERE n_shared >= {threshold} * n_item"""


def jaccard_join(n: int = 5, threshold: float = 0.8) -> str:
    """Operator 3: every pair of documents that share a shingle, its exact Jaccard similarity, and components."""
    return f"""WITH RECURSIVE s AS MATERIALIZED ({_shingled("documents", "doc_id", n)}),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE n >= {threshold} * (x.size + y.size - n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept, coalesce(size, 0) AS n_shingles
FROM least LEFT JOIN counted USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def near_duplicates(threshold: float = 0.93) -> str:
    """Operator 4: cosines of all pairs of one label in doubles, and components."""
    usable = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, len(embedding) AS dims FROM embeddings WHERE label IS NOT NULL AND {usable}),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.dims = b.dims AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)"""
