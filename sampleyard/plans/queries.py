"""The registered queries of the library and, for each that SQL can express, its DuckDB counterpart."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions, fusion, names, rules, signal, similarity
from ..functions import taxonomy as T
from ..operators import caption_index, catalog, path_names, postings, scan
from ..sources.shared import checkpointed, shared_folder
from ..streaming import ingest
from . import duck, frame_queries
from .projections import LABELS, projected, with_projections

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_projections(sql)
        return f

    return add


def _named(spark: SparkSession, d: str) -> DataFrame:
    return path_names.with_names(projected(spark, d, "lib_files"), name="n")


NAMED = "with " + duck.named()

# --- name pass -----------------------------------------------------------------------------------


@register(f"{NAMED} select file_id, path, nkind as kind, ncategory as category, nnote as key, nscale as scale, nbpm as bpm, array_to_string(ninstruments, ',') as instruments, nconfidence as confidence from named")
def name_full(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("file_id", "path", "n.kind", "n.category", "n.key", "n.scale", "n.bpm", F.array_join("n.instruments", ",").alias("instruments"), "n.confidence")


@register(f"{NAMED} select nkind as kind, count(*) as n from named group by 1")
def name_kind(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_files").select(names.nearest(F.transform(F.reverse(names.fragments(F.col("path"))), lambda x: names.parse_kind(x))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@register(f"{NAMED} select label, ncategory as category, count(*) as n from named group by 1, 2")
def name_category(spark: SparkSession, d: str) -> DataFrame:
    label = names.nearest(F.transform(F.reverse(names.fragments(F.col("path"))), lambda x: names.parse_category(x)))
    return projected(spark, d, "lib_files").select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n")).select("label", names.coarse(F.col("label")).alias("category"), "n")


@register(f"{NAMED} select nbpm as bpm, count(*) as n from named group by 1")
def name_bpm(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_files").select(names.nearest(F.transform(F.reverse(names.fragments(F.col("path"))), names.parse_bpm)).alias("bpm")).groupBy("bpm").agg(F.count("*").alias("n"))


@register(f"{NAMED} select nnote as key, nscale as scale, count(*) as n from named group by 1, 2")
def name_key_scale(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("n.key", "n.scale").agg(F.count("*").alias("n"))


@register(f"{NAMED} select i as instrument, count(*) as n from (select unnest(ninstruments) as i from named) group by 1")
def name_instruments(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select(F.explode("n.instruments").alias("instrument")).groupBy("instrument").agg(F.count("*").alias("n"))


@register(f"{NAMED} select nconfidence as confidence, count(*) as n from named group by 1")
def name_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("n.confidence").agg(F.count("*").alias("n"))


@register(
    "select file_id, case when contains(s, 'drum') or contains(s, 'loop') or contains(s, 'beat') or contains(s, 'perc') or contains(s, 'hat') or contains(s, 'kick') or contains(s, 'snare') then 'beats' "
    f"when {duck.has_any('s', T.WARP_CUES['melodic'])} then 'melodic' when {duck.has_any('s', T.WARP_CUES['harmonic'])} then 'harmonic' when {duck.has_any('s', T.WARP_CUES['vocal'])} then 'vocal' end as warp, "
    f"coalesce(try_cast(nullif(regexp_extract(s, {duck.q(duck.EXPLICIT_BPM)}, 1), '') as double), try_cast(nullif(regexp_extract(s, {duck.q(duck.EXPLICIT_BPM)}, 2), '') as double), "
    f"case when try_cast(nullif(regexp_extract(s, {duck.q(duck.BARE_IN_FILENAME)}, 2), '') as double) between 40 and 220 then try_cast(regexp_extract(s, {duck.q(duck.BARE_IN_FILENAME)}, 2) as double) end) as bpm, "
    f"case when contains(s, 'loop') then 'loop' when regexp_matches(s, {duck.q(duck.ONE_SHOT_IN_FILENAME)}) then 'one-shot' end as kind "
    "from (select file_id, lower(regexp_replace(string_split(path, '/')[len(string_split(path, '/'))], '^(.+)\\.[^.]+$', '\\1')) as s from lib_files)"
)
def filename_cues(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return projected(spark, d, "lib_files").select("file_id", names.warp_from_filename(path).alias("warp"), names.bpm_from_filename(path).alias("bpm"), names.kind_from_filename(path).alias("kind"))


@register(f"{NAMED} select file_id, duration, {duck.resolve_kind('nkind', 'ncategory', 'nbpm', 'duration')} as kind from named")
def kind_resolution(spark: SparkSession, d: str) -> DataFrame:
    kind = rules.resolve_kind(F.col("n.kind"), F.col("n.category"), F.col("n.bpm"), F.col("duration"))
    return _named(spark, d).select("file_id", "duration", kind.alias("kind"))


# --- catalog reads -------------------------------------------------------------------------------


def _tags(spark: SparkSession, d: str) -> DataFrame:
    tags = projected(spark, d, "lib_tags")
    return tags.withColumn("genres", catalog.genres_from_json(F.col("genres_json"))).withColumn("filename", names.file_name(F.col("path")))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("path", "category", "kind", "key", "scale", "bpm", "backend", "edited")


SHOWN = "select path, category, kind, key, scale, bpm, backend, edited from lib_tags"


@register(f"{SHOWN} where category = 'bass' and kind = 'loop' and key = 'F#' and scale = 'minor' and backend = 'auto'")
def catalog_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), category="bass", kind="loop", key="F#", scale="minor", backend="auto"))


@register(f"{SHOWN} where (',' || array_to_string(instruments, ',') || ',') ilike '%,bass,%'")
def catalog_filter_instrument(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), instrument="bass"))


@register(f"{SHOWN} where genres_json ilike '%\"genre\":\"house\"%'")
def catalog_filter_genre_json(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), genre="House"))


@register(f"{SHOWN} where bpm >= 100 and bpm <= 128")
def catalog_filter_bpm_range(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), bpm_min=100, bpm_max=128))


@register(f"{SHOWN} where path ilike '%KICK_p%'")
def catalog_filter_path_like(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), path_like="KICK_p"))


@register(f"{SHOWN} where edited")
def catalog_filter_edited(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), edited=True))


@register(f"{SHOWN} where kind = 'one-shot' and backend = 'auto' and bpm >= 90 and path ilike '%packs%' and not edited")
def catalog_filter_combined(spark: SparkSession, d: str) -> DataFrame:
    return _shown(catalog.query(_tags(spark, d), **catalog.query_string_filters({"kind": "one-shot", "backend": "auto", "bpm_min": "90", "path_like": "packs", "edited": "no"})))


def _postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tags = _tags(spark, d)
    return checkpointed(postings.terms_of(tags)), checkpointed(postings.grams_of(tags))


@register("select distinct path from lib_tags where (',' || array_to_string(instruments, ',') || ',') ilike '%,d_ums,ki%,%'")
def posting_instrument(spark: SparkSession, d: str) -> DataFrame:
    return postings.with_instrument(_postings(spark, d)[0], "D_ums,ki%")


@register("select distinct path from lib_tags where genres_json ilike '%\"genre\":\"techno\"%'")
def posting_genre(spark: SparkSession, d: str) -> DataFrame:
    return postings.with_genre(_postings(spark, d)[0], "Techno")


@register("select distinct path from lib_tags where path ilike '%Loops/k_ck%1_0%'")
def posting_path_like(spark: SparkSession, d: str) -> DataFrame:
    return postings.with_path_like(_postings(spark, d)[1], "Loops/k_ck%1_0")


@register("select distinct path from lib_tags where path ilike '%Samples/_ouse%' and (',' || array_to_string(instruments, ',') || ',') ilike '%,drums,%' and genres_json ilike '%\"genre\":\"house\"%'")
def posting_combined(spark: SparkSession, d: str) -> DataFrame:
    return postings.matching(*_postings(spark, d), instrument="drums", genre="House", path_like="Samples/_ouse")


@register(f"select path, category, bpm from lib_tags where category <> '' order by bpm asc nulls first, path limit 50")
def catalog_order_limit(spark: SparkSession, d: str) -> DataFrame:
    return catalog.query(_tags(spark, d).where("category <> ''"), order="bpm", limit=50).select("path", "category", "bpm")


@register(f"{SHOWN} where path = (select max(path) from lib_tags)")
def catalog_point_get(spark: SparkSession, d: str) -> DataFrame:
    tags = _tags(spark, d)
    return _shown(tags.join(tags.agg(F.max("path").alias("path")), "path", "left_semi"))


@register("select category, count(*) as n from lib_tags group by category")
def catalog_group_category(spark: SparkSession, d: str) -> DataFrame:
    projected(spark, d, "lib_tags").createOrReplaceTempView("tags")
    return spark.sql("select category, count(*) as n from tags group by category")


@register(
    "select path, len(list_filter(cast(json_extract(genres_json, '$[*].genre') as varchar[]), lambda g: g is not null)) as n_genres, coalesce(cast(json_extract(genres_json, '$[0].score') as double), 0) as top_score from lib_tags"
)
def stored_genres(spark: SparkSession, d: str) -> DataFrame:
    genres = F.col("genres")
    return _tags(spark, d).select("path", F.size(genres).cast("long").alias("n_genres"), F.coalesce(F.get(genres, F.lit(0))["score"], F.lit(0.0)).alias("top_score"))


# --- collections ---------------------------------------------------------------------------------


def _collections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Collections of market segments with an empty one, and their members; some paths dangle."""
    made = projected(spark, d, "lib_collections").distinct().unionByName(spark.createDataFrame([("EMPTY",)], "name string"))
    collections = made.select(F.crc32(F.col("name").cast("binary")).alias("id"), "name", F.lit(0.0).alias("created_at"))
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    members = projected(spark, d, "lib_members").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    members = members.select(F.crc32(F.col("c_mktsegment").cast("binary")).alias("collection_id"), "path").distinct().withColumn("added_at", F.lit(0.0))
    return collections, members


MEMBERS = "members as (select distinct c_mktsegment as name, path from lib_members join customer on o_custkey = c_custkey), names as (select distinct name from lib_collections union select 'EMPTY')"


@register(f"with {MEMBERS} select names.name, count(path) as n from names left join members on names.name = members.name group by 1")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collection_counts(*_collections(spark, d)).select("name", F.col("count").alias("n"))


@register(f"with {MEMBERS} {SHOWN} where path in (select path from members where name = 'BUILDING') and kind = 'loop'")
def collection_semi(spark: SparkSession, d: str) -> DataFrame:
    collections, members = _collections(spark, d)
    return _shown(catalog.query(_tags(spark, d), collection=catalog.member_paths(collections, members, "BUILDING"), kind="loop"))


@register(f"with {MEMBERS}, added as (select * from members union select 'EMPTY', path from lib_members union select 'BUILDING', path from lib_members where o_orderkey % 7 = 0) select name, count(*) as n from added group by 1")
def collection_add(spark: SparkSession, d: str) -> DataFrame:
    collections, members = _collections(spark, d)
    ids = {n: F.crc32(F.lit(n).cast("binary")) for n in ("EMPTY", "BUILDING")}
    paths = projected(spark, d, "lib_members")
    new = paths.select(ids["EMPTY"].alias("collection_id"), "path").unionByName(paths.where("o_orderkey % 7 = 0").select(ids["BUILDING"].alias("collection_id"), "path")).withColumn("added_at", F.lit(1.0))
    total = catalog.add_members(members, new).groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(total, F.col("id") == F.col("collection_id")).select("name", "n")


@register(f"with {MEMBERS} select name, count(*) as n from members where not (name = 'BUILDING' and path in (select path from lib_members where o_orderkey % 3 = 0)) group by 1")
def collection_remove(spark: SparkSession, d: str) -> DataFrame:
    collections, members = _collections(spark, d)
    gone = projected(spark, d, "lib_members").where("o_orderkey % 3 = 0").select(F.crc32(F.lit("BUILDING").cast("binary")).alias("collection_id"), "path")
    total = catalog.remove_members(members, gone).groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(total, F.col("id") == F.col("collection_id")).select("name", "n")


@register(f"with {MEMBERS} select names.name, count(path) as n from names left join members on names.name = members.name where names.name <> 'MACHINERY' group by 1")
def collection_cascade(spark: SparkSession, d: str) -> DataFrame:
    collections, members = catalog.delete_collection(*_collections(spark, d), "MACHINERY")
    return catalog.collection_counts(collections, members).select("name", F.col("count").alias("n"))


@register("select c as category, count(path) as n from (select distinct unnest(cast([" + duck.items(T.all_categories()) + "] as varchar[])) as c) left join lib_tags on category = c group by c")
def category_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every category of any kind, with the number of tag rows that have it."""
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*[names.strings(v) for v in T.CATEGORIES.values()]))))
    used = projected(spark, d, "lib_tags").groupBy("category").agg(F.count("*").alias("used"))
    return spark.range(1).select(F.explode(every).alias("category")).join(used, "category", "left").select("category", F.coalesce("used", F.lit(0)).alias("n"))


# --- catalog writes ------------------------------------------------------------------------------


def _old(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_snapshot").where("rest < 2").drop("rest")


FRESH = "coalesce(old.path is not null and (old.edited or (lib_files.mtime is not null and old.mtime = lib_files.mtime and old.backend in ('auto', 'clap'))), false)"


@register(f"with old as (select * from lib_snapshot where rest < 2) select file_id, lib_files.path, {FRESH} as cached from lib_files left join old on lib_files.path = old.path")
def freshness_split(spark: SparkSession, d: str) -> DataFrame:
    return catalog.fresh(projected(spark, d, "lib_files"), _old(spark, d), ["auto", "clap"]).select("file_id", "path", "cached")


def _new(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_snapshot").where("rest > 0").select("path", F.lit(9.0).alias("mtime"), F.lit("clap").alias("backend"), F.lit(True).alias("edited"), F.upper("category").alias("category"))


@register("select path, case when rest > 0 then 9.0::double else mtime end as mtime, case when rest > 0 then 'clap' else backend end as backend, case when rest = 2 then false else edited end as edited, case when rest > 0 then upper(category) else category end as category from lib_snapshot")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return catalog.upsert(_old(spark, d), _new(spark, d))


@register(
    "with old as (select * from lib_snapshot where rest < 2), target as (select min(path) as path from old) select path, case when path in (select path from target) then 'kick' else category end as category, "
    "case when path in (select path from target) then 91.5::double else null end as bpm, coalesce(edited or path in (select path from target), false) as edited from old union all select '/new/one.wav', 'kick', 91.5::double, true"
)
def update_marks_edited(spark: SparkSession, d: str) -> DataFrame:
    old = catalog.migrated(_old(spark, d))
    target = old.agg(F.min("path")).first()[0]
    once = catalog.update(old, target, {"category": "kick", "bpm": 91.5}, 1.0)
    return catalog.update(once, "/new/one.wav", {"category": "kick", "bpm": 91.5}, 1.0).select("path", "category", "bpm", "edited")


@register("select path, category from lib_snapshot where rest = 0")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.delete(_old(spark, d), projected(spark, d, "lib_snapshot").where("rest = 1")).select("path", "category")


@register("select path, backend, false as edited, 0 as n_genres, cast(null as double) as bpm from lib_snapshot where rest < 2")
def migrate_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.migrated(_old(spark, d).drop("edited")).select("path", "backend", "edited", F.size("genres").alias("n_genres"), "bpm")


# --- captions ------------------------------------------------------------------------------------


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_captions")


LOW = "with c as (select *, lower(caption) as low from lib_captions)"


@register(f"{LOW} select file_id, kind, array_to_string(list_transform({duck.ranked_by_kind('kind', 'low')}, lambda s: s.term || ':' || cast(-s.rank as varchar)), ' ') as ranking from c where caption is not null")
def caption_category_rank(spark: SparkSession, d: str) -> DataFrame:
    found = caption_index.with_terms(_captions(spark, d).where("caption is not null"))
    shown = F.transform("ranking", lambda s: F.concat(s["term"], F.lit(":"), (-s["rank"]).cast("string")))
    return found.select("file_id", "kind", F.array_join(shown, " ").alias("ranking"))


@register(f"{LOW} select file_id, array_to_string({duck.matched('low', T.INSTRUMENTS)}[1:4], ',') as instruments from c where caption is not null")
def caption_instruments(spark: SparkSession, d: str) -> DataFrame:
    found = caption_index.with_terms(_captions(spark, d).where("caption is not null"))
    return found.select("file_id", F.array_join(F.slice("instruments", 1, T.INSTRUMENT_CAP), ",").alias("instruments"))


GENRES_OF = f"{LOW}, g as (select file_id, {duck.ranked('low', T.GENRES, by_place=False)}[1:3] as top from c where caption is not null)"


@register(f"{GENRES_OF} select file_id, s.term as genre, round(0.6::double * -s.rank / total, 3) as score from (select file_id, unnest(top) as s, list_sum(list_transform(top, lambda z: -z.rank)) as total from g)")
def caption_genres(spark: SparkSession, d: str) -> DataFrame:
    found = caption_index.with_terms(_captions(spark, d).where("caption is not null"))
    return found.select("file_id", F.explode(captions.genre_shares(F.col("genre_counts"))).alias("g")).select("file_id", "g.genre", "g.score")


@register(
    f"{LOW}, r as (select file_id, kind, caption, {duck.ranked_by_kind('kind', 'low')}[1].term as best, {duck.matched('low', T.INSTRUMENTS)}[1:4] as ins from c), s as (select *, {duck.from_instruments('kind', 'ins')} as derived from r) "
    "select file_id, case when caption <> '' then coalesce(best, derived, 'fx') end as category, case when caption <> '' then case when best is not null then 0.7 when derived is not null then 0.5 else 0.3 end end::double as confidence from s"
)
def caption_recognition(spark: SparkSession, d: str) -> DataFrame:
    return caption_index.with_verdicts(_captions(spark, d)).select("file_id", "verdict.category", "verdict.confidence")


@register(f"{LOW}, r as (select file_id, kind, {duck.matched('low', T.INSTRUMENTS)} as ins from c where caption is not null) select file_id, {duck.from_instruments('kind', 'ins')} as category from r")
def instrument_to_category(spark: SparkSession, d: str) -> DataFrame:
    found = caption_index.with_terms(_captions(spark, d).where("caption is not null"))
    return found.select("file_id", captions.category_from_instruments(F.col("instruments"), F.col("kind")).alias("category"))


# --- similarities --------------------------------------------------------------------------------


def _prompts(spark: SparkSession, d: str) -> list[list[float]]:
    """Scaled mean vector of each label, standing for label embeddings: a matrix bounded by the vocabulary."""
    rows = projected(spark, d, "lib_signal").select("label", F.posexplode("y").alias("at", "v")).groupBy("label", "at").agg(F.round(4 * F.avg("v"), 6).alias("v")).collect()
    width = max((r["at"] for r in rows), default=-1) + 1
    out = [[0.0] * width for _ in range(LABELS)]
    for r in rows:
        out[r["label"]][r["at"]] = r["v"]
    return out


PROMPTS = (
    "flat as (select label, unnest(y) as v, generate_subscripts(y, 1) as k from lib_signal), means as (select label, k, round(4 * avg(v), 6) as v from flat group by 1, 2), prompts as (select label, list(v order by k) as p from means group by 1), "
    "sims as (select s.file_id, p.label, list_inner_product(cast(s.y as double[]), p.p) as sim from lib_signal s cross join prompts p)"
)
LABEL_NAMES = [f"label{i}" for i in range(LABELS)]


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_signal").select("file_id", similarity.similarities(F.col("y"), _prompts(spark, d)).alias("sims"))


@register(f"with {PROMPTS} select file_id, 'label' || arg_max(label, sim) as category, round(max(sim), 6) as similarity from sims group by 1")
def sim_category_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("file_id", similarity.best_label(F.col("sims"), LABEL_NAMES).alias("category"), F.round(F.array_max("sims"), 6).alias("similarity"))


@register(
    f"with {PROMPTS}, r as (select *, row_number() over (partition by file_id order by sim desc, label) as rn, max(sim) over (partition by file_id) as top from sims), k as (select * from r where sim >= 0.5 * top or rn = 1) "
    "select file_id, string_agg('label' || label, ',' order by rn) as instruments from (select *, row_number() over (partition by file_id order by rn) as kn from k) where kn <= 4 group by 1"
)
def sim_instrument_topk(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select("file_id", F.array_join(similarity.top_labels(F.col("sims"), LABEL_NAMES), ",").alias("instruments"))


@register(
    f"with {PROMPTS}, t as (select *, max(sim) over (partition by file_id) as top from sims), w as (select *, exp((sim - top) / 0.04) as w from t), p as (select *, w / sum(w) over (partition by file_id) as prob, row_number() over (partition by file_id order by sim desc, label) as rn from w) "
    "select file_id, 'label' || label as genre, round(prob, 3) as score from p where top >= 0.22 and prob >= 0.15 and rn <= 3"
)
def sim_genre_softmax(spark: SparkSession, d: str) -> DataFrame:
    ranked = similarity.rank_genres(F.col("sims"), LABEL_NAMES)
    return _similar(spark, d).select("file_id", F.explode(ranked).alias("g")).select("file_id", "g.genre", "g.score")


# --- rules ---------------------------------------------------------------------------------------


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = projected(spark, d, "lib_features")
    return rows.withColumn("f", F.struct(*[c for c in rows.columns if c not in ("file_id", "part", "kind")]))


@register(f"select file_id, part, {duck.oneshot()} as category from lib_features")
def heuristic_oneshot(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("file_id", "part", rules.classify_oneshot(F.col("f")).alias("category"))


@register(f"select file_id, part, {duck.warp()} as warp, case {duck.warp()} " + " ".join(f"when {duck.q(k)} then {duck.q(v)}" for k, v in T.WARP_CATEGORY.items()) + " end as category from lib_features")
def heuristic_warp(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("file_id", "part", rules.warp_mode(F.col("f")).alias("warp"), rules.classify_loop(F.col("f")).alias("category"))


@register(
    f"with v as (select case when kind in ('loop', 'recording') then case {duck.warp()} " + " ".join(f"when {duck.q(k)} then {duck.q(v)}" for k, v in T.WARP_CATEGORY.items()) + f" end else {duck.oneshot()} end as category from lib_features) "
    f"select category, case when category in ('perc', 'drum') then 'drums' when category in ({duck.items(T.HEURISTIC_DRUMS)}) then array_to_string(list_sort([category, 'drums']), ',') when category in ({duck.items(T.HEURISTIC_SELF)}) then category else '' end as instruments, count(*) as n from v group by 1, 2"
)
def heuristic_instruments(spark: SparkSession, d: str) -> DataFrame:
    verdict = _features(spark, d).select(rules.recognise_features(F.col("f"), F.col("kind")).alias("v"))
    return verdict.groupBy("v.category", F.array_join("v.instruments", ",").alias("instruments")).agg(F.count("*").alias("n"))


# --- merge and fuse ------------------------------------------------------------------------------

LONG = "long as (select file_id, v.*, pos from (select file_id, unnest([v0, v1, v2]) as v, unnest([0, 1, 2]) as pos from lib_votes) where v is not null)"
BEST_GENRES = (
    "genre_rows as (select file_id, g.genre, g.score, g.source, pos * 100 + gi as k from (select file_id, pos, unnest(genres) as g, generate_subscripts(genres, 1) as gi from long)), "
    "genre_best as (select file_id, genre, arg_max({'score': score, 'source': source}, score * 1000000 - k) as b, min(k) as first_at from genre_rows group by 1, 2)"
)
VOTES = (
    f"with {LONG}, votes as (select file_id, category, count(*) as n, max(confidence) as top, min(pos) as first_pos from long group by 1, 2), "
    "voted as (select file_id, max(n) as most, arg_min(category, (case when n >= 2 then 0 else 1 end, -n, -top, first_pos)) as category from votes group by 1), "
    "single as (select file_id, arg_min(category, (-confidence, case source when 'ace-step' then 0 when 'clap' then 1 else 2 end)) as category from long group by 1), "
    "merged as (select l.file_id, case when any_value(v.most) >= 2 then any_value(v.category) else any_value(s.category) end as category, max(l.confidence) as confidence, string_agg(distinct l.source, '+' order by l.source) as source, "
    "arg_min(case when l.caption <> '' then l.caption end, l.pos) filter (where l.caption <> '') as caption from long l join voted v on l.file_id = v.file_id join single s on l.file_id = s.file_id group by 1), "
    "ins as (select file_id, instrument, min(k) as k from (select file_id, unnest(instruments) as instrument, pos * 100 + generate_subscripts(instruments, 1) as k from long) group by 1, 2), "
    "inl as (select file_id, list(instrument order by k) as instruments from ins group by 1)"
)


@register(f"{VOTES} select file_id, category, confidence, source, caption, array_to_string(instruments, ',') as instruments from merged join inl using (file_id)")
def merge_votes(spark: SparkSession, d: str) -> DataFrame:
    # a generator computes the merged verdict once for all of its fields and leaves rows without one out
    shown = projected(spark, d, "lib_votes").select("file_id", F.inline(F.array_compact(F.array(fusion.merge(F.array("v0", "v1", "v2"))))))
    # a single verdict is passed on unchanged, repeats and all
    return shown.select("file_id", "category", "confidence", "source", "caption", F.array_join(F.array_distinct("instruments"), ",").alias("instruments"))


@register(f"with {LONG}, {BEST_GENRES} select file_id, genre, b.score as score, b.source as source, cast(row_number() over (partition by file_id order by b.score desc, first_at) as int) as place from genre_best")
def dedupe_genres(spark: SparkSession, d: str) -> DataFrame:
    present = F.filter(F.array("v0", "v1", "v2"), lambda v: v.isNotNull())
    entries = F.flatten(F.transform(present, lambda v: v["genres"]))
    out = projected(spark, d, "lib_votes").select("file_id", F.posexplode(fusion.dedupe_genres(entries)).alias("at", "g"))
    return out.select("file_id", "g.genre", "g.score", "g.source", (F.col("at") + 1).alias("place"))


@register(
    f"{VOTES}, {duck.named()}, joined as (select n.*, m.category as mcategory, m.confidence as mconfidence, m.caption as mcaption, coalesce(i.instruments, cast([] as varchar[])) as minstruments, m.file_id is not null as has from named n left join merged m using (file_id) left join inl i using (file_id)), "
    "fused as (select *, coalesce(ncategory, mcategory) as category, list_concat(ninstruments, list_filter(minstruments, lambda x: not list_contains(ninstruments, x))) as every from joined) "
    f"select path, {duck.resolve_kind('nkind', 'ncategory', 'nbpm', 'duration')} as kind, category, array_to_string(list_filter(every, lambda x: category is null or x <> category), ',') as instruments, nnote as key, nscale as scale, nbpm as bpm, "
    "greatest(nconfidence, coalesce(mconfidence, 0)) as confidence, mcaption as caption, 'auto' as backend from fused"
)
def fuse_tags(spark: SparkSession, d: str) -> DataFrame:
    files = path_names.with_names(projected(spark, d, "lib_files"), name=scan.NAME).join(projected(spark, d, "lib_votes"), "file_id")
    made = scan.classify(files, F.array("v0", "v1", "v2"), "auto")
    return made.select("path", "kind", "category", F.array_join("instruments", ",").alias("instruments"), "key", "scale", "bpm", "confidence", "caption", "backend")


# --- scan ----------------------------------------------------------------------------------------


@register(f"with {duck.named('lib_tags', keep='path, category, instruments')} select path, {duck.escalates('instruments', 'category', 'label')} as escalate from named")
def escalation(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_tags").select("path", rules.needs_escalation(F.col("instruments"), F.col("category"), F.col("path"), F.lit(None).cast("string")).alias("escalate"))


@register(
    f"with old as (select * from lib_snapshot where rest < 2), {duck.named()}, known as (select n.*, old.path is not null as k, {FRESH.replace('lib_files.', 'n.')} as cached, old.backend as obackend, old.category as ocategory, old.edited as oedited from named n left join old on n.path = old.path), "
    f"st as (select *, case when cached and {duck.escalates('cast([] as varchar[])', 'ocategory', 'label')} and obackend = 'auto' and not oedited then 'escalate' when cached then 'cached' else 'classify' end as status from known), "
    f"one as (select *, {duck.escalates('list_filter(ninstruments, lambda x: ncategory is null or x <> ncategory)', 'ncategory', 'label')} as lost from st) "
    "select path, status, case when status = 'cached' then ocategory when status = 'escalate' or lost then 'second' else ncategory end as category from one"
)
def progressive_scan(spark: SparkSession, d: str) -> DataFrame:
    files = projected(spark, d, "lib_files").select("path", "mtime", "duration")
    old = _old(spark, d).withColumn("instruments", F.array().cast("array<string>"))
    first = lambda df: scan.classify(df, None, "auto")
    second = lambda df: scan.classify(df, None, "clap").withColumn("category", F.lit("second"))
    stored, status = scan.progressive(files, old, first, second, primary="auto", second_name="clap", keep=checkpointed, carry={"category": "__old"})
    made = stored.select("path", F.col("category").alias("__new"))
    return status.join(made, "path", "left").select("path", "status", F.when(F.col("status") == "cached", F.col("__old")).otherwise(F.col("__new")).alias("category"))


@register(
    f"with old as (select * from lib_snapshot where rest < 2), {duck.named()}, known as (select n.*, {FRESH.replace('lib_files.', 'n.')} as cached, old.backend as obackend, old.category as ocategory, old.edited as oedited from named n left join old on n.path = old.path), "
    f"st as (select *, case when cached and {duck.escalates('cast([] as varchar[])', 'ocategory', 'label')} and obackend = 'auto' and not oedited then 'escalate' when cached then 'cached' else 'classify' end as status from known), "
    f"one as (select *, {duck.escalates('list_filter(ninstruments, lambda x: ncategory is null or x <> ncategory)', 'ncategory', 'label')} as lost from st) "
    "select count_if(status = 'classify') as classified, count_if(status = 'cached') as cached, count_if(status = 'escalate' or status = 'classify' and lost) as escalated from one"
)
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    files = projected(spark, d, "lib_files").select("path", "mtime", "duration")
    old = _old(spark, d).withColumn("instruments", F.array().cast("array<string>"))
    counts = scan.ScanCounts()  # filled by the writes of the scan itself
    scan.progressive(files, old, lambda df: scan.classify(df, None, "auto"), lambda df: scan.classify(df, None, "clap"), primary="auto", second_name="clap", keep=checkpointed, counts=counts)
    return scan.summary(spark, counts)


@register("select path, mtime from lib_files union select path, mtime + 1 as mtime from lib_files where file_id % 5 = 0")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Three listings, the second with a fifth of the files changed, the third as the second: what comes through the stream, which goes on after each.

    A listing is as many files as it was written by, so batches are counted by listings (of up to a thousand files), not by files.
    """
    files = projected(spark, d, "lib_files").select("path", "mtime", F.lit(0).cast("long").alias("length"), "file_id")
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    later = files.withColumn("mtime", F.when(F.col("file_id") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    for listing in (files, later, later):
        ingest.announce(listing, f"{folder}/log")
        ingest.changes(spark, f"{folder}/log").writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("path", "mtime")


@register("select file_id, cast(floor((row_number() over (order by coalesce(duration, 0), file_id) - 1) / 8) as bigint) as batch from lib_files")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    return scan.length_batches(projected(spark, d, "lib_files").select("file_id", "duration"), 8).select("file_id", "batch")


@register(
    "with c as (select *, greatest(coalesce(duration, 1), 1) as known from lib_files), k as (select *, cast(ceil(log2(known) * 4 - 1e-9::double) as int) as class from c), "
    "l as (select *, pow(2, class / 4.0::double) as length, row_number() over (partition by class order by known, file_id) - 1 as place from k), "
    "b as (select *, floor(place / greatest(1, least(8, floor(60.0::double / length + 1e-9::double))))::bigint as batch from l) "
    "select round(length, 6) as length, batch, count(*) as clips, round(count(*) * length, 6) as padded, round(count(*) * length - sum(known), 6) as padding from b group by class, length, batch"
)
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """What model batches of at most 8 clips and 60 padded seconds hold, and how much of it is padding."""
    files = projected(spark, d, "lib_files").select("file_id", "duration")
    known = F.greatest(F.coalesce("duration", F.lit(1.0)), F.lit(1.0))
    by_batch = scan.packed_batches(files, 60.0, 8, "file_id").groupBy("length", "batch").agg(F.count("*").alias("clips"), F.sum(known).alias("known"))
    padded = F.col("clips") * F.col("length")
    return by_batch.select(F.round("length", 6).alias("length"), "batch", "clips", F.round(padded, 6).alias("padded"), F.round(padded - F.col("known"), 6).alias("padding"))


@register("select digest, ext, count(*) as n from (select distinct sha1(event_type || (event_id % 500)::varchar) as digest, case when event_id % 3 = 0 then '.wav' else '.mp3' end as ext from events) where digest not in (select sha1('click' || i::varchar) from range(0, 100) t(i)) group by 1, 2")
def import_dedupe_sha1(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    content = F.concat("event_type", (F.col("event_id") % 500).cast("string")).cast("binary")
    uploads = events.select(content.alias("content"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit("Take.MP3")).alias("name"))
    clicks = spark.range(100).select(F.sha1(F.concat(F.lit("click"), F.col("id").cast("string"))).alias("digest"))
    stored = reduce(DataFrame.unionByName, [clicks.withColumn("ext", F.lit(e)) for e in (".wav", ".mp3")])
    return scan.import_blobs(uploads, stored).groupBy("digest", "ext").agg(F.count("*").alias("n"))


@register(
    "with u as (select sha1(event_type || (event_id % 500)::varchar) as digest, case when event_id % 3 = 0 then '' else 'My kick ' || event_type || '.WAV' end as filename, '.wav' as ext from events), "
    "one as (select digest, ext, max(filename) as filename from u group by 1, 2) select '/blobs/' || digest || ext as path, filename, case when filename <> '' then 'kick' end as category from one"
)
def import_rows(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    content = F.concat("event_type", (F.col("event_id") % 500).cast("string")).cast("binary")
    uploads = events.select(content.alias("content"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("My kick "), "event_type", F.lit(".WAV"))).alias("name"))
    first = lambda df: scan.classify(df.select("path", "mtime", F.lit(None).cast("double").alias("duration")), None, "auto")
    return scan.imported(uploads, "/blobs", first).select("path", "filename", "category")


# --- signals -------------------------------------------------------------------------------------


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return projected(spark, d, "lib_signal").withColumn("y", F.transform("y", lambda v: v.cast("double")))


SIGNAL = "with s as (select file_id, cast(y as double[]) as y from lib_signal)"


@register(f"{SIGNAL} select file_id, round(list_sum(list_transform(range(2, len(y) + 1), lambda i: case when (y[i] < 0) <> (y[i - 1] < 0) then 1.0 else 0.0 end))::double / len(y), 6) as zcr from s")
def signal_zcr(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d).select("file_id", F.round(signal.zero_crossing_rate(F.col("y")), 6).alias("zcr"))


@register(f"{SIGNAL}, a as (select file_id, list_transform(y, lambda v: abs(v)) as m from s) select file_id, round(log10(greatest((list_position(m, list_max(m)) - 1)::double / 44100, 0.0001)), 6) as attack from a")
def signal_attack(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d).select("file_id", F.round(signal.log_attack_time(F.col("y"), 44100), 6).alias("attack"))


@register(f"{SIGNAL}, p as (select file_id, list_filter(y, lambda v: v > 0) as y from s) select file_id, round(case when len(y) >= 2 then list_aggregate(y, 'stddev_pop') / list_avg(y) else 1.0 end, 6) as cv from p")
def signal_cv(spark: SparkSession, d: str) -> DataFrame:
    voiced = F.transform("y", lambda v: F.when(v > 0, v))
    return _signal(spark, d).select("file_id", F.round(signal.pitch_stability(voiced), 6).alias("cv"))


@register(f"{SIGNAL}, e as (select file_id, list_sum(list_transform(y[1:32], lambda v: v * v)) as a, list_sum(list_transform(y[33:64], lambda v: v * v)) as b from s) select file_id, round(a + b, 6) as energy, round(case when a + b > 0 then a / (a + b) else 0 end, 6) as ratio from e")
def signal_energy(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    return _signal(spark, d).select("file_id", F.round(signal.energy(y), 6).alias("energy"), F.round(signal.energy_ratio(F.slice(y, 1, 32), F.slice(y, 33, 32)), 6).alias("ratio"))


def _profiles() -> str:
    rows = []
    for shift in range(12):
        for order, (scale, profile) in enumerate((("major", T.MAJOR_PROFILE), ("minor", T.MINOR_PROFILE))):
            rolled = [profile[(i - shift) % 12] for i in range(12)]
            rows += [f"({2 * shift + order}, {duck.q(T.PITCH_CLASSES[shift])}, {duck.q(scale)}, {i}, {v}::double)" for i, v in enumerate(rolled)]
    return "profiles(o, key, scale, i, v) as (values " + ", ".join(rows) + ")"


@register(f"{SIGNAL}, {_profiles()}, x as (select file_id, i, y[i + 1] as c from s, range(0, 12) t(i)), r as (select file_id, o, key, scale, corr(c, v) as r from x join profiles using (i) group by 1, 2, 3, 4) select file_id, arg_min(key, (-round(r, 9), o)) as key, arg_min(scale, (-round(r, 9), o)) as scale from r group by 1")
def signal_key_corr(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d).select("file_id", signal.detect_key(F.slice("y", 1, 12)).alias("k")).select("file_id", "k.key", "k.scale")


@register(
    f"{SIGNAL}, m as (select file_id, list_transform(range(0, 24 * 8 + len(y)), lambda t: list_sum(list_transform(range(0, 8), lambda k: case when t - k * 24 >= 0 and t - k * 24 < len(y) then y[t - k * 24 + 1] else 0.0 end))) as b from s), p as (select file_id, b, list_max(list_transform(b, lambda v: abs(v))) as peak from m) "
    "select file_id, len(b) as n, round(list_sum(list_transform(b, lambda v: v * v)) / (peak * peak), 6) as energy, round(b[30] / peak, 6) as at30 from p"
)
def signal_four_on_floor(spark: SparkSession, d: str) -> DataFrame:
    made = _signal(spark, d).select("file_id", signal.four_on_the_floor(F.col("y"), 24, 8).alias("b"))
    return made.select("file_id", F.size("b").cast("long").alias("n"), F.round(signal.energy(F.col("b")), 6).alias("energy"), F.round(F.get("b", F.lit(29)), 6).alias("at30"))


def queries() -> dict:
    from . import audio_queries

    return QUERIES | frame_queries.QUERIES | audio_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import audio_queries

    return ORACLES | frame_queries.ORACLES | audio_queries.ORACLES
