"""``lib_*`` projections: sample paths, captions, votes, features and signals spelled from key columns.

The driver's tables hold no audio and no sample vocabulary.  Each projection is one SQL select
over one table, written once and rendered for Spark and for DuckDB, by modular arithmetic and
list look-ups only, so that both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PACKS = ["Samples", "Packs", "Library", "Loopmasters Vol 2", "My Takes", "Splice", "field_rec", "Drum Kits"]
FOLDERS = ["House Loops", "One Shots", "Cm 124bpm", "Vocals", "Pads", "140bpm", "F#m Loops", "Misc"]
STEMS = [
    "bassline", "kick_punch", "clap loop", "synth_lead_stab", "G_maj_pad", "fx_riser_oneshot_Fm", "track01", "lead", "bass_loop", "Db major chord",
    "Ds_GoodlifeSoul", "Asmin_thing", "piano_jam", "snare hit", "open-hat", "tomtom", "crash_ride", "rimshot", "shaker perc", "sub_808",
    "reese_growl", "downlifter", "impact boom", "drone_Eb", "texture", "ambient_field", "foley_steps", "noise", "pluck_Am", "arp_Bbmaj7",
    "melody_Cmaj", "rhodes keys", "gtr_Es", "violin_Bs", "sax solo", "vox_talking", "acapella_hook", "voice-memo", "full_mix_take2", "custom_that_pride", "E#_hit",
]
SEPARATORS = ["_", " ", "-"]
SUFFIXES = ["bpm", "", "_loop", " BPM", "_take", "_hit", "_min"]
TERMS = ["bass", "drum", "piano", "kick", "snare", "vocals", "strings", "synthesizer", "pads", "cowbell", "hip hop", "techno", "techno", "house", "lo-fi", "jazz", "noise", "melody", "plucked", "shaker", "drums", "sub", "ambient", "d&b", "subtle", "snappy"]
CATEGORIES = ["kick", "bass", "melodic", "fx", "vocal", "perc"]
BACKENDS = ["clap", "ace-step", "heuristic"]
LABELS = 10


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which the two engines differ."""

    name: str

    def quote(self, s: str) -> str:
        return "'" + s.replace("'", "''" if self.name == "duckdb" else "\\'") + "'"

    def array(self, items: list[str]) -> str:
        return ("array(" + ", ".join(items) + ")") if self.name == "spark" else ("[" + ", ".join(items) + "]")

    def pick(self, values: list[str], index: str) -> str:
        """The value at a non-negative SQL index."""
        at = f"cast(({index}) % {len(values)} as int) + 1"
        made = self.array([self.quote(v) for v in values])
        return f"element_at({made}, {at})" if self.name == "spark" else f"list_extract({made}, {at})"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def epoch(self, column: str) -> str:
        """Seconds since 1970 of a timestamp without zone."""
        return f"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) / 1000000.0D)" if self.name == "spark" else f"(epoch_us({column}) / 1000000.0::DOUBLE)"

    def text(self, x: str) -> str:
        return f"cast({x} as {'string' if self.name == 'spark' else 'varchar'})"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def path_sql(d: Dialect, key: str) -> str:
    parts = [
        d.quote("/"), d.pick(PACKS, f"{key} % 8"), d.quote("/"), d.pick(FOLDERS, d.div(key, 8)), d.quote("/"), d.pick(STEMS, f"{key} % 41"),
        d.pick(SEPARATORS, d.div(key, 3)), d.text(f"40 + {key} % 190"), d.pick(SUFFIXES, f"{key} % 7"), d.quote("_"), d.text(key), d.quote(".wav"),
    ]
    return " || ".join(parts)


def caption_sql(d: Dialect, key: str) -> str:
    said = " || ".join([d.quote("A "), d.pick(TERMS, f"{key} % 26"), d.quote(" and "), d.pick(TERMS, d.div(key, 7)), d.quote(" loop with "), d.pick(TERMS, f"{key} * 5 + 3"), d.quote(", some "), d.pick(TERMS, d.div(key, 11))])
    return f"case when {key} % 13 = 0 then null when {key} % 17 = 0 then '' else {said} end"


def projections(d: Dialect) -> dict[str, tuple[str, str]]:
    """name -> (driver table, select list)."""
    kind = d.pick(["one-shot", "loop", "recording", "unknown"], "o_orderkey % 4")

    def verdict(backend: int, p: int, q: int) -> str:
        category = d.pick(CATEGORIES, f"event_id * {p} + {q}")
        inner = d.array([d.pick(["kick", "bass", "piano", "vocal"], f"event_id + {backend}"), d.pick(["drums", "bass", "pad"], d.div("event_id", 2))])
        fields = {"category": category, "instruments": inner, "source": d.quote(BACKENDS[backend]), "confidence": f"cast((event_id * {p + 2}) % 5 as double) / 4", "caption": f"case when event_id % 4 = {backend} then 'said ' || {d.text('event_id')} else null end"}
        genre = lambda name, n: (f"named_struct('genre', {name}, 'score', {n}, 'source', {d.quote(BACKENDS[backend])})" if d.name == "spark" else f"{{'genre': {name}, 'score': {n}, 'source': {d.quote(BACKENDS[backend])}}}")
        fields["genres"] = d.array([genre(d.pick(["house", "techno", "jazz"], f"event_id * {p}"), f"cast((event_id + {q}) % 7 as double) / 8"), genre(d.pick(["techno", "pop"], "event_id"), f"cast((event_id * {p}) % 9 as double) / 16")])
        made = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")" if d.name == "spark" else "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
        return f"case when (event_id + {q}) % 11 = 0 then null else {made} end"

    return {
        "lib_files": ("events", f"event_id as file_id, {path_sql(d, 'event_id')} as path, {d.epoch('ts')} as mtime, value / 10 as duration, user_id"),
        "lib_captions": ("orders", f"o_orderkey as file_id, {kind} as kind, {caption_sql(d, 'o_orderkey')} as caption"),
        "lib_votes": ("events", "event_id as file_id, " + ", ".join(f"{verdict(b, p, q)} as v{b}" for b, (p, q) in enumerate(((1, 0), (3, 1), (5, 4))))),
        "lib_features": (
            "lineitem",
            "l_orderkey as file_id, l_linenumber as part, "
            + ", ".join(
                [
                    "l_extendedprice / 10 as spectral_centroid", "l_extendedprice / 6 as spectral_rolloff", "l_discount * 3 as zero_crossing_rate", "-l_quantity / 20 as log_attack_time",
                    "l_tax * 12.5 as percussive_ratio", "cast(l_partkey % 11 as double) / 10 as voiced_ratio", "cast(l_suppkey % 13 as double) / 60 as pitch_stability",
                    "cast(l_partkey % 5 as double) as transient_density", "cast(l_suppkey % 3 as double) / 2 as formant_strength",
                ]
            )
            + f", {d.pick(['one-shot', 'loop', 'recording', 'unknown'], 'l_orderkey % 4')} as kind",
        ),
        "lib_signal": ("embeddings", "vec_id as file_id, label, embedding as y"),
        "lib_tags": (
            "events",
            f"event_id as file_id, {path_sql(d, 'event_id')} as path, {d.pick([*CATEGORIES, ''], 'event_id % 7')} as category, {d.pick(['loop', 'one-shot'], d.div('event_id', 5))} as kind, "
            f"case when event_id % 3 = 0 then null else {d.pick(['C', 'F#', 'A'], 'event_id')} end as key, case when event_id % 3 = 0 then null else {d.pick(['major', 'minor'], 'event_id')} end as scale, "
            f"case when event_id % 5 = 0 then null else cast(60 + event_id % 120 as double) end as bpm, {d.pick(['auto', 'heuristic', 'clap'], d.div('event_id', 4))} as backend, "
            f"case when event_id % 6 = 0 then {d.array([d.quote('drums'), d.quote('kick')])} when event_id % 6 = 1 then {d.array([d.quote('Bass')])} "
            f"else {'cast(array() as array<string>)' if d.name == 'spark' else 'cast([] as varchar[])'} end as instruments, "
            f"case when event_id % 4 = 0 then '[{{\"genre\":\"house\",\"score\":0.5}}]' when event_id % 4 = 1 then '[{{\"genre\":\"deep house\",\"score\":0.4}},{{\"genre\":\"techno\",\"score\":0.3}}]' else '[]' end as genres_json, "
            f"event_id % 10 = 0 as edited, {d.epoch('ts')} as mtime, value as confidence",
        ),
        # what a catalog of an earlier scan holds: other times, backends and edits for part of the files
        "lib_snapshot": (
            "events",
            f"{path_sql(d, 'event_id')} as path, case when event_id % 4 = 1 then {d.epoch('ts')} + 1 when event_id % 8 = 2 then null else {d.epoch('ts')} end as mtime, "
            f"{d.pick(['auto', 'heuristic', 'clap'], 'event_id')} as backend, event_id % 10 = 0 as edited, {d.pick(CATEGORIES, 'event_id + 1')} as category, event_id % 3 as rest",
        ),
        "lib_series": ("events", "user_id as clip, ts, event_id, value"),
        "lib_collections": ("customer", "c_mktsegment as name"),
        "lib_members": ("orders", f"o_custkey, o_orderkey, {path_sql(d, 'o_orderkey')} as path"),
    }


def projected(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame; only the columns it names are read."""
    table, select = projections(SPARK)[name]
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"sampleyard_{table}")
    return spark.sql(f"select {select} from sampleyard_{table}")


def with_projections(sql: str) -> str:
    """A DuckDB query preceded by the projections it names."""
    import re

    used = [n for n in projections(DUCKDB) if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} as (select {projections(DUCKDB)[n][1]} from {projections(DUCKDB)[n][0]})" for n in used]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body
