"""DuckDB spellings of the library's rules, for the oracle queries."""

from __future__ import annotations

import re

from ..functions import taxonomy as T


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def items(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def listed(values: list[str]) -> str:
    return f"cast([{items(values)}] as varchar[])"


def first(expr: str) -> str:
    """First non-null of a list."""
    return f"list_filter({expr}, lambda z: z is not null)[1]"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def re2(pattern: str) -> str:
    """A fixed pattern for an engine without look-around: what stands beside a match becomes part of it, so groups move up by one."""
    beside = re.sub(r"\(\?<!\[([^]]*)\]\)", r"(^|[^\1])", pattern)
    beside = re.sub(r"\(\?!\[([^]]*)\]\)", r"($|[^\1])", beside)
    return beside.replace(r"(?=\b)", r"\b")


ONE_SHOT, RECORDING, ONE_SHOT_IN_FILENAME = re2(T.ONE_SHOT), re2(T.RECORDING), re2(T.ONE_SHOT_IN_FILENAME)
EXPLICIT_BPM, BARE, BARE_IN_FILENAME = f"(?i){T.EXPLICIT_BPM}", re2(T.BARE_NUMBER), re2(T.BARE_NUMBER_IN_FILENAME)
KEY, KEY_SHARP_S = re2(T.KEY), re2(T.KEY_SHARP_S)


def kind_of(x: str) -> str:
    return f"case when contains(lower({x}), 'loop') then 'loop' when regexp_matches(lower({x}), {q(ONE_SHOT)}) then 'one-shot' when regexp_matches(lower({x}), {q(RECORDING)}) then 'recording' end"


def label_of(x: str) -> str:
    return "case " + " ".join(f"when {has_any(f'lower({x})', words)} then {q(label)}" for label, words in T.CATEGORY_RULES) + " end"


def bpm_of(x: str) -> str:
    named = f"try_cast(coalesce(nullif(regexp_extract({x}, {q(EXPLICIT_BPM)}, 1), ''), nullif(regexp_extract({x}, {q(EXPLICIT_BPM)}, 2), '')) as double)"
    bare = f"try_cast(nullif(regexp_extract({x}, {q(BARE)}, 2), '') as double)"
    return f"case when {named} between 40 and 220 then {named} when {bare} between 60 and 200 then {bare} end"


def key_of(x: str) -> str:
    def made(pattern: str, note: str) -> str:
        scale = f"lower(regexp_extract({x}, {q(pattern)}, 3))"
        return f"{{'key': {note}, 'scale': case when starts_with({scale}, 'maj') then 'major' when starts_with({scale}, 'm') then 'minor' end, 'confidence': case when {scale} <> '' then 0.9::double else 0.6::double end}}"

    plain, sharp = f"regexp_extract({x}, {q(KEY)}, 2)", f"regexp_extract({x}, {q(KEY_SHARP_S)}, 2)"
    flats = "case " + plain + " " + " ".join(f"when {q(a)} then {q(b)}" for a, b in T.FLATS.items()) + f" else {plain} end"
    sharps = f"case {sharp} || '#' " + " ".join(f"when {q(a)} then {q(b)}" for a, b in T.NAMED_SHARPS.items()) + f" else {sharp} || '#' end"
    return f"case when {plain} <> '' then {made(KEY, flats)} when {sharp} <> '' then {made(KEY_SHARP_S, sharps)} end"


def fragments(path: str) -> str:
    parts = f"string_split({path}, '/')"
    return f"list_filter(list_concat(list_slice({parts}, 1, len({parts}) - 1), [regexp_replace({parts}[len({parts})], '^(.+)\\.[^.]+$', '\\1')]), lambda z: z <> '')"


def coarse(label: str) -> str:
    return f"case when {label} in ({items(T.MELODIC)}) then 'melodic' else {label} end"


def instruments_of(label: str, frs: str) -> str:
    low = f"regexp_replace(lower(array_to_string({frs}, ' ')), '[_\\-.]+', ' ', 'g')"
    return (
        f"case when {label} in ('drums', 'perc') then ['drums'] when {label} in ({items(T.DRUM_NAMES)}) then list_sort([{label}, 'drums']) when {label} in ({items(T.SELF_NAMES)}) then [{label}] "
        f"when {label} in ({items(T.FX_NAMES)}) then ['fx'] when {label} = 'vocal' and {has_any(low, T.SPOKEN_CUES)} then ['spoken'] "
        f"when {label} = 'vocal' and {has_any(low, T.SINGING_CUES)} then ['singing'] when {label} = 'vocal' then ['vocal'] else {listed([])} end"
    )


def confidence_of(kind: str, label: str, bpm: str, key: str) -> str:
    flags = f"({kind} is not null)::int::varchar || ({label} is not null)::int::varchar || ({bpm} is not null)::int::varchar || case when {key} is null then '0.0' when {key}.confidence = 0.9 then '0.9' else '0.6' end"
    return f"case {flags} " + " ".join(f"when {q(k)} then {v}::double" for k, v in T.name_confidences().items()) + " end"


def named(source: str = "lib_files", keep: str = "*") -> str:
    """CTEs ``parts`` and ``named`` over a table with ``path``: the whole name pass."""
    return f"""frs as (select {keep}, {fragments('path')} as frs from {source}),
parts as (select *, {first(f"list_transform(list_reverse(frs), lambda x: {kind_of('x')})")} as nkind, {first(f"list_transform(list_reverse(frs), lambda x: {label_of('x')})")} as label,
  {first(f"list_transform(list_reverse(frs), lambda x: {bpm_of('x')})")} as nbpm, list_filter(list_transform(list_reverse(frs), lambda x: {key_of('x')}), lambda z: z is not null) as keys from frs),
keyed as (select *, coalesce(list_filter(keys, lambda k: k.confidence = 0.9)[1], keys[1]) as nkey from parts),
named as (select *, {coarse('label')} as ncategory, nkey.key as nnote, nkey.scale as nscale, {instruments_of('label', 'frs')} as ninstruments, {confidence_of('nkind', 'label', 'nbpm', 'nkey')} as nconfidence from keyed)"""


def resolve_kind(kind: str, category: str, bpm: str, duration: str) -> str:
    bars = f"({duration} / (240.0::double / {bpm}))"
    near = f"list_sort([{', '.join(f'{{{chr(39)}off{chr(39)}: abs({n}::double - {bars}), {chr(39)}n{chr(39)}: {n}}}' for n in T.BAR_COUNTS)}])[1]"
    return (
        f"case when {kind} is not null then {kind} when {duration} <= 1.2 then 'one-shot' when {duration} >= 30 then 'recording' "
        f"when {bpm} <> 0 and {duration} is not null and {near}.off <= 0.06::double * {near}.n then 'loop' when {category} in ({items(T.KIND_DRUMS)}) then 'one-shot' else 'unknown' end"
    )


def word(term: str) -> str:
    from ..functions.captions import word_pattern

    return q(word_pattern(term, prefix=""))


def occurrences(low: str, term: str) -> str:
    return f"len(regexp_extract_all({low}, {word(term)}))"


def ranked(low: str, terms: list[str], by_place: bool = True) -> str:
    from ..functions.captions import word_pattern

    found = []
    for i, t in enumerate(terms):
        place = f"length(regexp_extract({low}, {q('(?s)^(.*?)' + word_pattern(t, prefix=''))}, 1)) + 1" if by_place else "0"
        found.append(f"{{'rank': -{occurrences(low, t)}, 'place': {place}, 'position': {i}, 'term': {q(t)}}}")
    return f"list_sort(list_filter([{', '.join(found)}], lambda s: s.rank < 0))"


def matched(low: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({low}, {word(t)}) then {q(t)} end" for t in terms) + "], lambda z: z is not null)"


def ranked_by_kind(kind: str, low: str) -> str:
    return f"case when {kind} = 'loop' then {ranked(low, T.CATEGORIES['loop'])} when {kind} = 'recording' then {ranked(low, T.CATEGORIES['recording'])} else {ranked(low, T.CATEGORIES['one-shot'])} end"


def from_instruments(kind: str, instruments: str) -> str:
    from ..functions.captions import _instrument_table

    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in _instrument_table().items())
    own = f"(case when {kind} in ('loop', 'recording') then {kind} else 'one-shot' end)"
    return first(f"list_transform({instruments}, lambda i: case {own} || '|' || i {cases} end)")


def oneshot(p: str = "") -> str:
    c, r, z, a, pr, v, s = (f"{p}{x}" for x in ("spectral_centroid", "spectral_rolloff", "zero_crossing_rate", "log_attack_time", "percussive_ratio", "voiced_ratio", "pitch_stability"))
    low, high = T.VOCAL_CENTROID
    return (
        f"case when {c} >= {T.HAT_CENTROID} and {r} >= {T.HAT_ROLLOFF} and {z} >= {T.NOISY} then 'hat' "
        f"when {z} < {T.LOW_CROSSINGS} and {c} <= {T.LOW_CENTROID} then case when {a} <= {T.FAST_ATTACK} or {pr} >= {T.PERCUSSIVE} then 'kick' else 'bass' end "
        f"when {pr} >= {T.PERCUSSIVE} and {z} >= {T.NOISY} and {a} <= {T.FAST_ATTACK} then case when {c} >= {T.CLAP_CENTROID} then 'clap' else 'snare' end "
        f"when {v} > {T.VOICED} and {c} between {low} and {high} and {s} >= {T.VOCAL_STABILITY} and not {pr} >= {T.PERCUSSIVE} then 'vocal' "
        f"when {v} > {T.VOICED} and {s} < {T.STEADY} then 'melodic' when {c} <= {T.BASS_CENTROID} then 'bass' when {pr} >= {T.PERCUSSIVE} then 'perc' else 'fx' end"
    )


def warp(p: str = "") -> str:
    t, pr, v, f, s = (f"{p}{x}" for x in ("transient_density", "percussive_ratio", "voiced_ratio", "formant_strength", "pitch_stability"))
    return (
        f"case when {t} > {T.WARP_DENSITY} and {pr} > {T.WARP_PERCUSSIVE} then 'beats' when {v} > {T.WARP_VOCAL} and {f} > {T.WARP_FORMANT} then 'vocal' "
        f"when {v} > {T.WARP_MELODIC} and {s} < {T.STEADY} then 'melodic' when {v} > {T.WARP_HARMONIC} and {s} >= {T.STEADY} then 'harmonic' else 'complex' end"
    )


def escalates(instruments: str, category: str, label: str) -> str:
    return f"(len({instruments}) = 0 and ({category} is null or {category} = '' or {category} in ({items(T.CATCHALL)}) or ({category} in ({items(T.GUESSED)}) and {label} is null)))"
