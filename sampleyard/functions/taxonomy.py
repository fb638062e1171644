"""Vocabularies and thresholds.  All are fixed values: results depend on their spelling and order."""

from __future__ import annotations

# --- fixed values: kinds and categories -------------------------------------------------------
KINDS = ["one-shot", "loop", "recording", "unknown"]
CATEGORIES = {
    "one-shot": ["kick", "snare", "clap", "snap", "hat", "tom", "crash", "ride", "rim", "perc", "bass", "808", "sub", "reese", "melodic", "vocal", "fx", "riser", "sweep", "impact", "drone", "texture", "ambience", "foley", "noise"],
    "loop": ["drum", "perc", "bass", "sub", "808", "melodic", "vocal", "fx", "riser", "texture", "ambience", "foley", "full"],
    "recording": ["full", "vocal", "instrument", "drum", "melodic", "ambience", "field", "foley", "fx"],
}

# --- fixed values: instruments (order decides which are kept) and genres ------------------------
INSTRUMENTS = [
    "kick",
    "snare",
    "clap",
    "snap",
    "rimshot",
    "hihat",
    "open hat",
    "crash",
    "ride",
    "cymbal",
    "tom",
    "conga",
    "bongo",
    "shaker",
    "tambourine",
    "cowbell",
    "woodblock",
    "clave",
    "triangle",
    "djembe",
    "timbale",
    "agogo",
    "cabasa",
    "drums",
    "percussion",
    "bass",
    "808",
    "sub",
    "reese",
    "lead",
    "pad",
    "pluck",
    "arp",
    "stab",
    "synth",
    "keys",
    "piano",
    "organ",
    "bell",
    "guitar",
    "strings",
    "violin",
    "cello",
    "brass",
    "trumpet",
    "sax",
    "flute",
    "choir",
    "koto",
    "guzheng",
    "zither",
    "sitar",
    "harp",
    "banjo",
    "ukulele",
    "marimba",
    "kalimba",
    "vibraphone",
    "xylophone",
    "glockenspiel",
    "harpsichord",
    "accordion",
    "vocal",
    "singing",
    "spoken",
    "fx",
    "sound design",
    "noise",
]
GENRES = [
    "house",
    "deep house",
    "tech house",
    "techno",
    "trance",
    "dubstep",
    "drum and bass",
    "breakbeat",
    "garage",
    "trap",
    "lo-fi",
    "synthwave",
    "future bass",
    "hardstyle",
    "jungle",
    "grime",
    "electro",
    "ambient",
    "idm",
    "downtempo",
    "hip hop",
    "boom bap",
    "rnb",
    "soul",
    "funk",
    "disco",
    "reggae",
    "dancehall",
    "afrobeat",
    "latin",
    "pop",
    "rock",
    "metal",
    "punk",
    "jazz",
    "blues",
    "country",
    "folk",
    "gospel",
    "cinematic",
    "orchestral",
    "classical",
]

# --- fixed values: name rules; the first rule with a keyword in the text wins ---------------------
CATEGORY_RULES = [
    ("snap", ["snap"]),
    ("rim", ["rim", "rimshot", "sidestick", "side_stick", "side-stick"]),
    ("kick", ["kick", "bd", "bassdrum", "bass_drum", "bass-drum", "kik"]),
    ("snare", ["snare", "sd", "snr"]),
    ("clap", ["clap", "clp"]),
    ("hat", ["closedhat", "closed_hat", "closed-hat", "hatclosed", "hat_closed", "chh"]),
    ("hat", ["openhat", "open_hat", "open-hat", "hatopen", "hat_open", "ohh"]),
    ("hat", ["hat", "hh", "hihat", "hi-hat", "hi_hat"]),
    ("tom", ["tom"]),
    ("crash", ["crash"]),
    ("ride", ["ride"]),
    ("perc", ["perc", "shaker", "tamb", "cowbell", "conga", "bongo", "clave"]),
    ("drums", ["drum", "drums"]),
    ("sub", ["subbass", "sub_bass", "sub-bass", "sub"]),
    ("reese", ["reese"]),
    ("808", ["808", "eight08"]),
    ("bass", ["bass"]),
    ("riser", ["riser", "uplifter", "uplift"]),
    ("sweep", ["sweep", "downlifter", "downshifter"]),
    ("impact", ["impact", "boom", "slam"]),
    ("drone", ["drone"]),
    ("texture", ["texture", "tex"]),
    ("ambience", ["ambience", "ambient", "atmos", "atmosphere"]),
    ("foley", ["foley"]),
    ("field", ["field", "fieldrec"]),
    ("fx", ["fx", "sfx", "transition", "noise"]),
    ("pluck", ["pluck"]),
    ("lead", ["lead"]),
    ("arp", ["arp"]),
    ("chord", ["chord", "chords", "chd"]),
    ("synth", ["synth"]),
    ("pad", ["pad"]),
    ("stab", ["stab"]),
    ("melody", ["melody", "melodic", "mel"]),
    ("piano", ["piano", "rhodes", "wurli", "wurlitzer"]),
    ("keys", ["keys", "key"]),
    ("guitar", ["guitar", "gtr"]),
    ("strings", ["strings", "violin", "cello", "viola"]),
    ("brass", ["brass", "trumpet", "sax", "trombone", "horn"]),
    ("vocal", ["vocal", "vox", "voice", "acap", "sing", "spoken", "speech", "acapella"]),
]
MELODIC = ["stab", "melody", "lead", "pad", "pluck", "arp", "chord", "synth", "keys", "piano", "guitar", "strings", "brass"]
DRUM_NAMES = ["kick", "snare", "clap", "snap", "hat", "tom", "crash", "ride", "rim", "perc", "drums"]
SELF_NAMES = ["bass", "sub", "reese", "808", "guitar", "strings", "brass", "lead", "synth", "pad", "pluck", "stab", "keys", "piano"]
FX_NAMES = ["fx", "riser", "sweep", "impact", "drone", "texture", "ambience", "foley", "field", "noise"]
SPOKEN_CUES = ["spoken", "speech", "speaking", "talk", "talking", "narration", "narrator", "dialogue", "dialog", "voicememo", "voice memo", "podcast", "monologue"]
SINGING_CUES = ["singing", "sing", "sung", "sings", "acapella", "acappella", "acap", "vocal chop"]

# --- fixed values: notes ------------------------------------------------------------------------
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = {"Ab": "G#", "Bb": "A#", "Cb": "B", "Db": "C#", "Eb": "D#", "Fb": "E", "Gb": "F#"}
NAMED_SHARPS = {"E#": "F", "B#": "C"}
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

# --- fixed values: surface forms that a caption may use for a term --------------------------------
VARIANTS = {
    "melodic": ["melody", "melodies"],
    "strings": ["string"],
    "synth": ["synthesizer", "synthesizers", "synthesised", "synthesized", "synth pad", "synth lead"],
    "keys": ["keyboard", "keyboards"],
    "piano": ["pianos"],
    "organ": ["organs"],
    "guitar": ["guitars"],
    "pluck": ["plucked", "plucks"],
    "bell": ["bells", "chime", "chimes"],
    "pad": ["pads"],
    "lead": ["leads"],
    "stab": ["stabs", "stabbed"],
    "vocal": ["vocals", "voice", "voices", "vox"],
    "singing": ["sung", "sings", "sung vocal", "vocal melody", "acapella"],
    "spoken": ["speech", "speaking", "spoken word", "spoken-word", "talking", "narration", "monologue", "dialogue"],
    "choir": ["choral", "chorale"],
    "brass": ["horns", "horn section"],
    "drums": ["drum"],
    "sound design": ["sound-design", "sfx", "sound effect", "sound effects", "sound fx"],
    "noise": ["hiss", "white noise", "surface noise", "static noise"],
    "hip hop": ["hip-hop", "hiphop"],
    "lo-fi": ["lofi", "low-fi", "low fi"],
    "drum and bass": ["dnb", "drum n bass", "drum'n'bass", "d&b"],
    "rnb": ["r&b", "r and b", "rhythm and blues"],
    "boom bap": ["boombap"],
    "tech house": ["tech-house"],
    "deep house": ["deep-house"],
    "future bass": ["future-bass"],
}

# --- fixed values: categories an instrument may stand for, best first -----------------------------
INSTRUMENT_CATEGORIES = {
    "kick": ["kick", "drum"],
    "snare": ["snare", "drum"],
    "clap": ["clap", "perc", "drum"],
    "snap": ["snap", "perc", "drum"],
    "rimshot": ["rim", "perc", "drum"],
    "hihat": ["hat", "drum"],
    "open hat": ["hat", "drum"],
    "crash": ["crash", "perc", "drum"],
    "ride": ["ride", "perc", "drum"],
    "cymbal": ["hat", "perc", "drum"],
    "tom": ["tom", "perc", "drum"],
    "conga": ["perc", "drum"],
    "bongo": ["perc", "drum"],
    "shaker": ["perc", "drum"],
    "tambourine": ["perc", "drum"],
    "cowbell": ["perc", "drum"],
    "woodblock": ["perc", "drum"],
    "clave": ["perc", "drum"],
    "triangle": ["perc", "drum"],
    "djembe": ["perc", "drum"],
    "timbale": ["perc", "drum"],
    "agogo": ["perc", "drum"],
    "cabasa": ["perc", "drum"],
    "drums": ["drum", "perc"],
    "percussion": ["perc", "drum"],
    "bass": ["bass"],
    "808": ["808", "bass"],
    "sub": ["sub", "bass"],
    "reese": ["reese", "bass"],
    "lead": ["melodic"],
    "pad": ["melodic"],
    "pluck": ["melodic"],
    "arp": ["melodic"],
    "stab": ["melodic"],
    "synth": ["melodic"],
    "keys": ["melodic"],
    "piano": ["melodic"],
    "organ": ["melodic"],
    "bell": ["perc", "melodic"],
    "guitar": ["melodic"],
    "strings": ["melodic"],
    "violin": ["melodic"],
    "cello": ["melodic"],
    "brass": ["melodic"],
    "trumpet": ["melodic"],
    "sax": ["melodic"],
    "flute": ["melodic"],
    "choir": ["vocal"],
    "koto": ["melodic"],
    "guzheng": ["melodic"],
    "zither": ["melodic"],
    "sitar": ["melodic"],
    "harp": ["melodic"],
    "banjo": ["melodic"],
    "ukulele": ["melodic"],
    "marimba": ["perc", "melodic"],
    "kalimba": ["perc", "melodic"],
    "vibraphone": ["perc", "melodic"],
    "xylophone": ["perc", "melodic"],
    "glockenspiel": ["perc", "melodic"],
    "harpsichord": ["melodic"],
    "accordion": ["melodic"],
    "vocal": ["vocal"],
    "singing": ["vocal"],
    "spoken": ["vocal"],
    "fx": ["fx"],
    "sound design": ["fx"],
    "noise": ["noise", "fx"],
}

# --- fixed values: filename cues of a clip's warp mode, in order ----------------------------------
WARP_CUES = {
    "beats": ["drum", "loop", "beat", "perc", "hat", "kick", "snare"],
    "melodic": ["bass", "lead", "melody", "arp", "mono"],
    "harmonic": ["pad", "chord", "keys", "synth", "harm", "atmo"],
    "vocal": ["vox", "vocal", "voice", "acap", "sing"],
}
WARP_CATEGORY = {"beats": "drum", "melodic": "melodic", "harmonic": "melodic", "vocal": "vocal", "complex": "full"}

# --- fixed values: confidences, caps and thresholds -----------------------------------------------
KIND_CONFIDENCE, CATEGORY_CONFIDENCE, BPM_CONFIDENCE = 0.9, 0.85, 0.9
KEY_SCALE_CONFIDENCE, KEY_ONLY_CONFIDENCE = 0.9, 0.6
CAPTION_CONFIDENCE, INSTRUMENT_CONFIDENCE, NEUTRAL_CONFIDENCE, NEUTRAL_CATEGORY = 0.7, 0.5, 0.3, "fx"
INSTRUMENT_CAP, GENRE_CAP, GENRE_CAPTION_WEIGHT = 4, 3, 0.6
INSTRUMENT_RATIO, GENRE_MIN_PROBABILITY, GENRE_TEMPERATURE, GENRE_MIN_SIMILARITY = 0.5, 0.15, 0.04, 0.22
HEURISTIC_CONFIDENCE = 0.55
ONESHOT_SECONDS, RECORDING_SECONDS, BAR_TOLERANCE, BAR_COUNTS = 1.2, 30.0, 0.06, [1, 2, 4, 8, 16]
KIND_DRUMS = ["kick", "snare", "clap", "hat", "tom", "crash", "ride", "rim", "perc"]
CATCHALL = ["fx", "full"]
GUESSED = ["bass", "sub", "808", "reese", "melodic", "vocal"]
PRECEDENCE = {"ace-step": 0, "clap": 1, "heuristic": 2}
RUN_ORDER = ["clap", "ace-step", "heuristic"]
HEURISTIC_DRUMS = ["kick", "snare", "clap", "snap", "hat", "tom", "crash", "ride", "rim", "perc", "drum"]
HEURISTIC_SELF = ["bass", "808", "sub", "reese", "vocal"]
LOOP_CONTEXT = {"seconds": 1.5, "voiced": 0.6, "bpm": 120.0, "bars": 2}
LOOP_CONTEXT_TONAL = ["bass", "sub", "808", "reese", "melodic"]
LOOP_CONTEXT_DRUMS = ["kick", "snare", "clap", "snap", "hat", "tom", "crash", "ride", "rim", "perc", "808"]
AUDIO_SUFFIXES = ["wav", "aif", "aiff", "flac", "ogg", "mp3"]


# --- fixed values: patterns of names (results depend on every letter of them) -------------------
EXPLICIT_BPM = r"(?:(\d{2,3}(?:\.\d+)?)\s*[-_]?\s*bpm|bpm\s*[-_]?\s*(\d{2,3}(?:\.\d+)?))"
BARE_NUMBER = r"(?<![0-9])(\d{2,3})(?![0-9])"
BARE_NUMBER_IN_FILENAME = r"(?<![\d.])(\d{2,3})(?![\d.])"
KEY = r"(?<![A-Za-z])([A-G][b#]?)(?:[-_ ]?(major|maj\d*|minor|min(?:or)?|m(?=\b)))?(?![A-Za-z0-9])"
KEY_SHARP_S = r"(?<![A-Za-z0-9])([A-G])s(?:[-_ ]?(major|maj\d*|minor|min(?:or)?|m(?=\b)))?(?![A-Za-z0-9])"
ONE_SHOT = r"(?<![a-z])(?:one[\s_-]?shots?|oneshots?|hit|stab)(?![a-z])"
ONE_SHOT_IN_FILENAME = r"(?<![a-z])(?:one[\s_-]?shot|hit|stab)(?![a-z])"
RECORDING = r"(?<![a-z])(?:recording|rec|field[\s_-]?rec(?:ording)?|voice[\s_-]?memo|jam|take\d*|bounce|full[\s_-]?mix|full[\s_-]?song|master)(?![a-z])"

# --- fixed values: thresholds of the decision lists on features ---------------------------------
FAST_ATTACK, PERCUSSIVE, NOISY, VOICED = -1.5, 0.6, 0.15, 0.5
HAT_CENTROID, HAT_ROLLOFF = 4000, 7000
LOW_CROSSINGS, LOW_CENTROID, BASS_CENTROID, CLAP_CENTROID = 0.03, 2500, 400, 2000
VOCAL_CENTROID, VOCAL_STABILITY, STEADY = (300, 3500), 0.1, 0.05
WARP_DENSITY, WARP_PERCUSSIVE, WARP_VOCAL, WARP_FORMANT, WARP_MELODIC, WARP_HARMONIC = 2.5, 0.5, 0.5, 0.6, 0.4, 0.3


def categories_for(kind: str) -> list[str]:
    """The category vocabulary of a kind; an unknown kind has that of one-shots."""
    return CATEGORIES.get(kind, CATEGORIES["one-shot"])


def all_categories() -> list[str]:
    """All categories of all kinds, sorted."""
    return sorted({c for v in CATEGORIES.values() for c in v})


def name_confidence(kind: bool, category: bool, bpm: bool, key: float) -> float:
    """Mean confidence of the cues that fired, three places, rounded half-even on the binary value."""
    fired = [c for c, on in ((KIND_CONFIDENCE, kind), (CATEGORY_CONFIDENCE, category), (BPM_CONFIDENCE, bpm), (key, key > 0)) if on]
    return round(sum(fired) / len(fired), 3) if fired else 0.0


def name_confidences() -> dict[str, float]:
    """All 24 reachable confidences by flags 'kcb' and key confidence."""
    return {
        f"{int(k)}{int(c)}{int(b)}{key}": name_confidence(k, c, b, key)
        for k in (False, True)
        for c in (False, True)
        for b in (False, True)
        for key in (0.0, KEY_ONLY_CONFIDENCE, KEY_SCALE_CONFIDENCE)
    }
