"""Settings: environment over file over default."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from .errors import BadInputError

DEFAULTS = {"db.enabled": True, "db.path": "", "captioner.batch": "8", "captioner.analytics": ""}
ENVIRONMENT = {"db.enabled": "SAMPLEYARD_DB_ENABLED", "db.path": "SAMPLEYARD_DB", "captioner.batch": "SAMPLEYARD_CAPTIONER_BATCH", "captioner.analytics": "SAMPLEYARD_CAPTIONER_ANALYTICS"}


def config_path() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config"
    return Path(base) / "sampleyard" / "config.toml"


def default_db_path() -> str:
    base = os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share"
    return str(Path(base) / "sampleyard" / "catalog")


def coerce(key: str, value):
    if key not in DEFAULTS:
        raise BadInputError(f"unknown setting {key!r}; known: {', '.join(sorted(DEFAULTS))}")
    if isinstance(DEFAULTS[key], bool) and not isinstance(value, bool):
        low = str(value).strip().lower()
        if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise BadInputError(f"{key} is true or false")
        return low in ("1", "true", "yes", "on")
    return value


def load() -> dict:
    path = config_path()
    if not path.exists():
        return {}
    nested = tomllib.loads(path.read_text())
    return {f"{section}.{k}": v for section, values in nested.items() if isinstance(values, dict) for k, v in values.items()}


def effective() -> dict:
    """Every setting with its value in force."""
    stored = load()
    out = {k: coerce(k, os.environ[ENVIRONMENT[k]]) if ENVIRONMENT[k] in os.environ else stored.get(k, v) for k, v in DEFAULTS.items()}
    out["db.path"] = out["db.path"] or default_db_path()
    return out


def set_value(key: str, value) -> None:
    stored = load() | {key: coerce(key, value)}
    sections: dict[str, list[str]] = {}
    for k, v in sorted(stored.items()):
        section, name = k.split(".", 1)
        sections.setdefault(section, []).append(f"{name} = {str(v).lower() if isinstance(v, bool) else chr(34) + str(v) + chr(34)}")
    path = config_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"[{s}]\n" + "\n".join(lines) + "\n" for s, lines in sections.items()))


def blob_dir() -> str:
    """Where imported files are kept, beside the catalog."""
    return effective()["db.path"].rstrip("/") + "-blobs"
