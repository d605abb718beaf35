"""Settings from JSON files with includes, environment variables and defaults."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

REQUIRED = ("storage", "retrieval", "hygiene")


def merged(base: dict, over: dict) -> dict:
    """Two settings as one: dictionaries are merged at every depth, all else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def expanded(value: object) -> object:
    """``${NAME}`` and ``${NAME:-default}`` replaced in all strings; an unknown name without a default raises."""

    def one(match: re.Match) -> str:
        name, default = match[1], match[2]
        if name not in os.environ and default is None:
            raise KeyError(f"the environment has no {name}")
        return os.environ.get(name, default or "")

    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", one, value)
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    return [expanded(v) for v in value] if isinstance(value, list) else value


def load_settings(path: str | Path, _open: tuple = ()) -> dict:
    """The settings of a file over those of its ``include`` files, later ones over earlier ones; a ring raises."""
    path = Path(path).resolve()
    if path in _open:
        raise ValueError(f"{path} includes itself")
    own = json.loads(path.read_text())
    names = own.pop("include", [])
    out: dict = {}
    for name in [names] if isinstance(names, str) else names:
        out = merged(out, load_settings(path.parent / name, (*_open, path)))
    return merged(out, expanded(own))


def validate(settings: dict, required: tuple[str, ...] = REQUIRED) -> dict:
    missing = [key for key in required if key not in settings]
    if missing:
        raise ValueError(f"settings lack {', '.join(missing)}")
    return settings
