"""Configuration files and their merge with flags."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from lintlake.plans.catalogue import RULE_IDS
from lintlake.plans.review import Options

#: Names in a folder, the first that is there counts; the nearest folder wins outright.
NAMES = (".lintlake.json", "lintlake.config.json")
MAX_PARENTS = 64
_KINDS = {"exclude": list, "disable": list, "only": list, "experimental": bool, "minSeverity": str}
_SEVERITIES = ("error", "warn", "info")


@dataclass(frozen=True)
class Loaded:
    config: dict
    path: str | None = None
    error: str | None = None


def search_path(cwd: str, stop_at: str | None = None, names: tuple[str, ...] = NAMES) -> list[Path]:
    """Candidates from cwd upwards, as far as stop_at or the root."""
    here, stop = Path(cwd).resolve(), Path(stop_at).resolve() if stop_at else None
    dirs = []
    for d in [here, *here.parents][:MAX_PARENTS]:
        dirs.append(d)
        if d == stop:
            break
    return [d / n for d in dirs for n in names]


def problems(config: object) -> list[str]:
    """What is wrong with a parsed file; unknown keys are errors."""
    if not isinstance(config, dict):
        return ["not an object"]
    out = []
    for k, v in config.items():
        kind = _KINDS.get(k)
        if kind is None:
            out.append(f"{k} is not a known key")
        elif not isinstance(v, kind) or (kind is list and not all(isinstance(x, str) for x in v)):
            out.append(f"{k} must be {'a list of strings' if kind is list else kind.__name__}")
        elif k == "minSeverity" and v not in _SEVERITIES:
            out.append(f"{k} must be one of {', '.join(_SEVERITIES)}")
    return out


def load(cwd: str, explicit: str | None = None, stop_at: str | None = None) -> Loaded:
    for p in [Path(explicit)] if explicit else search_path(cwd, stop_at):
        try:
            raw = p.read_text(encoding="utf-8")
        except OSError:
            continue
        try:
            config = json.loads(raw)
        except ValueError as e:
            return Loaded({}, str(p), f"{p}: {e}")
        if wrong := problems(config):
            return Loaded({}, str(p), f"{p}: {'; '.join(wrong)}")
        return Loaded(config, str(p))
    return Loaded({})


def ids(items: list[str] | None) -> tuple[str, ...]:
    """Rule ids in capitals; one item may hold several."""
    return tuple(w.upper() for x in items or [] for w in re.split(r"[\s,]+", x) if w)


def merge(config: dict, min_severity: str | None = None, exclude: list[str] | None = None, only: list[str] | None = None, disabled: list[str] | None = None, experimental: bool | None = None) -> Options:
    """Flags over the file over defaults; lists of excludes and disabled rules add up."""
    return Options(
        min_severity=min_severity or config.get("minSeverity") or "warn",
        exclude=(*config.get("exclude", []), *(exclude or [])),
        only=ids(only) if only is not None else ids(config.get("only")),
        disabled=(*ids(config.get("disable")), *ids(disabled)),
        experimental=config.get("experimental", False) if experimental is None else experimental,
    )


def unknown_rules(options: Options) -> list[str]:
    return sorted({*options.only, *options.disabled} - set(RULE_IDS))
