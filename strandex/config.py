"""Configuration files, read on the driver: a file may inherit from another, and texts may name other values as ${a.b}."""

from __future__ import annotations

import json
import os
import re
from functools import reduce
from typing import Any

PASSES = 10
_NAME = re.compile(r"\$\{([^}]+)\}")


def read(path: str) -> dict:
    """One JSON file or, where a reader for it is installed, YAML file; an empty one is an empty configuration."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f) or {}
        import yaml

        return yaml.safe_load(f) or {}


def merged(below: Any, above: Any) -> Any:
    """above laid over below: maps are merged key by key, everything else is replaced."""
    if not (isinstance(below, dict) and isinstance(above, dict)):
        return above
    return {k: merged(below[k], above[k]) if k in below and k in above else above.get(k, below.get(k)) for k in [*below, *(k for k in above if k not in below)]}


def filled(value: Any, root: dict) -> Any:
    """value with each ${a.b} in a text replaced by what stands there in root. A name that isn't there is an error."""
    if isinstance(value, dict):
        return {k: filled(v, root) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, root) for v in value]
    return _NAME.sub(lambda m: str(reduce(lambda at, k: at[k], m[1].split("."), root)), value) if isinstance(value, str) else value


def load(path: str) -> dict:
    """The configuration at a path: the files it inherits from, furthest first, each laid over the one before, then names filled in until nothing
    changes, in PASSES passes at most. A file that inherits from itself, at whatever distance, is an error."""
    chain, seen, at = [], set(), os.path.abspath(path)
    while at:
        if at in seen:
            raise ValueError(f"{at} inherits from itself")
        seen.add(at)
        own = read(at)
        parent = own.pop("inherit", None)
        chain.append(own)
        at = os.path.abspath(os.path.join(os.path.dirname(at), parent)) if parent else None
    out = reduce(merged, reversed(chain))
    for _ in range(PASSES):
        now = filled(out, out)
        if now == out:
            break
        out = now
    return out
