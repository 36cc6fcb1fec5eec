"""Configuration: dataclasses from YAML, overlays, export; unknown keys are refused."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields
from typing import Any


def overlay(base: dict[str, Any], patch: dict[str, Any], path: str = "") -> dict[str, Any]:
    """``base`` with the patch's values; objects merge, anything else is replaced."""
    out = dict(base)
    for k, v in patch.items():
        if k not in base:
            raise KeyError(f"unknown key {path}{k}")
        out[k] = overlay(base[k], v, f"{path}{k}.") if isinstance(base[k], dict) and isinstance(v, dict) else v
    return out


def load(kind: type, text: str):
    """A dataclass from YAML (JSON is YAML too)."""
    import yaml

    return kind(**overlay(asdict(kind()), yaml.safe_load(text) or {}))


def dump(config: Any) -> str:
    import yaml

    return yaml.safe_dump(asdict(config), sort_keys=False)


def effective(kind: type, rules: list[tuple[str, dict]], overrides: dict | None = None):
    """Defaults, then enabled rules by name, then overrides."""
    found = asdict(kind())
    for _, patch in sorted(rules, key=lambda r: r[0]):
        found = overlay(found, patch)
    return kind(**overlay(found, overrides or {}))


def digest(config: Any) -> str:
    """32 hex digits that name a configuration."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:32]


def keys_of(kind: type) -> tuple[str, ...]:
    return tuple(f.name for f in fields(kind))
