"""Settings of the engine. All have defaults; a mapping of overrides is merged in key by key."""

from __future__ import annotations

import copy
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class DecaySettings:
    rate: float = 0.05
    archive_below: float = 0.3
    emotion_base: float = 1.0
    arousal_boost: float = 0.8
    auto_resolve_days: float = 30.0
    auto_resolve_importance: int = 4


@dataclass(frozen=True)
class SearchSettings:
    topic: float = 4.0
    emotion: float = 2.0
    time: float = 2.5
    importance: float = 1.0
    content: float = 3.0
    threshold: float = 50.0
    merge_threshold: float = 75.0


@dataclass(frozen=True)
class RecallSettings:
    semantic: float = 0.45
    keyword: float = 0.35
    importance: float = 0.1
    freshness: float = 0.1
    cooldown_hours: float = 48.0
    cooldown_floor: float = 0.3
    skip_rounds: int = 5
    first_card: float = 0.55
    second_card: float = 0.5
    second_share: float = 0.85
    max_cards: int = 2
    top_k: int = 10
    recent_hours: float = 72.0
    total_budget: int = 1200
    core_budget: int = 500
    recent_budget: int = 300
    recalled_budget: int = 400


@dataclass(frozen=True)
class PersonaSettings:
    personality_limit: float = 0.01
    relationship_limit: float = 0.03
    affect_limit: float = 0.18
    half_life_minutes: float = 90.0


@dataclass(frozen=True)
class Settings:
    decay: DecaySettings = field(default_factory=DecaySettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    recall: RecallSettings = field(default_factory=RecallSettings)
    persona: PersonaSettings = field(default_factory=PersonaSettings)


def deep_merge(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """A copy of ``base`` in which nested mappings are merged and everything else is replaced."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = deep_merge(out[key], value) if both else copy.deepcopy(value)
    return out


def settings(overrides: dict[str, Any] | None = None) -> Settings:
    """Defaults with ``overrides`` such as {"decay": {"rate": 0.1}}; an unknown name is an error."""
    merged = deep_merge(asdict(Settings()), overrides or {})
    kinds = {f.name: f.default_factory for f in fields(Settings)}
    return Settings(**{name: kinds[name](**values) for name, values in merged.items()})


ENV_PREFIX = "TIDEPOOL_"


def from_environment(environ: Mapping[str, str]) -> dict[str, Any]:
    """Overrides from variables such as TIDEPOOL_DECAY__RATE=0.1; names in any case, values as YAML scalars. Blank ones set nothing."""
    import yaml

    out: dict[str, Any] = {}
    for name, value in sorted(environ.items()):
        if name.startswith(ENV_PREFIX) and "__" in name and value.strip():
            group, key = name.removeprefix(ENV_PREFIX).lower().split("__", 1)
            out.setdefault(group, {})[key] = yaml.safe_load(value)
    return out


def load_settings(text: str | None = None, environ: Mapping[str, str] | None = None, overrides: dict[str, Any] | None = None) -> Settings:
    """Defaults, then a YAML ``text``, then the environment, then ``overrides``; each is merged over what comes before.

    Settings are values: a change while running is a new call whose result the next plan takes.
    """
    import yaml

    held = yaml.safe_load(text) if text else None
    if held is not None and not isinstance(held, dict):
        raise ValueError("settings must be a mapping")
    merged = deep_merge(deep_merge(held or {}, from_environment(os.environ if environ is None else environ)), overrides or {})
    return settings(merged)
