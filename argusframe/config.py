"""Settings as frozen dataclasses, from a mapping or a YAML file; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from .operators.binding import BinderConfig
from .operators.tracking import TrackerConfig


@dataclass(frozen=True)
class SearchConfig:
    default_k: int = 20


@dataclass(frozen=True)
class AnomalyConfig:
    method: str = "knn"
    k: int = 5
    shrinkage: float = 0.1
    n_estimators: int = 100
    nu: float = 0.1
    seed: int = 0


@dataclass(frozen=True)
class LanguageConfig:
    min_score: float = 0.22


@dataclass(frozen=True)
class MiningConfig:
    min_pair_gap: int = 5
    max_pairs_per_track: int = 200
    max_false_merge_rate: float = 0.05
    test_fraction: float = 0.3
    seed: int = 0


SECTIONS = {
    "tracker": TrackerConfig, "binder": BinderConfig, "search": SearchConfig, "anomaly": AnomalyConfig, "language": LanguageConfig, "mining": MiningConfig,
}


def from_mapping(raw: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """Section name -> its settings; sections that aren't named keep their defaults."""
    if unknown := set(raw) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    for name, values in raw.items():
        if extra := set(values) - {f.name for f in fields(SECTIONS[name])}:
            raise ValueError(f"unknown settings in {name}: {sorted(extra)}")
    return {name: kind(**raw.get(name, {})) for name, kind in SECTIONS.items()}


def from_yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})
