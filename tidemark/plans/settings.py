"""Settings with their defaults, loaded from TOML or JSON files; missing keys keep their defaults."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """S27. The defaults."""

    dense_window_s: float = 10.0
    dense_hop_s: float = 2.0
    min_match_pct: float = 10.0
    min_accepted_pct: float = 5.0
    detection_dbscan_epsilon_ms: float = 20.0
    detection_dbscan_min_samples_pct: float = 1.5
    stepping_correction_mode: str = "full"
    stepping_quality_mode: str = "normal"
    stepping_filtered_fallback: str = "nearest"
    sync_stability_variance_threshold: float = 0.0
    sync_stability_min_windows: int = 3


def load(path: str) -> tuple[Settings, dict]:
    """The settings of a file, and all that it holds: TOML by its name, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    data = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in data.items() if k in known}), data


def orphans(data: dict) -> list[str]:
    """Keys of a file that no setting has, in order."""
    return sorted(set(data) - {f.name for f in fields(Settings)})
