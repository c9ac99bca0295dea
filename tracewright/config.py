"""Parameters as frozen dataclasses; YAML only fills them on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class EpisodeRules:
    min_frames: int = 64
    horizon: int = 16
    fps: float | None = None
    gap_factor: float = 1.5
    reject_nan_inf: bool = True
    reject_non_monotonic: bool = True
    reject_duplicate_timestamps: bool = True
    reject_frame_gaps: bool = True
    reject_length_mismatch: bool = True
    reject_missing_video: bool = True
    reject_video_mismatch: bool = True


@dataclass(frozen=True)
class ImageRules:
    blur: float = 50.0
    dark_mean: float = 40.0
    dark_level: int = 5
    bright_mean: float = 220.0
    bright_level: int = 250
    clipped_share: float = 0.15
    entropy: float = 3.5
    near_lossless_mse: float = 1.0
    near_mse: float = 25.0
    sharpness_percentile: float = 5.0
    motion_percentile: float = 50.0
    overexposed_run: int = 5
    frozen_run: int = 5
    frozen_uses_near_lossless: bool = True
    rescale_unit_range: bool = True


@dataclass(frozen=True)
class Smoothing:
    window: int = 5
    degree: int = 2
    most_ratio: float = 0.35


@dataclass(frozen=True)
class Jumps:
    k: float
    floor: float = 1e-6
    least: float = 0.0
    range_share: float = 0.0


@dataclass(frozen=True)
class Curation:
    episode: EpisodeRules = field(default_factory=EpisodeRules)
    image: ImageRules = field(default_factory=ImageRules)
    smoothing: Smoothing = field(default_factory=Smoothing)
    ordinary: Jumps = field(default_factory=lambda: Jumps(8.0))
    severe: Jumps = field(default_factory=lambda: Jumps(20.0, least=0.05, range_share=0.25))
    horizon: int = 16
    stride: int = 1


def load_yaml(path: str | Path) -> dict[str, Any]:
    return yaml.safe_load(Path(path).read_text()) or {}


def save_yaml(value: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(value, sort_keys=False))


def filled(kind: type, values: dict[str, Any]):
    """A dataclass from a nested dict; unknown keys are an error."""
    known = {f.name: f for f in fields(kind)}
    if bad := set(values) - set(known):
        raise ValueError(f"{kind.__name__} has no {sorted(bad)}")
    nested = {"episode": EpisodeRules, "image": ImageRules, "smoothing": Smoothing, "ordinary": Jumps, "severe": Jumps}
    return kind(**{k: filled(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in values.items()})


def fingerprint(config: Any) -> str:
    """The first 16 digits of the SHA-256 of a config as sorted JSON."""
    value = asdict(config) if hasattr(config, "__dataclass_fields__") else config
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]
