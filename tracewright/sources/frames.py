"""Reading frame tables, episode metadata and curated views."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EPISODE, lowest_episodes

STATE_NAMES = tuple(p + n for p in ("observation.", "") for n in ("state", "states"))
ACTION_NAMES = ("action", "actions")
OTHER_NAMES = {
    "timestamp": "timestamp timestamps time".split(),
    "frame_index": "frame_index frame_idx observation.frame_index".split(),
    "episode_index": "episode_index episode_idx episode".split(),
    "task_index": "task_index task task_name".split(),
}
#: Parts of a camera's name that tell what it looks from.
INSIDE = "ego egocentric end_effector endeffector first_person fpv gripper_cam hand wrist".split()
OUTSIDE = "agent_view agentview bird_eye birdseye cam_high cam_low external front overhead side third_person top workspace".split()


def image_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "image" in c.lower()]


def read_frames(spark: SparkSession, path: str, columns: list[str] | None = None, max_episodes: int | None = None) -> DataFrame:
    """A frame table from a folder of Parquet files, without image columns;
    `columns` are read from the files alone (episode_index always is)."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    df = df.drop(*image_columns(df))
    if columns is not None:
        wanted = [c for c in df.columns if c in {*columns, EPISODE}]
        df = df.select(*[f"`{c}`" for c in wanted])
    return lowest_episodes(df, max_episodes) if max_episodes else df


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def data_files(spark: SparkSession, root: str) -> list[str]:
    """The Parquet files under data/, in order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root.rstrip('/')}/data").select("path")
    return sorted(r["path"] for r in found.collect())


def read_info(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text())


def read_stats(root: str | Path, candidates: tuple[str, ...] = ("meta/stats.json", "meta/episodes_stats.jsonl", "stats.json")) -> tuple[str, Any] | None:
    """The first of the candidates that is there and parses: a JSON file whole,
    of a JSON-lines file the first five rows."""
    for name in candidates:
        p = Path(root, name)
        if not p.exists():
            continue
        try:
            if p.suffix == ".jsonl":
                return name, [json.loads(x) for x in p.read_text().splitlines()[:5]]
            return name, json.loads(p.read_text())
        except ValueError:
            continue
    return None


def discover(features: dict[str, Any]) -> dict[str, str | None]:
    """Which column is which, by lists of usual names, and the cameras."""
    def first(names: Sequence[str]) -> str | None:
        return next((n for n in names if n in features), None)

    out: dict[str, Any] = {"state": first(STATE_NAMES), "action": first(ACTION_NAMES)} | {k: first(v) for k, v in OTHER_NAMES.items()}
    out["cameras"] = [k for k, v in features.items() if is_visual(v) or "images." in k or ".image" in k]
    return out


def is_visual(feature: dict[str, Any]) -> bool:
    return str(feature.get("dtype", "")).lower() in ("image", "video")


def motor_names(feature: dict[str, Any] | None) -> list[str] | None:
    """Names of a vector's elements, from a list or from {"motors": [...]}."""
    names = (feature or {}).get("names")
    if isinstance(names, dict):
        names = names.get("motors")
    return list(names) if isinstance(names, list) else None


def viewpoint(key: Column) -> Column:
    """verified_egocentric, verified_external, or ambiguous if the name has parts
    of both kinds or of none."""
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(key), p))
    inside, outside = has(INSIDE), has(OUTSIDE)
    return F.when(inside & ~outside, "verified_egocentric").when(outside & ~inside, "verified_external").otherwise("ambiguous")


def gate(view: str) -> dict[str, Any]:
    """Egocentric audits run only on a camera known to be one."""
    return {"status": "ready"} if view == "verified_egocentric" else {"status": "blocked", "reason": f"viewpoint is {view}"}


@dataclass
class Manifest:
    """What is known of a dataset before its frames are read."""

    name: str
    revision: str
    fps: float | None = None
    total_episodes: int | None = None
    total_frames: int | None = None
    features: dict[str, Any] = field(default_factory=dict)
    keys: dict[str, Any] = field(default_factory=dict)
    cameras: list[dict[str, Any]] = field(default_factory=list)
    stats_source: str | None = None
    created_at: str = ""

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def build_manifest(root: str | Path, name: str, revision: str) -> Manifest:
    info = read_info(Path(root, "meta/info.json"))
    features = info.get("features", {})
    stats = read_stats(root)
    cameras = []
    for key in discover(features)["cameras"]:
        low = key.lower()
        inside, outside = any(p in low for p in INSIDE), any(p in low for p in OUTSIDE)
        view = "verified_egocentric" if inside and not outside else "verified_external" if outside and not inside else "ambiguous"
        cameras.append({"key": key, "shape": features[key].get("shape"), "viewpoint": view})
    return Manifest(name, revision, info.get("fps"), info.get("total_episodes"), info.get("total_frames"), features, discover(features), cameras, stats[0] if stats else None, datetime.now(UTC).isoformat())


def video_file(files: list[str], key: str) -> str | None:
    """The first file, in order, of a camera: under videos/<key>/, else any whose
    path has the key."""
    inside = sorted(f for f in files if f"videos/{key}/" in f)
    return (inside or sorted(f for f in files if key in f) or [None])[0]


@dataclass
class CuratedView:
    manifest: dict[str, Any]
    episodes: DataFrame
    timesteps: DataFrame
    windows: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> CuratedView:
        local = Path(root.removeprefix("file://"))
        return cls(json.loads((local / "manifest.json").read_text()), *[spark.read.parquet(f"{root}/{n}.parquet") for n in ("episodes", "timesteps", "training_windows")])

    def of_policy(self, policy: str) -> DataFrame:
        return self.windows.filter(F.col("policy") == policy)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc): a JSON document a file."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.input_file_name().alias("doc_id"), F.col("value").alias("doc"))
