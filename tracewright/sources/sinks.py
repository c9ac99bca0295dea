"""Writing tables, small reports and curated views."""

from __future__ import annotations

import json
import math
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import fingerprint, save_yaml
from ..functions.paths import portable_tree


def plain(value: Any) -> Any:
    """JSON's types for numpy's and Spark's; NaN and infinities become null."""
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_report(value: Any, path: str | Path, root: str = ".") -> None:
    """A small result as JSON, its paths made portable."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(portable_tree(plain(value), root), indent=2, default=str) + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for summaries, never for frames."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_by_episode(timesteps: DataFrame, episodes: DataFrame, path: str) -> None:
    """A folder for each accepted episode. Rows are brought together by episode
    first, so that a task writes few files."""
    accepted = episodes.filter("accepted").select("episode_index")
    rows = timesteps.join(accepted, "episode_index", "left_semi")
    rows.repartition("episode_index").write.mode("overwrite").partitionBy("episode_index").parquet(path)


def write_view(root: str, episodes: DataFrame, timesteps: DataFrame, windows: DataFrame, config: Any, force: bool = False, dry_run: bool = False) -> dict[str, Any]:
    """episodes, timesteps and training_windows as Parquet, a manifest and the
    config. Refuses a folder that isn't empty, unless forced; a dry run only
    gives the manifest."""
    local = Path(root.removeprefix("file://"))
    manifest = {"created_at": datetime.now(UTC).isoformat(), "config_hash": fingerprint(config), "tables": ["episodes", "timesteps", "training_windows"]}
    if dry_run:
        return manifest
    if local.exists() and any(local.iterdir()) and not force:
        raise FileExistsError(f"{local} isn't empty")
    for name, df in (("episodes", episodes), ("timesteps", timesteps), ("training_windows", windows)):
        df.write.mode("overwrite" if force else "errorifexists").parquet(f"{root}/{name}.parquet")
    write_report(manifest, local / "manifest.json", str(local))
    save_yaml(json.loads(json.dumps(config, default=lambda x: x.__dict__)), local / "config.yaml")
    return manifest


def joined(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of codes as text, for sinks that know no arrays."""
    return df.withColumns({a: F.array_join(a, "|") for a in arrays})
