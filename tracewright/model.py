"""The column contract: a trajectory is a table of frames, one row for each
(episode_index, frame_index), with a timestamp in seconds and vector columns.

Order within an episode is by frame_index, never across episodes, so every
window partitions by episode and nothing is sorted globally. Intervals of
frames are half-open. Frames are never renumbered after filtering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPISODE, FRAME, TIME = "episode_index", "frame_index", "timestamp"


def in_order(*by: str, order: str = FRAME) -> WindowSpec:
    return Window.partitionBy(*(by or (EPISODE,))).orderBy(order)


def whole(*by: str) -> WindowSpec:
    return Window.partitionBy(*(by or (EPISODE,)))


def previous(c: Column | str, w: WindowSpec | None = None) -> Column:
    return F.lag(c, 1).over(w or in_order())


def consecutive(w: WindowSpec | None = None) -> Column:
    """Whether the row's frame follows the one before it; false for the first."""
    return F.coalesce(F.col(FRAME) == previous(FRAME, w) + 1, F.lit(False))


def position(w: WindowSpec | None = None) -> Column:
    """0, 1, ... within the episode."""
    return F.row_number().over(w or in_order()) - 1


def as_trajectory(df: DataFrame, episode: str, order: list[str], seconds: Column | None = None, frame: Column | None = None, **columns: Column) -> DataFrame:
    """Names a table's columns as a trajectory's. Without a frame column the
    frames are numbered in the given order within each episode."""
    number = frame if frame is not None else F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1
    picked = [F.col(episode).cast("long").alias(EPISODE), number.cast("long").alias(FRAME)]
    if seconds is not None:
        picked.append(seconds.cast("double").alias(TIME))
    return df.select(*picked, *[c.alias(n) for n, c in columns.items()])


def lowest_episodes(frames: DataFrame, n: int) -> DataFrame:
    """The frames of the n episodes of the lowest index."""
    kept = frames.select(EPISODE).distinct().orderBy(EPISODE).limit(n)
    return frames.join(kept, EPISODE, "left_semi")
