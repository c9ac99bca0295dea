"""Stream variants of two operators for frames as they arrive. The batch forms
are windows; here the state of an episode is a few numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import EPISODE, FRAME


def rolling_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and key; late ones are awaited for `late`."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def live_triggers(frames: DataFrame, score: str, threshold: float, votes: int = 4, of: int = 5, idle_ms: int = 600_000) -> DataFrame:
    """(episode_index, trigger_frame) as soon as `votes` of an episode's last
    `of` frames reach the threshold; once for each episode. Frames of a batch
    are taken in order; an episode idle for long is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, recent = state.get if state.exists else (False, "")
        bits = [c == "1" for c in recent]
        rows = pd.concat(list(batches)).sort_values(FRAME)
        hit = None
        for f, s in zip(rows[FRAME], rows[score], strict=True):
            bits = [*bits, bool(s >= threshold)][-of:]
            if not done and len(bits) == of and sum(bits) >= votes:
                done, hit = True, int(f)
        state.update((done, "".join("1" if b else "0" for b in bits)))
        state.setTimeoutDuration(idle_ms)
        if hit is not None:
            yield pd.DataFrame({EPISODE: [key[0]], "trigger_frame": [hit]})

    return frames.groupBy(EPISODE).applyInPandasWithState(step, f"{EPISODE} long, trigger_frame long", "done boolean, recent string", "append", GroupStateTimeout.ProcessingTimeTimeout)
