"""Timing of frames: intervals, gaps, and agreement with video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even, tally
from ..model import EPISODE, FRAME, TIME, in_order, previous, whole

TOLERANCE = 1e-9


def dt_of(fps: float | None, steps: Column) -> Column:
    """1 / fps, else the median positive step."""
    return F.lit(1.0 / fps) if fps else F.percentile(F.when(steps > 0, steps), F.lit(0.5))


def inferred_dt(frames: DataFrame) -> DataFrame:
    """(dt): the median of positive steps between each episode's sorted times."""
    step = F.col(TIME) - F.lag(TIME).over(Window.partitionBy(EPISODE).orderBy(TIME))
    return frames.select(step.alias("d")).filter("d > 0").agg(F.percentile("d", F.lit(0.5)).alias("dt"))


def steps(frames: DataFrame) -> DataFrame:
    """Frames with dt and df, the differences to the frame before (null for an
    episode's first). One sort for both."""
    w = in_order()
    return frames.withColumns({"dt": F.col(TIME) - previous(TIME, w), "df": F.col(FRAME) - previous(FRAME, w)})


def episode_alignment(frames: DataFrame, fps: float | None = None, factor: float = 1.5, tolerance: float = TOLERANCE, state: str | None = None, action: str | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each episode: frames, whether time runs back, repeated times,
    gaps in time (longer than factor * dt) and their sizes, gaps in frame
    numbers, and whether state and action are there for different counts of
    frames; and what else is to be aggregated. Without fps dt is the episode's
    median step."""
    stepped = steps(frames)
    lengths = F.count(state) != F.count(action) if state and action else F.lit(False)
    if fps:
        gap = F.col("dt") > factor / fps
        dt = F.lit(1.0 / fps)
    else:
        stepped = stepped.filter(F.col(EPISODE).isNotNull()).withColumn("expected_dt", dt_of(None, F.col("dt")).over(whole()))
        gap, dt = F.col("dt") > factor * F.col("expected_dt"), F.first("expected_dt")
    return stepped.groupBy(EPISODE).agg(
        F.count("*").alias("n_frames"),
        dt.alias("expected_dt"),
        F.coalesce(F.bool_or(F.col("dt") < -tolerance), F.lit(False)).alias("non_monotonic"),
        tally(F.abs("dt") <= tolerance).alias("n_duplicate_timestamps"),
        tally(gap).alias("n_timestamp_gaps"),
        F.sort_array(F.collect_list(F.when(gap, F.col("dt")))).alias("gap_sizes"),
        tally(F.col("df") != 1).alias("n_frame_gaps"),
        lengths.alias("length_mismatch"),
        *[c.alias(n) for n, c in (also or {}).items()],
    )


def alignment_rollup(episodes: DataFrame, sample: int = 500) -> DataFrame:
    """One row over episode_alignment(): counts, totals, and gap statistics with
    a sample of sizes (the greatest)."""
    counts = episodes.agg(
        F.count("*").alias("n_episodes"),
        tally(F.col("non_monotonic")).alias("n_non_monotonic"),
        tally(F.col("n_duplicate_timestamps") > 0).alias("n_with_duplicates"),
        tally(F.col("n_timestamp_gaps") > 0).alias("n_with_gaps"),
        tally(F.col("n_frame_gaps") > 0).alias("n_with_frame_gaps"),
        tally(F.col("length_mismatch")).alias("n_length_mismatch"),
        F.sum("n_duplicate_timestamps").alias("duplicate_timestamps"),
        F.sum("n_timestamp_gaps").alias("timestamp_gaps"),
        F.sum("n_frame_gaps").alias("frame_gaps"),
    )
    sizes = episodes.select(F.explode("gap_sizes").alias("g"))
    p = F.percentile("g", F.array(F.lit(0.5), F.lit(0.95)))
    stats = sizes.agg(F.count("g").alias("gap_count"), F.min("g").alias("gap_min"), F.max("g").alias("gap_max"), F.avg("g").alias("gap_mean"), F.get(p, F.lit(0)).alias("gap_median"), F.get(p, F.lit(1)).alias("gap_p95"))
    largest = sizes.orderBy(F.desc("g")).limit(sample).agg(F.sort_array(F.collect_list("g"), asc=False).alias("gap_sample"))
    return counts.crossJoin(stats).crossJoin(largest)


def alignment_notes(episodes: DataFrame, most: int = 50) -> DataFrame:
    """(episode_index, note) of the first episodes that have something to note."""
    note = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("non_monotonic"), F.lit("time runs back")),
                F.when(F.col("n_duplicate_timestamps") > 0, F.concat(F.col("n_duplicate_timestamps"), F.lit(" repeated times"))),
                F.when(F.col("n_timestamp_gaps") > 0, F.concat(F.col("n_timestamp_gaps"), F.lit(" gaps in time"))),
                F.when(F.col("n_frame_gaps") > 0, F.concat(F.col("n_frame_gaps"), F.lit(" gaps in frame numbers"))),
                F.when(F.col("length_mismatch"), F.lit("state and action differ in length")),
            )
        ),
        "; ",
    )
    return episodes.select(EPISODE, note.alias("note")).filter("note <> ''").orderBy(EPISODE).limit(most)


def cameras_long(episodes: DataFrame, cameras: list[str], template: str = "videos/{}/{}") -> DataFrame:
    """Episode metadata, a row for each episode and camera: (episode_index,
    camera, from_timestamp, to_timestamp). The wide names hold slashes and dots."""
    entries = [F.struct(F.lit(c).alias("camera"), *[F.col(f"`{template.format(c, n)}`").cast("double").alias(n) for n in ("from_timestamp", "to_timestamp")]) for c in cameras]
    return episodes.select(EPISODE, F.explode(F.array(*entries)).alias("c")).select(EPISODE, "c.*")


def video_alignment(frames: DataFrame, videos: DataFrame, fps: float, count_tolerance: int = 1, seconds_tolerance: float = 0.1, frame_inclusive: bool = False) -> DataFrame:
    """A row for each episode and camera of cameras_long(): frames in the table
    against those the video's interval holds, durations, and the largest
    difference between a frame's time and its place at fps. The video's duration
    counts the last frame's own time and the table's doesn't, unless
    frame_inclusive is set."""
    w = in_order()
    placed = frames.withColumns({"at": (F.row_number().over(w) - 1) / F.lit(float(fps)), "t0": F.first(TIME).over(w)})
    own = placed.groupBy(EPISODE).agg(F.count("*").alias("n_frames"), (F.max(TIME) - F.min(TIME)).alias("table_s"), F.max(F.abs(F.col("at") + F.col("t0") - F.col(TIME))).alias("max_time_error_s"))
    length = F.col("to_timestamp") - F.col("from_timestamp")
    out = videos.join(own, EPISODE).select(EPISODE, "camera", "n_frames", half_even(length * fps).cast("long").alias("n_video_frames"), length.alias("video_s"), (F.col("table_s") + (1.0 / fps if frame_inclusive else 0.0)).alias("table_s"), "max_time_error_s")
    return out.withColumns(
        {
            "count_mismatch": F.abs(F.col("n_frames") - F.col("n_video_frames")) > count_tolerance,
            "duration_mismatch": F.abs(F.col("video_s") - F.col("table_s")) > seconds_tolerance,
            "time_mismatch": F.col("max_time_error_s") > seconds_tolerance,
        }
    )


def video_report(rows: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """One row: episodes with each flag on any camera; and of the files probed
    (camera, opened, n_frames) how many are missing, unreadable or empty."""
    flags = ("count_mismatch", "duration_mismatch", "time_mismatch")
    by_episode = rows.groupBy(EPISODE).agg(*[F.bool_or(f).alias(f) for f in flags])
    out = by_episode.agg(F.count("*").alias("n_episodes"), *[tally(F.col(f)).alias(f"n_{f}") for f in flags], tally(F.col("count_mismatch") | F.col("duration_mismatch") | F.col("time_mismatch")).alias("n_material"))
    if probes is not None:
        out = out.crossJoin(probes.agg(tally(F.col("opened").isNull()).alias("n_missing"), tally(~F.col("opened")).alias("n_unreadable"), tally(F.col("opened") & (F.coalesce("n_frames", F.lit(0)) == 0)).alias("n_zero_length")))
    return out


def sample_positions(videos: DataFrame, positions: list[float], fps: float, n_frames: str = "n_frames") -> DataFrame:
    """Frames to decode: for each position in [0, 1] within a camera's interval
    the nearest frame of its file, within the file."""
    at = F.col("from_timestamp") + F.col("p") * (F.col("to_timestamp") - F.col("from_timestamp"))
    index = F.greatest(F.lit(0.0), F.least(F.col(n_frames) - 1.0, half_even(at * fps)))
    return videos.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in positions]))).select(EPISODE, "camera", F.col("p").alias("position"), index.cast("long").alias("file_frame"))
