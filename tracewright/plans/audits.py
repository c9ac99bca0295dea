"""Audit queries: summaries, timing, jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import long_form
from ..model import EPISODE, FRAME
from ..operators import alignment, discontinuity, summary
from .catalogue import LONG, TRAJ, W, events, query, read, vectors

_STATS = "count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std, round(min({0}), 6) AS min, round(max({0}), 6) AS max"
_LEVELS = ", ".join(f"round(quantile_cont({{0}}, {p}), 6) AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)))
_STEPS = f"steps AS (SELECT *, t - lag(t) OVER w AS dt, frame_index - lag(frame_index) OVER w AS df FROM traj WINDOW w AS ({W}))"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(vectors(spark, sf_dir), F.col("x"), [EPISODE, FRAME])


@query("SELECT user_id AS episode_index, count(*) AS length FROM events GROUP BY user_id")
def episode_lengths(spark, d):
    return summary.group_sizes(events(spark, d), EPISODE)


@query(f"WITH l AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id) SELECT {_STATS.format('n')}, {_LEVELS.format('n')} FROM l")
def length_summary(spark, d):
    return summary.summary(summary.group_sizes(events(spark, d), EPISODE), F.col("length"))


@query(f"SELECT l_returnflag, {_STATS.format('l_extendedprice')}, {_LEVELS.format('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def metric_summary(spark, d):
    return summary.summary(read(spark, d, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"])


@query(f"WITH {LONG} SELECT dim, count(*) AS count, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median FROM long GROUP BY dim")
def per_dim_stats(spark, d):
    return summary.per_dim(_long(spark, d))


@query(f"WITH {LONG}, bad AS (SELECT episode_index, CASE WHEN (frame_index + dim) % 97 = 0 THEN 'nan'::DOUBLE WHEN (frame_index + dim) % 89 = 0 THEN 'inf'::DOUBLE WHEN (frame_index + dim) % 83 = 0 THEN '-inf'::DOUBLE ELSE value END AS value FROM long) SELECT episode_index, count(*) AS n_elements, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf FROM bad GROUP BY episode_index")
def nan_inf_counts(spark, d):
    """Of the embeddings with faults planted by place."""
    at = F.col(FRAME) + F.col("dim")
    planted = F.when(at % 97 == 0, float("nan")).when(at % 89 == 0, float("inf")).when(at % 83 == 0, float("-inf")).otherwise(F.col("value"))
    return summary.nonfinite_counts(_long(spark, d).withColumn("value", planted), [EPISODE])


@query(f"WITH {LONG} SELECT dim, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS range, stddev_pop(value) < 1e-5 OR max(value) - min(value) < 1e-4 AS near_stuck FROM long GROUP BY dim")
def near_stuck(spark, d):
    return summary.near_stuck(_long(spark, d))


@query("SELECT user_id AS episode_index, count(value) AS count, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM events GROUP BY user_id")
def mad_by_episode(spark, d):
    return summary.median_and_mad(events(spark, d), F.col("v"), [EPISODE])


@query(
    """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med, mad(l_extendedprice) AS mad FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (abs(l_extendedprice - med) / (1.4826 * greatest(mad, 1e-6)) > 2) AS n_outliers, round(avg(CASE WHEN abs(l_extendedprice - med) / (1.4826 * greatest(mad, 1e-6)) > 2 THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM lineitem JOIN m USING (l_suppkey) GROUP BY l_suppkey"""
)
def robust_outliers(spark, d):
    return summary.robust_outliers(read(spark, d, "lineitem"), F.col("l_extendedprice"), ["l_suppkey"], k=2.0)


@query(
    """WITH e AS (SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag), s AS (
SELECT l_returnflag, any_value(low) AS low, any_value(high) AS high, avg(CASE WHEN l_quantity <= low + 0.05 * (high - low) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN l_quantity >= high - 0.05 * (high - low) THEN 1.0 ELSE 0.0 END) AS b FROM lineitem JOIN e USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_returnflag, low, high, round(a, 6) AS share_low, round(b, 6) AS share_high, a >= 0.05 OR b >= 0.05 AS saturated FROM s"""
)
def boundary_saturation(spark, d):
    return summary.boundary_saturation(read(spark, d, "lineitem"), F.col("l_quantity"), ["l_returnflag"], eps=0.05)


_HIST = "e AS (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem), h AS (SELECT r.bin, count(l.b) AS n FROM range(40) AS r(bin) LEFT JOIN (SELECT CAST(least(floor((l_quantity - low) / (high - low) * 40), 39) AS BIGINT) AS b FROM lineitem, e) AS l ON l.b = r.bin GROUP BY r.bin)"


@query(f"WITH {_HIST} SELECT bin, n FROM h")
def modality_histogram(spark, d):
    return summary.histogram(read(spark, d, "lineitem"), F.col("l_quantity"))


@query(
    f"""WITH {_HIST}, p AS (SELECT count(*) AS n_peaks FROM (SELECT n, lag(n) OVER (ORDER BY bin) AS a, lead(n) OVER (ORDER BY bin) AS b, max(n) OVER () AS top FROM h) WHERE n > a AND n > b AND n > 0.05 * top),
m AS (SELECT avg(CASE WHEN l_quantity <= low + 0.15 * (high - low) THEN 1.0 ELSE 0.0 END) AS x, avg(CASE WHEN l_quantity >= high - 0.15 * (high - low) THEN 1.0 ELSE 0.0 END) AS y, quantile_cont(l_quantity, 0.1) AS q10, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem, e)
SELECT n_peaks, round(x, 6) AS mass_low, round(y, 6) AS mass_high, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, n_peaks >= 2 OR (x > 0.15 AND y > 0.15) AS bimodal FROM p, m"""
)
def gripper_modality(spark, d):
    return summary.modality(read(spark, d, "lineitem"), F.col("l_quantity"))


@query(f"WITH {TRAJ}, s AS (SELECT t - lag(t) OVER (PARTITION BY episode_index ORDER BY t) AS d FROM traj) SELECT round(median(d), 6) AS dt FROM s WHERE d > 0")
def dt_inference(spark, d):
    return alignment.inferred_dt(events(spark, d))


_ALIGN = f"""{TRAJ}, {_STEPS}, m AS (SELECT episode_index, median(dt) FILTER (dt > 0) AS e FROM steps GROUP BY episode_index), al AS (
SELECT episode_index, count(*) AS n_frames, any_value(e) AS expected_dt, coalesce(bool_or(dt < -1e-9), false) AS non_monotonic, count(*) FILTER (abs(dt) <= 1e-9) AS n_duplicate_timestamps,
count(*) FILTER (dt > 1.5 * e) AS n_timestamp_gaps, count(*) FILTER (df <> 1) AS n_frame_gaps, count(v) <> count(k) AS length_mismatch FROM steps JOIN m USING (episode_index) GROUP BY episode_index)"""


def _alignment(spark, d):
    return alignment.episode_alignment(events(spark, d), state="v", action="k")


@query(f"WITH {_ALIGN} SELECT episode_index, n_frames, round(expected_dt, 6) AS expected_dt, non_monotonic, n_duplicate_timestamps, n_timestamp_gaps, n_frame_gaps, length_mismatch FROM al")
def episode_alignment(spark, d):
    return _alignment(spark, d).drop("gap_sizes")


@query(
    f"""WITH {_ALIGN}, g AS (SELECT dt AS g FROM steps JOIN m USING (episode_index) WHERE dt > 1.5 * e)
SELECT (SELECT count(*) FROM al) AS n_episodes, (SELECT count(*) FILTER (non_monotonic) FROM al) AS n_non_monotonic, (SELECT count(*) FILTER (n_duplicate_timestamps > 0) FROM al) AS n_with_duplicates, (SELECT count(*) FILTER (n_timestamp_gaps > 0) FROM al) AS n_with_gaps,
(SELECT count(*) FILTER (n_frame_gaps > 0) FROM al) AS n_with_frame_gaps, (SELECT count(*) FILTER (length_mismatch) FROM al) AS n_length_mismatch, (SELECT CAST(sum(n_duplicate_timestamps) AS BIGINT) FROM al) AS duplicate_timestamps, (SELECT CAST(sum(n_timestamp_gaps) AS BIGINT) FROM al) AS timestamp_gaps, (SELECT CAST(sum(n_frame_gaps) AS BIGINT) FROM al) AS frame_gaps,
count(g) AS gap_count, round(min(g), 6) AS gap_min, round(max(g), 6) AS gap_max, round(avg(g), 6) AS gap_mean, round(median(g), 6) AS gap_median, round(quantile_cont(g, 0.95), 6) AS gap_p95 FROM g"""
)
def alignment_rollup(spark, d):
    return alignment.alignment_rollup(_alignment(spark, d)).drop("gap_sample")


@query(f"WITH {_ALIGN} SELECT episode_index, n_timestamp_gaps || ' gaps in time' AS note FROM al WHERE n_timestamp_gaps > 0 ORDER BY episode_index LIMIT 50")
def alignment_notes(spark, d):
    return alignment.alignment_notes(_alignment(spark, d))


_VIDEO = "SELECT episode_index, c AS camera, min(t) + (CASE c WHEN 'top' THEN 0.0 ELSE 0.5 END) AS a, max(t) + 1.0 AS b FROM traj, (VALUES ('wrist'), ('top')) AS cams(c) GROUP BY episode_index, c"


@query(
    f"""WITH {TRAJ}, vid AS ({_VIDEO}), own AS (SELECT episode_index, count(*) AS n, max(t) - min(t) AS s, max(abs((frame_index / 0.01) + t0 - t)) AS e FROM (SELECT *, first_value(t) OVER (PARTITION BY episode_index ORDER BY frame_index) AS t0 FROM traj) GROUP BY episode_index)
SELECT episode_index, camera, n AS n_frames, CAST(round_even((b - a) * 0.01, 0) AS BIGINT) AS n_video_frames, round(b - a, 6) AS video_s, round(s, 6) AS table_s, round(e, 6) AS max_time_error_s, abs(n - CAST(round_even((b - a) * 0.01, 0) AS BIGINT)) > 1 AS count_mismatch, abs(b - a - s) > 0.75 AS duration_mismatch, e > 0.75 AS time_mismatch FROM vid JOIN own USING (episode_index)"""
)
def video_alignment(spark, d):
    frames = events(spark, d)
    ends = frames.groupBy(EPISODE).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    wide = ends.select(EPISODE, (F.col("a") + 0.5).alias("videos/wrist/from_timestamp"), (F.col("b") + 1.0).alias("videos/wrist/to_timestamp"), F.col("a").alias("videos/top/from_timestamp"), (F.col("b") + 1.0).alias("videos/top/to_timestamp"))
    return alignment.video_alignment(frames, alignment.cameras_long(wide, ["wrist", "top"]), fps=0.01, seconds_tolerance=0.75)


_DELTA = f"{TRAJ}, dl AS (SELECT episode_index, frame_index, v, v - lag(v) OVER ({W}) AS d FROM traj), th AS (SELECT episode_index, greatest(3 * greatest(coalesce(mad(d), 0), 1e-6), 1.0, 0.1 * (max(v) - min(v))) AS threshold FROM dl GROUP BY episode_index)"
_JUMPS = {"k": 3.0, "least": 1.0, "range_share": 0.1}


def _deltas(spark, d):
    return discontinuity.element_deltas(events(spark, d), F.col("state"))


@query(f"WITH {_DELTA} SELECT episode_index, 0 AS dim, round(any_value(threshold), 6) AS threshold, count(*) FILTER (abs(d) > threshold) AS n_flagged, round(count(*) FILTER (abs(d) > threshold) / greatest(count(d), 1), 6) AS rate, round(max(abs(d)), 6) AS max_abs_delta FROM dl JOIN th USING (episode_index) GROUP BY episode_index")
def discontinuities(spark, d):
    x = _deltas(spark, d)
    return discontinuity.discontinuities(discontinuity.element_flags(x, discontinuity.thresholds(x, **_JUMPS)))


@query(f"WITH {_DELTA} SELECT episode_index, frame_index, round(d, 6) AS delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY abs(d) DESC, frame_index) AS rank FROM dl WHERE d IS NOT NULL) WHERE rank <= 5")
def discontinuity_topk(spark, d):
    return discontinuity.largest(_deltas(spark, d)).select(EPISODE, FRAME, "delta", "rank")


@query(f"WITH {_DELTA}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY abs(d) DESC, frame_index) AS rank FROM dl WHERE d IS NOT NULL) SELECT episode_index, frame_index, 0 AS dim, round(v - d, 6) AS before, round(v, 6) AS after, round(abs(d), 6) AS size FROM r WHERE rank = 1 ORDER BY abs(d) DESC, episode_index LIMIT 10")
def largest_jumps(spark, d):
    return discontinuity.largest_overall(_deltas(spark, d))


@query(
    f"""WITH {TRAJ}, l AS (SELECT episode_index, frame_index, 0 AS dim, v AS x FROM traj UNION ALL SELECT episode_index, frame_index, 1, k FROM traj), dl AS (SELECT *, x - lag(x) OVER (PARTITION BY episode_index, dim ORDER BY frame_index) AS d FROM l),
th AS (SELECT episode_index, dim, 2 * greatest(coalesce(mad(d), 0), 1e-6) AS a, greatest(3 * greatest(coalesce(mad(d), 0), 1e-6), 0.25 * (max(x) - min(x))) AS b FROM dl GROUP BY episode_index, dim)
SELECT episode_index, frame_index, bool_or(coalesce(abs(d) > a, false)) AS any_discontinuity, bool_or(coalesce(abs(d) > b, false)) AS severe_discontinuity FROM dl JOIN th USING (episode_index, dim) GROUP BY episode_index, frame_index"""
)
def discontinuity_timestep(spark, d):
    return discontinuity.timestep_flags(events(spark, d), {"state": F.col("state"), "action": F.col("action")}, {"k": 2.0}, {"k": 3.0, "range_share": 0.25})
