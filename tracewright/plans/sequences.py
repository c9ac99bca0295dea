"""Sequence and curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EpisodeRules, ImageRules
from ..functions.vectors import mean_square
from ..model import EPISODE, FRAME, TIME, consecutive, previous
from ..operators import crossmodal, curation, sequence
from .catalogue import TRAJ, W, events, query, turns, vectors

_RULES = EpisodeRules(min_frames=64, horizon=60)
_CHECK = f"""{TRAJ}, steps AS (SELECT *, t - lag(t) OVER w AS dt, frame_index - lag(frame_index) OVER w AS df FROM traj WINDOW w AS ({W})), ep AS (
SELECT episode_index, count(*) AS n_frames, list_filter([CASE WHEN count(*) < 64 THEN 'too_short_min_episode_frames' END, CASE WHEN count(*) < 60 THEN 'too_few_frames_for_horizon' END,
CASE WHEN bool_or(isnan(v) OR isinf(v) OR v IS NULL) THEN 'state_nan_inf' END, CASE WHEN bool_or(isnan(k) OR isinf(k) OR k IS NULL) THEN 'action_nan_inf' END, CASE WHEN bool_or(dt < -1e-9) THEN 'non_monotonic_timestamps' END, CASE WHEN bool_or(abs(dt) <= 1e-9) THEN 'duplicate_timestamps' END,
CASE WHEN bool_or(df <> 1) THEN 'frame_index_discontinuity' END, CASE WHEN count(v) <> count(k) THEN 'state_action_frame_length_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM steps GROUP BY episode_index)"""


def _checked(spark, d):
    return curation.episode_validation(events(spark, d), _RULES)


@query(f"WITH {_CHECK} SELECT episode_index, n_frames, len(reasons) = 0 AS accepted, array_to_string(reasons, '|') AS reasons FROM ep")
def episode_validation(spark, d):
    return _checked(spark, d).withColumn("reasons", curation.joined_reasons())


@query(f"WITH {_CHECK} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM ep) GROUP BY reason")
def reason_counts(spark, d):
    return curation.reason_counts(_checked(spark, d))


@query("WITH e AS (SELECT label AS episode_index, vec_id AS frame_index, CAST(embedding AS DOUBLE[]) AS x, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT episode_index, frame_index, round(coalesce(list_distance(x, p), 0), 6) AS motion FROM e")
def delta_norms(spark, d):
    return vectors(spark, d).select(EPISODE, FRAME, sequence.delta_norm(F.col("x")).alias("motion"))


@query(f"WITH {TRAJ} SELECT episode_index, frame_index, round(coalesce(v - lag(v) OVER ({W}), 0), 6) AS d_state, round(k, 6) AS d_grip FROM traj")
def delta_actions(spark, d):
    out = events(spark, d).withColumn("a", sequence.delta_actions(F.array("v", "k"), 1))
    return out.select(EPISODE, FRAME, F.get("a", F.lit(0)).alias("d_state"), F.get("a", F.lit(1)).alias("d_grip"))


_DUP = """z AS (SELECT label AS episode_index, vec_id AS frame_index, [round(CAST(embedding[1] AS DOUBLE), 1), round(CAST(embedding[2] AS DOUBLE), 1)] AS x FROM embeddings),
e AS (SELECT episode_index, frame_index, x, lag(x) OVER w AS p, coalesce(frame_index = lag(frame_index) OVER w + 1, false) AS c FROM z WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
f AS (SELECT episode_index, frame_index, coalesce(c AND x = p, false) AS exact_duplicate, coalesce(c AND x <> p AND list_distance(x, p) ** 2 / 2 <= 0.015, false) AS near_lossless_duplicate, coalesce(c AND x <> p AND list_distance(x, p) ** 2 / 2 > 0.015 AND list_distance(x, p) ** 2 / 2 <= 0.03, false) AS near_duplicate FROM e)"""
_BANDS = ImageRules(near_lossless_mse=0.015, near_mse=0.03)


def _coarse(spark, d):
    """Two elements of one digit, so that frames of every class of duplicates are among them."""
    return vectors(spark, d).withColumn("x", F.transform(F.slice("x", 1, 2), lambda e: F.round(e, 1)))


@query(f"WITH {_DUP} SELECT * FROM f")
def frame_duplicates(spark, d):
    return curation.with_duplicates(_coarse(spark, d), "x", _BANDS).drop("x")


@query(
    f"""WITH {_DUP}, n AS (SELECT count(*) AS n_frames, count(DISTINCT episode_index) AS n_episodes, count(*) FILTER (exact_duplicate) AS a, count(*) FILTER (near_lossless_duplicate) AS b, count(*) FILTER (near_duplicate) AS c FROM f)
SELECT n_frames, n_episodes, a AS n_exact_duplicate, b AS n_near_lossless_duplicate, c AS n_near_duplicate, n_frames - n_episodes AS n_pairs, round(a / (n_frames - n_episodes), 6) AS exact_duplicate_rate, round(b / (n_frames - n_episodes), 6) AS near_lossless_duplicate_rate, round(c / (n_frames - n_episodes), 6) AS near_duplicate_rate FROM n"""
)
def duplicate_rates(spark, d):
    return curation.duplicate_rates(curation.with_duplicates(_coarse(spark, d), "x", _BANDS))


@query("SELECT label AS episode_index, vec_id AS frame_index, round(list_distance(CAST(embedding AS DOUBLE[]), lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id)) ** 2 / 64, 6) AS mse FROM embeddings")
def vector_mse(spark, d):
    return vectors(spark, d).select(EPISODE, FRAME, mean_square(F.col("x"), previous("x")).alias("mse"))


_FROZEN = f"""{TRAJ}, b AS (SELECT *, coalesce(kind = lag(kind) OVER ({W}), false) AS dup, coalesce(abs(v - lag(v) OVER ({W})), 0) AS motion FROM traj), th AS (SELECT episode_index, coalesce(quantile_cont(motion, 0.5) FILTER (frame_index > 0), 0) AS m FROM b GROUP BY episode_index),
fr AS (SELECT b.*, m AS motion_threshold, CASE WHEN m > 0 THEN motion >= m ELSE motion > 0 END AS moving FROM b JOIN th USING (episode_index))"""


def _motion(spark, d):
    base = events(spark, d).withColumns({"dup": F.coalesce(F.col("kind") == previous("kind"), F.lit(False)), "motion": sequence.delta_norm(F.col("state")), "k_motion": sequence.delta_norm(F.col("action"))})
    return base


@query(f"WITH {_FROZEN} SELECT episode_index, frame_index, round(motion_threshold, 6) AS motion_threshold, dup AND moving AS frozen FROM fr")
def frozen_while_moving(spark, d):
    return sequence.moving(_motion(spark, d), "motion").select(EPISODE, FRAME, "motion_threshold", (F.col("dup") & F.col("moving")).alias("frozen"))


_RUNS = f"{TRAJ}, g AS (SELECT *, v > 5 AS flag, frame_index - row_number() OVER (PARTITION BY episode_index, v > 5 ORDER BY frame_index) AS island FROM traj), r AS (SELECT *, count(*) OVER (PARTITION BY episode_index, flag, island) AS n FROM g)"


@query(f"WITH {_RUNS} SELECT episode_index, frame_index, flag AND n >= 3 AS sustained FROM r")
def sustained_runs(spark, d):
    return sequence.sustained(events(spark, d).withColumn("flag", F.col("v") > 5), "flag", 3).select(EPISODE, FRAME, "sustained")


@query(f"WITH {_RUNS}, o AS (SELECT count(*) AS n FROM g WHERE flag GROUP BY episode_index, island) SELECT count(*) AS n_runs, coalesce(max(n), 0) AS max_run, round(coalesce(avg(n), 0), 6) AS mean_run, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n >= 5) AS n_five_or_more FROM o")
def run_length_stats(spark, d):
    return sequence.run_lengths(events(spark, d).withColumn("flag", F.col("v") > 5), "flag")


@query(f"WITH {TRAJ} SELECT episode_index, frame_index, v < quantile_cont(v, 0.05) OVER (PARTITION BY episode_index) AS low FROM traj")
def low_percentile_flag(spark, d):
    return sequence.below_percentile(events(spark, d), "v").select(EPISODE, FRAME, "low")


@query(f"WITH {TRAJ}, p AS (SELECT quantile_cont(v, 0.05) AS q FROM traj) SELECT episode_index, count(*) FILTER (v < q) AS n_low FROM traj, p GROUP BY episode_index")
def low_percentile_global(spark, d):
    return sequence.below_percentile(events(spark, d), "v", by=()).groupBy(EPISODE).agg(F.count(F.when(F.col("low"), 1)).alias("n_low"))


_CROSS = f"{TRAJ}, b AS (SELECT *, coalesce(kind = lag(kind) OVER ({W}), false) AS dup, coalesce(abs(v - lag(v) OVER ({W})), 0) AS sm, coalesce(abs(k - lag(k) OVER ({W})), 0) AS am FROM traj)"


@query(f"WITH {_CROSS}, p AS (SELECT quantile_cont(sm, 0.75) AS q FROM b) SELECT count(*) FILTER (dup) AS n_flagged, round(avg(sm) FILTER (dup), 6) AS mean_state_flagged, round(avg(sm) FILTER (NOT dup), 6) AS mean_state_other, round(avg(am) FILTER (dup), 6) AS mean_action_flagged, round(avg(am) FILTER (NOT dup), 6) AS mean_action_other, round(count(*) FILTER (dup AND sm >= q) / count(*) FILTER (dup), 6) AS share_high_motion FROM b, p")
def cross_modal_flag_motion(spark, d):
    return crossmodal.flag_motion(_motion(spark, d), "dup", "motion", "k_motion")


@query(f"WITH {_CROSS}, p AS (SELECT quantile_cont(sm, 0.5) AS q FROM b) SELECT count(*) FILTER (dup) AS n_duplicates, count(*) FILTER (dup AND sm > q) AS n_while_moving, round(count(*) FILTER (dup AND sm > q) / count(*) FILTER (dup), 6) AS rate FROM b, p")
def duplicates_while_moving(spark, d):
    return crossmodal.duplicates_while_moving(_motion(spark, d), "dup", "motion")


@query(f"WITH {_CROSS}, p AS (SELECT quantile_cont(am, 0.75) AS q FROM b) SELECT count(*) FILTER (am >= q) AS n_near, round(avg(CASE WHEN dup THEN 1.0 ELSE 0.0 END) FILTER (am >= q), 6) AS rate_near, round(avg(CASE WHEN dup THEN 1.0 ELSE 0.0 END) FILTER (am < q), 6) AS rate_elsewhere FROM b, p")
def low_info_near_grasp(spark, d):
    return crossmodal.low_info_near_grasp(_motion(spark, d), "dup", "k_motion")


def _smooth_sql() -> str:
    h = sequence.hat_matrix(5, 2)
    at = lambda o: "v" if o == 0 else f"lag(v, {-o}) OVER w" if o < 0 else f"lead(v, {o}) OVER w"
    row = lambda c: " + ".join(f"({h[c][i]:.17g}) * {at(i - c)}" for i in range(5))
    return f"{TRAJ}, z AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n, {row(0)} AS a0, {row(1)} AS a1, {row(2)} AS a2, {row(3)} AS a3, {row(4)} AS a4 FROM traj WINDOW w AS ({W})), s AS (SELECT episode_index, frame_index, v, CASE WHEN frame_index = 0 THEN a0 WHEN frame_index = 1 THEN a1 WHEN frame_index = n - 1 THEN a4 WHEN frame_index = n - 2 THEN a3 ELSE a2 END AS x FROM z), m AS (SELECT episode_index, sqrt(avg((x - v) ** 2)) AS rmse, stddev_pop(v) AS sd FROM s GROUP BY episode_index)"


@query(f"WITH {_smooth_sql()} SELECT episode_index, frame_index, round(CASE WHEN rmse / sd <= 0.8 THEN x ELSE v END, 6) AS smoothed FROM s JOIN m USING (episode_index)")
def savgol_smooth(spark, d):
    return sequence.smoothed(events(spark, d), "v", most_ratio=0.8).select(EPISODE, FRAME, "smoothed")


@query(
    f"""WITH {_smooth_sql()}, q AS (SELECT *, v - lag(v) OVER ({W}) AS dv, x - lag(x) OVER ({W}) AS dx FROM s)
SELECT episode_index, round(any_value(rmse), 6) AS rmse, round(any_value(rmse / sd), 6) AS rmse_over_std, round(max(abs(x - v)), 6) AS max_abs_change, round(var_pop(dv), 6) AS diff_var_before, round(var_pop(dx), 6) AS diff_var_after, round((var_pop(dv) - var_pop(dx)) / var_pop(dv), 6) AS diff_var_reduction, any_value(rmse / sd) <= 0.35 AS applied FROM q JOIN m USING (episode_index) GROUP BY episode_index"""
)
def smoothing_metrics(spark, d):
    return sequence.smoothing_metrics(events(spark, d), "v")


def _window_sql(horizon: int, ok: str, stride: int, policy: str) -> str:
    return f"""SELECT episode_index, frame_index AS start_frame, frame_index + {horizon} AS end_frame, round(t, 6) AS start_timestamp, round(te, 6) AS end_timestamp, {horizon} AS n_frames, '{policy}' AS policy FROM (
SELECT *, row_number() OVER w AS rn, count(*) OVER a AS n, min(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER a AS o, last_value(t) OVER a AS te, coalesce(sum(bad) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND {horizon - 1} FOLLOWING), 0) AS b
FROM (SELECT *, CASE WHEN lag(frame_index) OVER w IS NULL OR (frame_index = lag(frame_index) OVER w + 1 AND t > lag(t) OVER w) THEN 0 ELSE 1 END AS bad FROM traj WINDOW w AS ({W})) WINDOW w AS ({W}), a AS ({W} ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING)) WHERE n = {horizon} AND o = 1 AND b = 0 AND (rn - 1) % {stride} = 0"""


_STRICT = "v < 200"


def _windows(spark, d, policy: str):
    return sequence.training_windows(events(spark, d), 16, 2, F.lit(True) if policy == "conservative" else F.col("v") < 200, policy)


@query(f"WITH {TRAJ} {_window_sql(16, 'true', 2, 'conservative')}")
def training_windows_conservative(spark, d):
    return _windows(spark, d, "conservative")


@query(f"WITH {TRAJ} {_window_sql(16, _STRICT, 2, 'strict')}")
def training_windows_strict(spark, d):
    return _windows(spark, d, "strict")


@query(f"WITH traj AS (SELECT conv_id AS episode_index, turn AS frame_index, turn / 2.0 AS t, role FROM conversations WHERE turn <> 2) {_window_sql(2, 'true', 1, 'conservative')}")
def training_windows_turns(spark, d):
    return sequence.training_windows(turns(spark, d).filter("frame_index <> 2"), 2)


@query(f"WITH {TRAJ}, c AS ({_window_sql(16, 'true', 2, 'conservative')}), s AS ({_window_sql(16, _STRICT, 2, 'strict')}) SELECT count(*) AS n_not_covered FROM s ANTI JOIN c ON s.episode_index = c.episode_index AND s.start_frame = c.start_frame")
def window_subset_check(spark, d):
    return sequence.not_subset(_windows(spark, d, "strict"), _windows(spark, d, "conservative")).agg(F.count("*").alias("n_not_covered"))


@query(f"WITH {TRAJ}, c AS ({_window_sql(16, 'true', 2, 'conservative')}), s AS ({_window_sql(16, _STRICT, 2, 'strict')}) SELECT policy, count(*) AS n_windows, count(DISTINCT episode_index) AS n_episodes FROM (FROM c UNION ALL FROM s) GROUP BY policy")
def window_counts(spark, d):
    return sequence.window_counts(_windows(spark, d, "conservative").unionByName(_windows(spark, d, "strict")))


@query(f"WITH {TRAJ}, s AS ({_window_sql(16, _STRICT, 2, 'strict')}) SELECT episode_index, frame_index FROM traj AS f WHERE EXISTS (SELECT 1 FROM s WHERE s.episode_index = f.episode_index AND f.frame_index >= start_frame AND f.frame_index < end_frame)")
def frames_covered(spark, d):
    return sequence.covered(events(spark, d), _windows(spark, d, "strict")).select(EPISODE, FRAME)


@query(f"WITH {TRAJ}, s AS ({_window_sql(16, _STRICT, 2, 'strict')}) SELECT s.episode_index, start_frame, count(*) AS n, round(sum(f.v), 6) AS total, round(max_by(f.v, f.frame_index), 6) AS last_value FROM s JOIN traj AS f ON s.episode_index = f.episode_index AND f.frame_index >= start_frame AND f.frame_index < end_frame GROUP BY ALL")
def window_resolve(spark, d):
    out = sequence.window_frames(events(spark, d), _windows(spark, d, "strict"), "v")
    return out.select(EPISODE, "start_frame", F.size("frames").alias("n"), F.aggregate("frames", F.lit(0.0), lambda s, x: s + x["v"]).alias("total"), F.element_at("frames", -1)["v"].alias("last_value"))


@query(f"WITH {TRAJ} SELECT a.episode_index, a.frame_index FROM traj AS a SEMI JOIN traj AS b ON a.episode_index = b.episode_index AND a.frame_index + 5 = b.frame_index")
def future_targets(spark, d):
    return sequence.future_exists(events(spark, d), 5).select(EPISODE, FRAME)


@query(f"WITH {TRAJ} SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS global_index FROM traj")
def global_positions(spark, d):
    return sequence.global_position(events(spark, d)).select(EPISODE, FRAME, "global_index")


@query("WITH m AS (SELECT label AS episode_index, vec_id AS frame_index, max(vec_id) OVER (PARTITION BY label) AS top FROM embeddings) SELECT episode_index, frame_index, CASE WHEN top <= 0 OR frame_index / top <= 0.25 THEN 'early' WHEN frame_index / top >= 0.75 THEN 'late' ELSE 'middle' END AS part FROM m")
def temporal_position(spark, d):
    return vectors(spark, d).select(EPISODE, FRAME, sequence.temporal_position().alias("part"))


@query(
    f"""WITH {TRAJ}, n AS (SELECT episode_index, count(*) AS n, CAST(floor(0.4 * count(*)) AS BIGINT) AS a, CAST(floor(0.85 * count(*)) AS BIGINT) AS b FROM traj GROUP BY episode_index HAVING count(*) >= 8), i AS (SELECT * FROM range(4) AS r(i)),
p AS (SELECT DISTINCT episode_index, n, 0 AS label, CASE WHEN i = least(4, a) - 1 THEN a - 1 ELSE CAST(floor(i * ((a - 1) / (least(4, a) - 1))) AS BIGINT) END AS f FROM n, i WHERE i < least(4, a) UNION ALL SELECT DISTINCT episode_index, n, 1, CASE WHEN i = least(4, n - b) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1 - b) / (least(4, n - b) - 1)) + b) AS BIGINT) END FROM n, i WHERE i < least(4, n - b))
SELECT episode_index, f AS frame_index, label, round(f / greatest(n - 1, 1), 6) AS position FROM p"""
)
def proxy_labels(spark, d):
    return sequence.proxy_labels(events(spark, d))


@query(f"WITH {TRAJ}, s AS (SELECT *, CASE WHEN frame_index % 5 = 0 OR frame_index = max(frame_index) OVER (PARTITION BY episode_index) THEN v END AS x FROM traj), w AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS xa, first_value(x IGNORE NULLS) OVER b AS xb, last_value(CASE WHEN x IS NOT NULL THEN frame_index END IGNORE NULLS) OVER a AS fa, first_value(CASE WHEN x IS NOT NULL THEN frame_index END IGNORE NULLS) OVER b AS fb FROM s WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT episode_index, frame_index, round(coalesce(x, xa + (xb - xa) * (frame_index - fa) / (fb - fa)), 6) AS score FROM w")
def interp_scores(spark, d):
    sparse = events(spark, d).withColumn("x", F.when(sequence.every_kth(5), F.col("v")))
    return sequence.interpolated(sparse, "x").select(EPISODE, FRAME, F.col("interpolated").alias("score"))


@query(f"WITH {TRAJ} SELECT episode_index, count(*) FILTER (frame_index = p + 1) AS n_consecutive FROM (SELECT *, lag(frame_index) OVER ({W}) AS p FROM traj WHERE (frame_index + episode_index) % 7 <> 3) GROUP BY episode_index")
def adjacent_pairs(spark, d):
    """Every seventh frame is missing."""
    return events(spark, d).filter(F.pmod(F.col(FRAME) + F.col(EPISODE), F.lit(7)) != 3).withColumn("c", consecutive()).groupBy(EPISODE).agg(F.count(F.when(F.col("c"), 1)).alias("n_consecutive"))


@query(f"WITH {TRAJ}, m AS (SELECT DISTINCT episode_index FROM traj ORDER BY episode_index LIMIT 20) SELECT episode_index, count(*) AS n, round(max(t), 6) AS last_t FROM traj SEMI JOIN m USING (episode_index) GROUP BY episode_index")
def episode_cap(spark, d):
    from ..model import lowest_episodes

    return lowest_episodes(events(spark, d), 20).groupBy(EPISODE).agg(F.count("*").alias("n"), F.max(TIME).alias("last_t"))
