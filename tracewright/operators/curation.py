"""Which episodes and frames are fit for training, and why not the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EpisodeRules, ImageRules
from ..functions.scalar import INFINITY, tally
from ..functions.vectors import mean_square
from ..model import EPISODE, consecutive, previous
from .alignment import episode_alignment
from .sequence import below_percentile, moving, sustained


def _any_bad(vector: str) -> Column:
    return F.coalesce(F.bool_or(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == INFINITY))), F.lit(False))


def _codes(*entries: Column) -> Column:
    return F.array_compact(F.array(*entries))


def episode_validation(frames: DataFrame, rules: EpisodeRules, state: str = "state", action: str = "action", videos: DataFrame | None = None) -> DataFrame:
    """(episode_index, n_frames, accepted, reasons): every rule that an episode
    breaks, in a fixed order. state and action are vector columns; videos, if
    given, has (episode_index, video_ok, video_mismatch)."""
    bad = {"bad_state": _any_bad(state), "bad_action": _any_bad(action)}
    joined = episode_alignment(frames.filter(F.col(EPISODE).isNotNull()), rules.fps, rules.gap_factor, state=state, action=action, also=bad)
    joined = joined.join(videos, EPISODE, "left") if videos is not None else joined.withColumns({"video_ok": F.lit(True), "video_mismatch": F.lit(False)})

    def when(on: bool, broken: Column, code: str) -> Column:
        return F.when(F.lit(on) & broken, F.lit(code))

    reasons = _codes(
        when(True, F.col("n_frames") < rules.min_frames, "too_short_min_episode_frames"),
        when(True, F.col("n_frames") < rules.horizon, "too_few_frames_for_horizon"),
        when(rules.reject_nan_inf, F.col("bad_state"), "state_nan_inf"),
        when(rules.reject_nan_inf, F.col("bad_action"), "action_nan_inf"),
        when(rules.reject_non_monotonic, F.col("non_monotonic"), "non_monotonic_timestamps"),
        when(rules.reject_duplicate_timestamps, F.col("n_duplicate_timestamps") > 0, "duplicate_timestamps"),
        when(rules.reject_frame_gaps, F.col("n_frame_gaps") > 0, "frame_index_discontinuity"),
        when(rules.reject_length_mismatch, F.col("length_mismatch"), "state_action_frame_length_mismatch"),
        when(rules.reject_missing_video, ~F.coalesce("video_ok", F.lit(False)), "missing_or_unreadable_wrist_video"),
        when(rules.reject_video_mismatch, F.coalesce("video_mismatch", F.lit(False)), "material_video_tabular_mismatch"),
    )
    return joined.select(EPISODE, "n_frames", reasons.alias("reasons")).select(EPISODE, "n_frames", (F.size("reasons") == 0).alias("accepted"), "reasons")


def reason_counts(*tables: DataFrame) -> DataFrame:
    """(reason, n) over the `reasons` arrays of several tables."""
    out = None
    for t in tables:
        one = t.select(F.explode("reasons").alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("reason").agg(F.count("*").alias("n"))


def duplicate_class(value: Column, rules: ImageRules = ImageRules(), digest: Column | None = None) -> tuple[Column, Column, Column]:
    """(exact, near lossless, near) of a frame against the one before it, which
    must be the previous frame of the same episode; they exclude one another. A
    null frame is like none. value: a vector; digest: compared for equality, if
    it is cheaper."""
    before = previous(value)
    comparable = consecutive() & value.isNotNull() & before.isNotNull()
    same = (digest == previous(digest)) if digest is not None else value == before
    mse = mean_square(value, before)
    exact = comparable & same
    lossless = comparable & ~same & (mse <= rules.near_lossless_mse)
    near = comparable & ~same & (mse > rules.near_lossless_mse) & (mse <= rules.near_mse)
    return tuple(F.coalesce(c, F.lit(False)) for c in (exact, lossless, near))


def with_duplicates(frames: DataFrame, value: str, rules: ImageRules = ImageRules()) -> DataFrame:
    exact, lossless, near = duplicate_class(F.col(value), rules)
    return frames.withColumns({"exact_duplicate": exact, "near_lossless_duplicate": lossless, "near_duplicate": near})


def duplicate_rates(frames: DataFrame) -> DataFrame:
    """One row: frames, episodes, comparable pairs (frames less episodes), counts
    and rates of the three classes."""
    n = frames.agg(F.count("*").alias("n_frames"), F.count_distinct(EPISODE).alias("n_episodes"), *[tally(F.col(c)).alias(f"n_{c}") for c in ("exact_duplicate", "near_lossless_duplicate", "near_duplicate")])
    n = n.withColumn("n_pairs", F.greatest(F.col("n_frames") - F.col("n_episodes"), F.lit(0)))
    return n.withColumns({f"{c}_rate": F.col(f"n_{c}") / F.greatest(F.col("n_pairs"), F.lit(1)) for c in ("exact_duplicate", "near_lossless_duplicate", "near_duplicate")})


def visual_flags(frames: DataFrame, rules: ImageRules, sharpness_limit: float | None = None) -> DataFrame:
    """Per-frame flags and reason codes from scored frames: sharpness,
    underexposed, overexposed, low_entropy, the duplicate classes, motion, and
    decode_failure. The sharpness limit is the episode's percentile, unless given."""
    out = below_percentile(frames, "sharpness", rules.sharpness_percentile, name="low_sharpness") if sharpness_limit is None else frames.withColumn("low_sharpness", F.coalesce(~F.isnan("sharpness") & (F.col("sharpness") < sharpness_limit), F.lit(False)))
    out = moving(out, "state_motion", rules.motion_percentile)
    still = F.col("exact_duplicate") | F.col("near_lossless_duplicate") if rules.frozen_uses_near_lossless else F.col("exact_duplicate")
    out = out.withColumn("frozen_candidate", still & F.col("moving"))
    out = sustained(out, "frozen_candidate", rules.frozen_run, "frozen_sustained")
    out = sustained(out, "overexposed", rules.overexposed_run, "overexposed_sustained")
    any_copy = F.col("exact_duplicate") | F.col("near_lossless_duplicate") | F.col("near_duplicate")
    code = lambda flag, name: F.when(F.col(flag), F.lit(name))
    reasons = _codes(
        code("decode_failure", "missing_or_undecodable_wrist"),
        code("low_sharpness", "low_sharpness_soft"),
        code("underexposed", "underexposed"),
        code("overexposed", "overexposed"),
        code("overexposed_sustained", "sustained_overexposure"),
        code("low_entropy", "low_entropy_heuristic"),
        code("exact_duplicate", "exact_duplicate"),
        code("near_lossless_duplicate", "near_lossless_duplicate"),
        code("near_duplicate", "near_duplicate"),
        code("frozen_candidate", "frozen_while_moving_candidate"),
        code("frozen_sustained", "sustained_frozen_while_moving"),
        F.when(any_copy & ~F.col("moving"), F.lit("stationary_duplicate_keep")),
    )
    return out.withColumns(
        {
            "reasons": reasons,
            "soft_review": F.col("low_sharpness") | F.col("overexposed") | F.col("low_entropy") | F.col("frozen_candidate"),
            "soft_exclude": F.col("overexposed_sustained") | F.col("frozen_sustained"),
        }
    )


def policy_ok(policy: str) -> Column:
    """conservative: hard-valid frames; strict: those without soft exclusion too."""
    if policy == "conservative":
        return F.col("hard_valid")
    if policy == "strict":
        return F.col("hard_valid") & ~F.col("soft_exclude_strict")
    raise ValueError(f"unknown policy {policy}")


def joined_reasons(c: str = "reasons") -> Column:
    return F.array_join(c, "|")
