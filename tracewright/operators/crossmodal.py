"""Visual flags against motion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mean_where, ratio, tally


def flag_motion(frames: DataFrame, flag: str, state_motion: str, action_motion: str, percentile: float = 0.75) -> DataFrame:
    """One row: flagged frames, mean motion of flagged and other frames, and the
    share of flagged ones whose state moves at least as the percentile of all."""
    # A single row: the percentile.
    level = frames.agg(F.percentile(state_motion, F.lit(percentile)).alias("_level"))
    f = F.coalesce(F.col(flag), F.lit(False))
    out = frames.crossJoin(F.broadcast(level)).agg(
        tally(f).alias("n_flagged"),
        mean_where(f, F.col(state_motion)).alias("mean_state_flagged"),
        mean_where(~f, F.col(state_motion)).alias("mean_state_other"),
        mean_where(f, F.col(action_motion)).alias("mean_action_flagged"),
        mean_where(~f, F.col(action_motion)).alias("mean_action_other"),
        tally(f & (F.col(state_motion) >= F.col("_level"))).alias("_high"),
    )
    return out.withColumn("share_high_motion", ratio(F.col("_high").cast("double"), F.col("n_flagged"))).drop("_high")


def duplicates_while_moving(frames: DataFrame, duplicate: str, motion: str) -> DataFrame:
    """One row: duplicates, and those in frames that move more than the median."""
    level = frames.agg(F.percentile(motion, F.lit(0.5)).alias("_level"))
    d = F.coalesce(F.col(duplicate), F.lit(False))
    out = frames.crossJoin(F.broadcast(level)).agg(tally(d).alias("n_duplicates"), tally(d & (F.col(motion) > F.col("_level"))).alias("n_while_moving"))
    return out.withColumn("rate", ratio(F.col("n_while_moving").cast("double"), F.col("n_duplicates")))


def low_info_near_grasp(frames: DataFrame, low_info: str, grip_motion: str, percentile: float = 0.75) -> DataFrame:
    """One row: rate of the flag where the gripper moves at least as the
    percentile, and elsewhere."""
    level = frames.agg(F.percentile(grip_motion, F.lit(percentile)).alias("_level"))
    f = F.when(F.coalesce(F.col(low_info), F.lit(False)), 1.0).otherwise(0.0)
    near = F.col(grip_motion) >= F.col("_level")
    return frames.crossJoin(F.broadcast(level)).agg(tally(near).alias("n_near"), mean_where(near, f).alias("rate_near"), mean_where(~near, f).alias("rate_elsewhere"))


def report(frames: DataFrame, flags: list[str], state_motion: str, action_motion: str) -> DataFrame:
    """flag_motion() of several flags, a row for each."""
    out = None
    for f in flags:
        one = flag_motion(frames, f, state_motion, action_motion).withColumn("flag", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out
