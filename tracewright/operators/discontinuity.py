"""Jumps in vector sequences against robust thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import above, finite, is_finite, tally
from ..functions.vectors import long_form
from ..model import EPISODE, FRAME
from .summary import median_and_mad


def element_deltas(frames: DataFrame, vector: Column, by: Sequence[str] = (EPISODE,)) -> DataFrame:
    """(by, frame_index, dim, value, delta): the difference to the frame before;
    null for the first. Without `by` differences run across episodes."""
    long = long_form(frames, vector, [EPISODE, FRAME])
    w = Window.partitionBy(*by, "dim").orderBy(*([] if EPISODE in by else [EPISODE]), FRAME)
    return long.withColumn("delta", F.col("value") - F.lag("value").over(w))


def limit(mad: Column, span: Column, k: float = 8.0, floor: float = 1e-6, least: float = 0.0, range_share: float = 0.0) -> Column:
    return F.greatest(k * F.greatest(F.coalesce(mad, F.lit(0.0)), F.lit(floor)), F.lit(least), range_share * F.coalesce(span, F.lit(0.0)))


def thresholds(deltas: DataFrame, by: Sequence[str] = (EPISODE, "dim"), k: float = 8.0, floor: float = 1e-6, least: float = 0.0, range_share: float = 0.0) -> DataFrame:
    """(by, threshold): the greatest of k times the deltas' MAD (or the floor),
    an absolute least, and a share of the values' range."""
    spread = deltas.groupBy(*by).agg((F.max(finite(F.col("value"))) - F.min(finite(F.col("value")))).alias("range"))
    mad = median_and_mad(deltas.filter("delta is not null"), F.col("delta"), by).select(*by, "mad")
    return spread.join(mad, list(by), "left").select(*by, limit(F.col("mad"), F.col("range"), k, floor, least, range_share).alias("threshold"))


def element_flags(deltas: DataFrame, limits: DataFrame, by: Sequence[str] = (EPISODE, "dim")) -> DataFrame:
    """Flags each element: `flag` for finite jumps, `flag_any` for infinite too."""
    jump = above(F.abs("delta"), F.col("threshold"))
    return deltas.join(limits, list(by)).withColumns({"flag_any": jump, "flag": jump & is_finite(F.col("delta"))})


def discontinuities(flagged: DataFrame, by: Sequence[str] = (EPISODE, "dim")) -> DataFrame:
    """Per group: threshold, jumps, their rate over all differences, and the largest."""
    some = F.col("delta").isNotNull()
    return flagged.groupBy(*by).agg(F.first("threshold").alias("threshold"), tally(F.col("flag")).alias("n_flagged"), (tally(F.col("flag")) / F.greatest(tally(some), F.lit(1))).alias("rate"), F.max(F.abs(finite(F.col("delta")))).alias("max_abs_delta"))


def largest(deltas: DataFrame, by: Sequence[str] = (EPISODE, "dim"), n: int = 5) -> DataFrame:
    """The n largest differences of each group; ties by episode and frame."""
    size = F.abs(finite(F.col("delta")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), EPISODE, FRAME))
    return deltas.withColumn("size", size).filter("size is not null").withColumn("rank", rank).filter(F.col("rank") <= n)


def largest_overall(deltas: DataFrame, n: int = 10) -> DataFrame:
    """Of each episode the largest jump, and of those the n largest, with the
    value before and after. A heap of n rows in each task, no sort of all."""
    top = deltas.withColumn("size", F.abs(finite(F.col("delta")))).filter("size is not null")
    best = top.groupBy(EPISODE).agg(F.max(F.struct("size", (-F.col(FRAME)).alias("f"), (-F.col("dim")).alias("d"), "value", "delta")).alias("b"))
    return best.select(EPISODE, (-F.col("b.f")).alias(FRAME), (-F.col("b.d")).alias("dim"), (F.col("b.value") - F.col("b.delta")).alias("before"), F.col("b.value").alias("after"), F.col("b.size").alias("size")).orderBy(F.desc("size"), EPISODE).limit(n)


def timestep_flags(frames: DataFrame, vectors: dict[str, Column], ordinary: dict[str, float], severe: dict[str, float]) -> DataFrame:
    """(episode_index, frame_index, any_discontinuity, severe_discontinuity):
    whether any element of any vector jumps, infinities included, by two sets of
    threshold parameters (see thresholds()). All vectors are one long table; its
    thresholds are windows over an episode's element, so it is read once."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("vector"), v.alias("x")) for i, v in enumerate(vectors.values())]))
    long = frames.filter(F.col(EPISODE).isNotNull()).select(EPISODE, FRAME, each.alias("_v")).select(EPISODE, FRAME, "_v.vector", F.posexplode("_v.x").alias("dim", "value"))
    w = Window.partitionBy(EPISODE, "vector", "dim")
    d = long.withColumn("delta", F.col("value") - F.lag("value").over(w.orderBy(FRAME)))
    x = finite(F.col("delta").cast("double"))
    d = d.withColumns({"_range": F.max(finite(F.col("value"))).over(w) - F.min(finite(F.col("value"))).over(w), "_median": F.percentile(x, F.lit(0.5)).over(w)})
    d = d.withColumn("_mad", F.percentile(F.abs(x - F.col("_median")), F.lit(0.5)).over(w))
    flag = lambda limits: F.bool_or(above(F.abs("delta"), limit(F.col("_mad"), F.col("_range"), **limits)))
    return d.groupBy(EPISODE, FRAME).agg(flag(ordinary).alias("any_discontinuity"), flag(severe).alias("severe_discontinuity"))
