"""Summaries and robust statistics. Only finite numbers enter a statistic;
deviations are those of the population, percentiles are interpolated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import INFINITY, above, finite, is_finite, ratio, share, tally

_LEVELS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def summary(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, p05 .. p95 and max of a column; of nothing: count
    0 and nulls. One pass: the percentiles share one sort of the values."""
    x = finite(value.cast("double"))
    named = df.select(*by, x.alias("x"))
    p = F.percentile("x", F.array(*[F.lit(v) for v in _LEVELS.values()]))
    out = named.groupBy(*by).agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), p.alias("_p"))
    return out.select(*by, "count", "mean", "std", "min", "max", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(_LEVELS)])


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("length"))


def nonfinite_counts(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of a long table (value): elements, NaNs, infinities."""
    v = F.col("value")
    return long.groupBy(*by).agg(F.count("*").alias("n_elements"), tally(F.isnan(v)).alias("n_nan"), tally(F.abs(v) == INFINITY).alias("n_inf"))


def per_dim(long: DataFrame, by: Sequence[str] = ("dim",)) -> DataFrame:
    """count is of all values, the statistics of finite ones; a dimension is
    stuck if its deviation or its range is as good as none, or it has no number."""
    v = F.col("value")
    x = finite(v)
    out = long.groupBy(*by).agg(
        F.count("*").alias("count"), tally(F.isnan(v)).alias("n_nan"), tally(F.abs(v) == INFINITY).alias("n_inf"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, F.lit(0.5)).alias("median")
    )
    return out


def near_stuck(long: DataFrame, by: Sequence[str] = ("dim",), least_std: float = 1e-5, least_range: float = 1e-4) -> DataFrame:
    stats = per_dim(long, by)
    return stats.select(*by, "std", (F.col("max") - F.col("min")).alias("range"), F.coalesce((F.col("std") < least_std) | (F.col("max") - F.col("min") < least_range), F.lit(True)).alias("near_stuck"))


def median_and_mad(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """median and the median of absolute distances from it (0 of nothing).
    Two aggregations by the same keys; no window holds a group's rows."""
    named = df.select(*by, finite(value.cast("double")).alias("x"))
    med = named.groupBy(*by).agg(F.percentile("x", F.lit(0.5)).alias("median"))
    joined = named.join(med, list(by)) if by else named.crossJoin(med)
    return joined.groupBy(*by).agg(F.count("x").alias("count"), F.first("median").alias("median"), F.coalesce(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)), F.lit(0.0)).alias("mad"))


def robust_outliers(df: DataFrame, value: Column, by: Sequence[str], k: float = 6.0, floor: float = 1e-6) -> DataFrame:
    """Values further than k robust deviations from the median; the rate is over
    all elements, finite or not."""
    named = df.select(*by, value.cast("double").alias("x"))
    stats = median_and_mad(named, F.col("x"), by).select(*by, "median", "mad")
    z = F.abs(F.col("x") - F.col("median")) / (1.4826 * F.greatest(F.col("mad"), F.lit(floor)))
    joined = named.join(stats, list(by)) if by else named.crossJoin(stats)
    return joined.groupBy(*by).agg(F.count("*").alias("n"), tally(is_finite(F.col("x")) & above(z, k)).alias("n_outliers"), share(is_finite(F.col("x")) & above(z, k)).alias("rate"))


def boundary_saturation(df: DataFrame, value: Column, by: Sequence[str], eps: float = 0.01, most: float = 0.05) -> DataFrame:
    """Share of values within eps of the range from its ends."""
    named = df.select(*by, finite(value.cast("double")).alias("x")).filter("x is not null")
    ends = named.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    joined = named.join(ends, list(by)) if by else named.crossJoin(ends)
    near = eps * (F.col("high") - F.col("low"))
    out = joined.groupBy(*by).agg(F.first("low").alias("low"), F.first("high").alias("high"), share(F.col("x") <= F.col("low") + near).alias("share_low"), share(F.col("x") >= F.col("high") - near).alias("share_high"))
    return out.withColumn("saturated", (F.col("share_low") >= most) | (F.col("share_high") >= most))


def histogram(df: DataFrame, value: Column, bins: int = 40) -> DataFrame:
    """(bin, n) for every bin from the least value to the greatest; the last bin
    holds the greatest. A constant column's range is widened by half each way."""
    named = df.select(finite(value.cast("double")).alias("x")).filter("x is not null")
    ends = named.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("low"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("high"))
    # One row: the ends of the range.
    number = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    counts = named.crossJoin(F.broadcast(ends)).groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def modality(df: DataFrame, value: Column, bins: int = 40, least: float = 0.05, ends: float = 0.15) -> DataFrame:
    """One row: inner peaks of the histogram (above both neighbours and `least`
    of the highest bin), mass near the ends of the range, quantiles, bimodal."""
    hist = histogram(df, value, bins)
    w = Window.orderBy("bin")  # as many rows as bins
    marked = hist.select("bin", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"), F.max("n").over(Window.partitionBy()).alias("top"))
    peaks = marked.agg(tally((F.col("n") > F.col("before")) & (F.col("n") > F.col("after")) & (F.col("n") > least * F.col("top"))).alias("n_peaks"))
    named = df.select(finite(value.cast("double")).alias("x")).filter("x is not null")
    span = named.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    near = ends * (F.col("high") - F.col("low"))
    mass = named.crossJoin(F.broadcast(span)).agg(share(F.col("x") <= F.col("low") + near).alias("mass_low"), share(F.col("x") >= F.col("high") - near).alias("mass_high"), F.first("q").alias("q"))
    return peaks.crossJoin(mass).select("n_peaks", "mass_low", "mass_high", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q10", "q50", "q90"))], ((F.col("n_peaks") >= 2) | ((F.col("mass_low") > 0.15) & (F.col("mass_high") > 0.15))).alias("bimodal"))


def grip_dims(names: Sequence[str]) -> list[int]:
    return [i for i, n in enumerate(names) if "grip" in n.lower()]


def rate(n: Column, of: Column) -> Column:
    return ratio(n.cast("double"), of.cast("double"), 0.0)
