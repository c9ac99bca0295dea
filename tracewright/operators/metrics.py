"""Evaluation: binomial rates, classification, ranking, calibration, bootstrap.
Undefined values are NaN, as in numeric code; the queries turn them to null."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import NAN, ratio, tally
from ..model import EPISODE, FRAME
from .sequence import flicker, trigger_frames

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval within [0, 1]; NaN for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, d = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    # greatest and least skip nulls, so n = 0 is told apart first.
    return F.when(n.isNull(), F.lit(NAN)).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n.isNull(), F.lit(NAN)).otherwise(F.least(F.lit(1.0), centre + half))


def success_rates(df: DataFrame, success: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, n_success, rate, low, high)."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), tally(success).alias("n_success"))
    low, high = wilson(F.col("n_success"), F.col("n"))
    return out.select(*by, "n", "n_success", ratio(F.col("n_success").cast("double"), F.col("n"), NAN).alias("rate"), low.alias("low"), high.alias("high"))


def worst_slice(rates: DataFrame, by: str) -> DataFrame:
    """The slice of the lowest rate, of equals the first by name."""
    return rates.agg(F.min_by(F.struct(by, "n", "n_success", "rate"), F.struct("rate", by)).alias("w")).select("w.*")


def failure_taxonomy(df: DataFrame, labels: str) -> DataFrame:
    """(label, n, rate): of a column of label arrays; the rate is over episodes,
    those without labels included."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("rate"))


def _counts(y: Column, said: Column, weight: Column | None = None) -> dict[str, Column]:
    w = weight if weight is not None else F.lit(1)
    on = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    return {"tp": on((y == 1) & said), "tn": on((y == 0) & ~said), "fp": on((y == 0) & said), "fn": on((y == 1) & ~said)}


def derived(df: DataFrame) -> DataFrame:
    """Adds the usual rates to columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = ratio(tp, tp + fp, NAN), ratio(tp, tp + fn, NAN), ratio(tn, tn + fp, NAN)
    base = df.withColumns({"precision": precision, "recall": recall, "specificity": specificity, "accuracy": ratio(tp + tn, tp + tn + fp + fn, NAN)})
    p, r, s = F.col("precision"), F.col("recall"), F.col("specificity")
    some = ~F.isnan(p) & ~F.isnan(r)
    return base.withColumns({"f1": F.when(some & (p + r > 0), 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(NAN), "balanced_accuracy": (r + s) / 2})


def confusion(df: DataFrame, y: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    counts = _counts(F.col(y), F.col(score) >= threshold)
    return derived(df.groupBy(*by).agg(*[c.cast("long").alias(n) for n, c in counts.items()]))


def by_score(df: DataFrame, y: str, score: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg): the table that ranking metrics need, as long as
    there are different scores."""
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.coalesce(F.sum(F.when(F.col(y) == 1, w)), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(F.col(y) == 0, w)), F.lit(0)).alias("neg"))


def ranked(df: DataFrame, y: str, score: str, weight: Column | None = None) -> DataFrame:
    """by_score() with the sums of all lower scores (pos_below, neg_below) and of
    the table (pos_all, neg_all). Scores are put into ranges of about equal
    numbers of rows; sums run within a range, and only one row for each range
    meets the others, so no task sees more than its range of different scores."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = weight if weight is not None else F.lit(1)
    rows = df.select(F.col(score).cast("double").alias("score"), F.when(F.col(y) == 1, w).otherwise(0).alias("pos"), F.when(F.col(y) == 0, w).otherwise(0).alias("neg"))
    marks = rows.agg(F.percentile_approx("score", [k / n for k in range(1, n)], 20 * n).alias("_marks"))  # one row
    placed = rows.crossJoin(F.broadcast(marks)).withColumn("range", F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col("score"))), F.lit(0)))
    sums = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # As many rows as ranges.
    offsets = placed.groupBy("range").agg(*sums).select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")], *[F.sum(c).over(every).alias(f"{c}_all") for c in ("pos", "neg")])
    own = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    t = placed.groupBy("range", "score").agg(*sums).withColumns({f"{c}_own": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in ("pos", "neg")})
    return t.join(F.broadcast(offsets), "range").select("score", "pos", "neg", *[(F.col(f"{c}_before") + F.col(f"{c}_own")).alias(f"{c}_below") for c in ("pos", "neg")], "pos_all", "neg_all")


def roc_auc(df: DataFrame, y: str, score: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; NaN with one class. Rows
    are first summed by score, so the running sum is over different scores."""
    if by:
        w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        t = by_score(df, y, score, weight, by).withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    else:
        t = ranked(df, y, score, weight)
    out = t.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, ratio(F.col("u").cast("double"), (F.col("p") * F.col("n")).cast("double"), NAN).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, key: str) -> DataFrame:
    """Mean of precision at each positive, by falling score; ties by rising key.
    A row's rank is that of its score plus its place among equal scores."""
    higher = [(F.col(f"{c}_all") - F.col(f"{c}_below") - F.col(c)).alias(f"{c}_above") for c in ("pos", "neg")]
    scores = ranked(df, y, score).select("score", *higher)
    w = Window.partitionBy("score").orderBy("key")
    rows = df.select(F.col(y).alias("y"), F.col(score).cast("double").alias("score"), F.col(key).alias("key"))
    placed = rows.withColumns({"place": F.row_number().over(w), "own": F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(scores, "score")
    precision = (F.col("pos_above") + F.col("own")) / (F.col("pos_above") + F.col("neg_above") + F.col("place"))
    return placed.agg(F.sum(F.when(F.col("y") == 1, precision)).alias("s"), F.sum("y").alias("p")).select(ratio(F.col("s"), F.col("p").cast("double"), NAN).alias("average_precision"))


def _at_or_above(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, tp, fp, p, n) at each different score."""
    return ranked(df, y, score).select("score", (F.col("pos_all") - F.col("pos_below")).cast("double").alias("tp"), (F.col("neg_all") - F.col("neg_below")).cast("double").alias("fp"), F.col("pos_all").cast("double").alias("p"), F.col("neg_all").cast("double").alias("n"))


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, precision, recall) at each different score."""
    return _at_or_above(df, y, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ratio(F.col("tp"), F.col("p"), NAN).alias("recall"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at each different score."""
    return _at_or_above(df, y, score).select("score", ratio(F.col("tp"), F.col("p"), NAN).alias("tpr"), ratio(F.col("fp"), F.col("n"), NAN).alias("fpr"))


def brier(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))


def calibration_bins(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, mean_y): equal bins of [0, 1], the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("mean_y"))


def calibration_error(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    t = calibration_bins(df, y, score, bins)
    return t.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def grid(low: float = 0.05, high: float = 0.95, n: int = 37) -> list[float]:
    return [float(x) for x in np.linspace(low, high, n)]


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float] | None = None) -> DataFrame:
    """confusion() at each threshold of a grid. Each row is put into the grid's
    step it reaches and summed there; the grid's running sums give the counts,
    so the data are read once and not multiplied."""
    ts = sorted(thresholds or grid())
    step = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts), F.lit(0))
    counts = df.groupBy(step.alias("step")).agg(tally(F.col(y) == 1).alias("pos"), tally(F.col(y) == 0).alias("neg"))
    table = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "at int, threshold double")
    total = counts.crossJoin(F.broadcast(table)).groupBy("at", "threshold")
    said = F.col("step") >= F.col("at")
    out = total.agg(*[F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias(m) for m, n, c in (("tp", "pos", said), ("tn", "neg", ~said), ("fp", "neg", said), ("fn", "pos", ~said))])
    return derived(out.drop("at"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The row of the highest metric; of equals the lowest threshold. NaN loses."""
    value = F.when(F.isnan(metric), F.lit(float("-inf"))).otherwise(F.col(metric))
    return sweep.agg(F.max_by(F.struct("threshold", metric), F.struct(value, -F.col("threshold"))).alias("b")).select("b.*")


def bootstrap_draws(groups: Sequence[int], resamples: int = 1000, seed: int = 0) -> list[tuple[int, int, int]]:
    """(resample, group, times): groups drawn with replacement. A small table,
    drawn on the driver so that it doesn't depend on how rows are partitioned."""
    g = np.asarray(sorted(groups))
    rng = np.random.default_rng(seed)
    out = []
    for r in range(resamples):
        who, times = np.unique(rng.choice(g, size=len(g), replace=True), return_counts=True)
        out += [(r, int(a), int(b)) for a, b in zip(who, times, strict=True)]
    return out


def bootstrap_interval(df: DataFrame, draws: DataFrame, group: str, value: Column, level: float = 0.95) -> DataFrame:
    """One row: mean of a value, and the percentile interval of its mean over
    resampled groups. Rows are summed by group before they meet the draws."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    means = draws.join(sums, group).groupBy("resample").agg(F.sum(F.col("times") * F.col("s")).alias("s"), F.sum(F.col("times") * F.col("n")).alias("n")).select((F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    p = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    point = sums.agg((F.sum("s") / F.sum("n")).alias("point"))
    return point.crossJoin(means.filter("m is not null").agg(F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"), F.count("*").alias("n_resamples")))


def bootstrap_auc(df: DataFrame, draws: DataFrame, group: str, y: str, score: str, level: float = 0.95) -> DataFrame:
    """The same for the area under the ROC curve, from (group, score) counts."""
    t = df.groupBy(group, score).agg(tally(F.col(y) == 1).alias("p1"), tally(F.col(y) == 0).alias("n1"))
    long = draws.join(t, group).select("resample", "times", score, F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("p1").alias("c")), F.struct(F.lit(0).alias("y"), F.col("n1").alias("c")))).alias("e")).select("resample", score, "e.y", (F.col("times") * F.col("e.c")).alias("c"))
    each = roc_auc(long, "y", score, F.col("c"), ["resample"]).filter(~F.isnan("roc_auc"))
    tail = (1 - level) / 2
    p = F.percentile("roc_auc", F.array(F.lit(tail), F.lit(1 - tail)))
    return each.agg(F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"), F.count("*").alias("n_resamples"))


def classification_report(df: DataFrame, y: str, score: str, key: str, threshold: float = 0.5) -> DataFrame:
    """One row: confusion, rates, ranking and calibration together."""
    out = df.agg(F.count("*").alias("n"), F.avg(y).alias("prevalence"))
    for part in (confusion(df, y, score, threshold), roc_auc(df, y, score), average_precision(df, y, score, key), brier(df, y, score), calibration_error(df, y, score)):
        out = out.crossJoin(part)
    return out


def majority_baseline(train: DataFrame, y: str) -> DataFrame:
    """(majority): the commoner label, 1 of equals."""
    return train.agg(F.when(F.avg(y) >= 0.5, 1).otherwise(0).alias("majority"))


def temporal_evaluation(frames: DataFrame, score: str, threshold: float, terminal: float = 0.85, votes: int = 4, of: int = 5) -> DataFrame:
    """Per episode: trigger frame, whether it is before the terminal part, in
    it, its latency from the beginning of that part, mean and deviation of the
    score, and flicker."""
    first = trigger_frames(frames, score, threshold, votes, of)
    stats = frames.groupBy(EPISODE).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    start = F.floor(terminal * F.col("n"))
    joined = stats.join(first, EPISODE).join(flicker(frames, score, threshold), EPISODE)
    t = F.col("trigger_frame")
    return joined.select(EPISODE, "n", "trigger_frame", F.coalesce(t < start, F.lit(False)).alias("early"), F.coalesce(t >= start, F.lit(False)).alias("in_terminal"), (t - start).alias("latency"), "mean_score", "std_score", "n_flicker")


def temporal_rollup(episodes: DataFrame) -> DataFrame:
    found = F.col("trigger_frame").isNotNull()
    return episodes.agg(F.count("*").alias("n_episodes"), (tally(found) / F.count("*")).alias("detected"), (tally(F.col("early")) / F.count("*")).alias("early"), (tally(F.col("in_terminal")) / F.count("*")).alias("in_terminal"), F.percentile("latency", F.lit(0.5)).alias("median_latency"), F.avg("n_flicker").alias("mean_flicker"))


def temporal_search(frames: DataFrame, score: str, thresholds: Sequence[float], terminal: float = 0.85) -> DataFrame:
    """The threshold of the least early share, then of the most detections, then
    the lowest. Each threshold's trigger is one more column over one window."""
    from .sequence import trigger

    named = frames.select(EPISODE, FRAME, score, *[trigger(F.col(score), t).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    per = named.groupBy(EPISODE).agg(F.count("*").alias("n"), *[F.min(F.when(F.col(f"_t{i}"), F.col(FRAME))).alias(f"_f{i}") for i in range(len(thresholds))])
    entries = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_f{i}").alias("f")) for i, t in enumerate(thresholds)])
    long = per.select("n", F.explode(entries).alias("e")).groupBy("e.threshold").agg((tally(F.col("e.f") < F.floor(terminal * F.col("n"))) / F.count("*")).alias("early"), (F.count("e.f") / F.count("*")).alias("detected"))
    return long.agg(F.min_by(F.struct("threshold", "early", "detected"), F.struct("early", -F.col("detected"), "threshold")).alias("b")).select("b.*")


