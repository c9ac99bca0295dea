"""Evaluation queries: rates, classification, ranking, temporal detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EPISODE, FRAME
from ..operators import metrics, ml, sequence, splits
from .catalogue import SCORED, TRAJ, W, events, query, read, scored

_Z = metrics.Z95
_RATE = f"round((p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS low, round((p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) AS high"
_BY = "r AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p FROM orders GROUP BY o_orderpriority)"


def _rates(spark, d):
    return metrics.success_rates(read(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderpriority"])


@query(f"WITH r AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p FROM orders) SELECT n, k AS n_success, round(p, 6) AS rate, {_RATE} FROM r")
def success_rate_wilson(spark, d):
    return metrics.success_rates(read(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query(f"WITH {_BY} SELECT o_orderpriority, n, k AS n_success, round(p, 6) AS rate, {_RATE} FROM r")
def success_by_slice(spark, d):
    return _rates(spark, d)


@query(f"WITH {_BY} SELECT o_orderpriority, n, k AS n_success, round(p, 6) AS rate FROM r ORDER BY p, o_orderpriority LIMIT 1")
def worst_slice(spark, d):
    return metrics.worst_slice(_rates(spark, d), "o_orderpriority")


@query("WITH f AS (SELECT unnest(list_distinct(list_filter([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_quantity < 5 THEN 'small' END], lambda x: x IS NOT NULL))) AS label FROM lineitem) SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS rate FROM f GROUP BY label")
def failure_taxonomy(spark, d):
    on = lambda c, name: F.when(c, F.lit(name))
    rows = read(spark, d, "lineitem").select(F.array_compact(F.array(on(F.col("l_returnflag") == "R", "returned"), on(F.col("l_discount") > 0.08, "discounted"), on(F.col("l_quantity") < 5, "small"))).alias("labels"))
    return metrics.failure_taxonomy(rows, "labels")


_CONF = "count(*) FILTER (y = 1 AND score >= {0}) AS tp, count(*) FILTER (y = 0 AND score < {0}) AS tn, count(*) FILTER (y = 0 AND score >= {0}) AS fp, count(*) FILTER (y = 1 AND score < {0}) AS fn"
_DERIVED = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0) + CASE WHEN tp = 0 THEN NULL ELSE 0 END, 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy"


@query(f"WITH {SCORED}, c AS (SELECT source, {_CONF.format(0.5)} FROM scored GROUP BY source) SELECT source, tp, tn, fp, fn, {_DERIVED} FROM c")
def confusion_prf(spark, d):
    return metrics.confusion(scored(spark, d), "y", "score", 0.5, ["source"])


_AUC = "auc AS (SELECT (sum(CASE WHEN y = 1 THEN rk END) - p * (p + 1) / 2) / (p * q) AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored), (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM scored) GROUP BY p, q)"
_AP = "ap AS (SELECT sum(CASE WHEN y = 1 THEN hits / rn END) / sum(y) AS average_precision FROM (SELECT y, row_number() OVER w AS rn, sum(y) OVER w AS hits FROM scored WINDOW w AS (ORDER BY score DESC, doc_id)))"
_BINS = "bins AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS mean_y FROM scored GROUP BY 1)"


@query(f"WITH {SCORED}, {_AUC} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d), "y", "score")


@query(f"WITH {SCORED}, {_AP} SELECT round(average_precision, 6) AS average_precision FROM ap")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), "y", "score", "doc_id")


@query(f"WITH {SCORED}, {_BINS} SELECT bin, n, round(mean_score, 6) AS mean_score, round(mean_y, 6) AS mean_y FROM bins")
def calibration_bins(spark, d):
    return metrics.calibration_bins(scored(spark, d), "y", "score")


@query(f"WITH {SCORED}, {_BINS} SELECT (SELECT round(avg((score - y) ** 2), 6) FROM scored) AS brier, round(sum(n * abs(mean_score - mean_y)) / sum(n), 6) AS ece FROM bins")
def brier_ece(spark, d):
    x = scored(spark, d)
    return metrics.brier(x, "y", "score").crossJoin(metrics.calibration_error(x, "y", "score"))


_VALUES = "grid AS (SELECT unnest([" + ", ".join(repr(t) for t in metrics.grid()) + "]::DOUBLE[]) AS g)"
_SWEEP = f"{_VALUES}, c AS (SELECT g AS threshold, {_CONF.format('g')} FROM scored, grid GROUP BY g)"


@query(f"WITH {SCORED}, {_SWEEP} SELECT round(threshold, 6) AS threshold, tp, tn, fp, fn, {_DERIVED} FROM c")
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(scored(spark, d), "y", "score")


@query(f"WITH {SCORED}, {_SWEEP} SELECT round(threshold, 6) AS threshold, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c ORDER BY (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 DESC NULLS LAST, threshold LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(metrics.threshold_sweep(scored(spark, d), "y", "score"), "balanced_accuracy")


_CURVE = "s AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM scored GROUP BY score), u AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM s WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {SCORED}, {_CURVE} SELECT round(score, 6) AS score, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM u")
def pr_curve(spark, d):
    return metrics.precision_recall_curve(scored(spark, d), "y", "score")


@query(f"WITH {SCORED}, {_CURVE} SELECT round(score, 6) AS score, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr FROM u")
def roc_curve(spark, d):
    return metrics.roc_curve(scored(spark, d), "y", "score")


@query(f"WITH {SCORED}, {_AUC}, {_AP}, {_BINS}, c AS (SELECT count(*) AS n, avg(y) AS prevalence, avg((score - y) ** 2) AS brier, {_CONF.format(0.5)} FROM scored) SELECT n, round(prevalence, 6) AS prevalence, tp, tn, fp, fn, {_DERIVED}, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier, (SELECT round(sum(n * abs(mean_score - mean_y)) / sum(n), 6) FROM bins) AS ece FROM c, auc, ap")
def classification_report(spark, d):
    return metrics.classification_report(scored(spark, d), "y", "score", "doc_id")


@query(f"WITH {SCORED} SELECT CAST(CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS majority FROM scored")
def majority_baseline(spark, d):
    return metrics.majority_baseline(scored(spark, d), "y")


_DRAWS = metrics.bootstrap_draws(range(20), 50, 7)
_DRAWN = "draws(resample, source, times) AS (VALUES " + ", ".join(f"({r}, 'src{g}', {t})" for r, g, t in _DRAWS) + ")"


def _draws(spark):
    return spark.createDataFrame([(r, f"src{g}", t) for r, g, t in _DRAWS], "resample int, source string, times int")


@query(f"WITH {SCORED}, {_DRAWN}, s AS (SELECT source, sum(y) AS s, count(*) AS n FROM scored GROUP BY source), m AS (SELECT resample, sum(times * s) / sum(times * n) AS m FROM draws JOIN s USING (source) GROUP BY resample) SELECT (SELECT round(sum(s) / sum(n), 6) FROM s) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS n_resamples FROM m")
def bootstrap_ci(spark, d):
    return metrics.bootstrap_interval(scored(spark, d), _draws(spark), "source", F.col("y"))


@query(
    f"""WITH {SCORED}, {_DRAWN}, w AS (SELECT resample, score, y, sum(times) AS c FROM scored JOIN draws USING (source) GROUP BY ALL), b AS (SELECT resample, score, coalesce(sum(c) FILTER (y = 1), 0) AS p, coalesce(sum(c) FILTER (y = 0), 0) AS q FROM w GROUP BY resample, score),
u AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY resample ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), a AS (SELECT sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM u GROUP BY resample)
SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(*) AS n_resamples FROM a WHERE auc IS NOT NULL"""
)
def bootstrap_auc(spark, d):
    return metrics.bootstrap_auc(scored(spark, d), _draws(spark), "source", "y", "score")


_FIRE = f"{TRAJ}, h AS (SELECT *, sum(CASE WHEN v >= 45 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hits, CASE WHEN (v >= 45) <> (lag(v) OVER ({W}) >= 45) THEN 1 ELSE 0 END AS flip FROM traj), fire AS (SELECT episode_index, min(CASE WHEN hits >= 4 AND frame_index >= 4 THEN frame_index END) AS f, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, sum(flip) AS fl FROM h GROUP BY episode_index)"
_EVAL = "e AS (SELECT episode_index, n, f AS trigger_frame, coalesce(f < floor(0.85 * n), false) AS early, coalesce(f >= floor(0.85 * n), false) AS in_terminal, CAST(f - floor(0.85 * n) AS BIGINT) AS latency, m, s, CAST(fl AS BIGINT) AS n_flicker FROM fire)"


@query(f"WITH {_FIRE} SELECT episode_index, f AS trigger_frame FROM fire")
def hysteresis_trigger(spark, d):
    return sequence.trigger_frames(events(spark, d), "v", 45.0)


@query(f"WITH {_FIRE} SELECT episode_index, CAST(fl AS BIGINT) AS n_flicker FROM fire")
def flicker(spark, d):
    return sequence.flicker(events(spark, d), "v", 45.0)


@query(f"WITH {_FIRE}, {_EVAL} SELECT episode_index, n, trigger_frame, early, in_terminal, latency, round(m, 6) AS mean_score, round(s, 6) AS std_score, n_flicker FROM e")
def temporal_eval(spark, d):
    return metrics.temporal_evaluation(events(spark, d), "v", 45.0)


@query(f"WITH {_FIRE}, {_EVAL} SELECT count(*) AS n_episodes, round(count(trigger_frame) / count(*), 6) AS detected, round(count(*) FILTER (early) / count(*), 6) AS early, round(count(*) FILTER (in_terminal) / count(*), 6) AS in_terminal, round(median(latency), 6) AS median_latency, round(avg(n_flicker), 6) AS mean_flicker FROM e")
def temporal_rollup(spark, d):
    return metrics.temporal_rollup(metrics.temporal_evaluation(events(spark, d), "v", 45.0))


@query(
    f"""WITH {TRAJ}, g AS (SELECT unnest([5.0, 10.0, 15.0, 20.0]::DOUBLE[]) AS g), h AS (SELECT g, episode_index, frame_index, sum(CASE WHEN v >= g THEN 1 ELSE 0 END) OVER (PARTITION BY g, episode_index ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hits FROM traj, g), f AS (SELECT g, episode_index, count(*) AS n, min(CASE WHEN hits >= 4 AND frame_index >= 4 THEN frame_index END) AS f FROM h GROUP BY g, episode_index),
o AS (SELECT g, count(*) FILTER (f < floor(0.85 * n)) / count(*) AS early, count(f) / count(*) AS detected FROM f GROUP BY g) SELECT g AS threshold, round(early, 6) AS early, round(detected, 6) AS detected FROM o ORDER BY o.early, o.detected DESC, g LIMIT 1"""
)
def temporal_search(spark, d):
    return metrics.temporal_search(events(spark, d), "v", [5.0, 10.0, 15.0, 20.0])


_SPLIT = splits.split_of(range(10), (0.7, 0.1), 42)
_SIDES = "sides(episode_index, split) AS (VALUES " + ", ".join(f"({e}, '{s}')" for s, es in _SPLIT.items() for e in es) + ")"


@query(f"WITH {_SIDES} SELECT split, count(*) AS n_frames, count(DISTINCT label) AS n_episodes FROM embeddings JOIN sides ON label = episode_index GROUP BY split")
def split_join(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("label").cast("long").alias(EPISODE), F.col("vec_id").alias(FRAME))
    return splits.with_split(rows, splits.split_table(spark, _SPLIT)).groupBy("split").agg(F.count("*").alias("n_frames"), F.count_distinct(EPISODE).alias("n_episodes"))


@query(f"WITH {_SIDES}, twice AS (SELECT * FROM sides UNION ALL SELECT DISTINCT user_id % 10, 'val' FROM events WHERE user_id % 3 = 0) SELECT count(*) AS n_leaking FROM (SELECT episode_index FROM twice GROUP BY episode_index HAVING count(DISTINCT split) > 1)")
def split_leakage(spark, d):
    """Of a split to which episodes are added on a second side."""
    added = events(spark, d).filter(F.col(EPISODE) % 3 == 0).select((F.col(EPISODE) % 10).alias(EPISODE), F.lit("val").alias("split")).distinct()
    return splits.leakage(splits.split_table(spark, _SPLIT).unionByName(added)).agg(F.count("*").alias("n_leaking"))


@query()
def logistic_baseline(spark, d):
    """Coefficients and probabilities of the linear baseline (rows only)."""
    rows = scored(spark, d).withColumn("f", F.array(F.col("score") - 0.5, F.pmod(F.col("doc_id"), F.lit(7)) / 7.0))
    model = ml.fit_logistic(rows, "f", "y")
    return ml.probabilities(model, rows, "f").select("doc_id", "y", "prob")
