"""Operators on small tables with NaN, infinities, gaps, repeats and short
episodes, against definitions written out in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar, vectors
from tracewright.functions.paths import HIDDEN, portable, portable_text, portable_tree
from tracewright.model import EPISODE, FRAME
from tracewright.operators import alignment, curation, discontinuity, export, metrics, ml, protocol, sequence, splits, summary
from tracewright.config import Curation, EpisodeRules, filled, fingerprint

NAN, INF = float("nan"), float("inf")


def episodes(spark, *series, start=0, dt=0.1):
    rows = [(e, f + start, f * dt, float(x)) for e, xs in enumerate(series) for f, x in enumerate(xs)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, x double")


def test_nan_guards(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.is_finite(F.col("x"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(scalar.above(F.col("x"), 0.5)).collect()] == [True, False, True, False, False]
    s = summary.summary(df, F.col("x")).first()
    assert s["count"] == 1 and s["max"] == 1.0
    assert summary.summary(df.filter("false"), F.col("x")).first()["count"] == 0
    assert [r[0] for r in spark.range(1).select(scalar.half_even(F.lit(2.5)), scalar.ratio(F.lit(0.0), F.lit(0), 7.0)).collect()] == [2.0]


def test_discontinuities_and_infinity(spark):
    df = episodes(spark, [0, 0.1, NAN, 50, INF, 1])
    d = discontinuity.element_deltas(df, F.array("x"))
    flags = discontinuity.element_flags(d, discontinuity.thresholds(d, k=8.0, least=1.0))
    assert flags.filter("flag").count() == 0
    assert sorted(r[FRAME] for r in flags.filter("flag_any").collect()) == [4, 5]


def test_mad_and_outliers(spark):
    r = np.random.default_rng(1)
    xs = [r.normal(size=60), np.append(r.normal(size=20), [50, NAN])]
    got = {x[EPISODE]: x for x in summary.median_and_mad(episodes(spark, *xs), F.col("x"), [EPISODE]).collect()}
    for e, x in enumerate(xs):
        x = x[np.isfinite(x)]
        assert math.isclose(got[e]["mad"], np.median(np.abs(x - np.median(x))))
    out = {x[EPISODE]: x for x in summary.robust_outliers(episodes(spark, *xs), F.col("x"), [EPISODE], 6.0).collect()}
    assert out[1]["n_outliers"] == 1 and math.isclose(out[1]["rate"], 1 / 22)


def test_histogram_ends(spark):
    df = episodes(spark, [0, 1, 2, 3, 4])
    assert [r["n"] for r in summary.histogram(df, F.col("x"), 4).orderBy("bin").collect()] == [1, 1, 1, 2]
    assert sum(r["n"] for r in summary.histogram(episodes(spark, [2, 2, 2]), F.col("x"), 40).collect()) == 3
    assert summary.modality(episodes(spark, [0.0] * 50 + [1.0] * 50 + [0.5]), F.col("x")).first()["bimodal"]


def test_alignment(spark):
    rows = [(0, 0, 0.0), (0, 1, 0.1), (0, 2, 0.1), (0, 4, 0.5), (1, 0, 0.0), (1, 1, -1.0), (2, 0, 3.0)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double")
    got = {r[EPISODE]: r for r in alignment.episode_alignment(df, fps=10).collect()}
    assert (got[0].n_duplicate_timestamps, got[0].n_timestamp_gaps, got[0].n_frame_gaps) == (1, 1, 1)
    assert got[1].non_monotonic and not got[0].non_monotonic and got[2].n_frames == 1
    assert [round(x, 6) for x in got[0].gap_sizes] == [0.4]


def test_episode_rules(spark):
    base = [(e, f, f * 0.1, [float(f)], [float(f)]) for e in range(4) for f in range(70)]
    rows = [r for r in base if not (r[0] == 1 and r[1] == 9)]
    rows = [(e, f, t, [NAN] if (e, f) == (2, 5) else s, [None] if (e, f) == (3, 5) else a) for e, f, t, s, a in rows] + [(9, f, f * 0.1, [0.0], [0.0]) for f in range(10)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, state array<double>, action array<double>")
    got = {r[EPISODE]: r.reasons for r in curation.episode_validation(df, EpisodeRules(fps=10.0)).collect()}
    assert got[0] == [] and got[1] == ["frame_index_discontinuity"] and got[2] == ["state_nan_inf"] and got[3] == ["action_nan_inf"]
    assert got[9] == ["too_short_min_episode_frames", "too_few_frames_for_horizon"]


def test_runs_against_a_loop(spark):
    r = np.random.default_rng(2)
    xs = [(r.random(n) < 0.6).astype(float) for n in (1, 7, 40, 90)]
    df = episodes(spark, *xs).withColumn("flag", F.col("x") > 0)
    got = {(x[EPISODE], x[FRAME]): x.sustained for x in sequence.sustained(df, "flag", 3).collect()}
    lengths = []
    for e, x in enumerate(xs):
        edges = np.flatnonzero(np.diff(np.r_[0, x, 0]))
        runs = list(zip(edges[::2], edges[1::2], strict=True))
        lengths += [b - a for a, b in runs]
        want = np.zeros(len(x), bool)
        for a, b in runs:
            want[a:b] = b - a >= 3
        assert [got[e, f] for f in range(len(x))] == want.tolist()
    s = sequence.run_lengths(df, "flag").first()
    assert (s.n_runs, s.max_run, s.n_single) == (len(lengths), max(lengths), lengths.count(1))


def windows_by_hand(frames, ok, ts, h, stride):
    out = []
    for i in range(0, len(frames) - h + 1, stride):
        f, t = frames[i : i + h], ts[i : i + h]
        if all(ok[i : i + h]) and all(b == a + 1 for a, b in zip(f, f[1:], strict=False)) and all(b > a for a, b in zip(t, t[1:], strict=False)):
            out.append(f[0])
    return out


@pytest.mark.parametrize(("h", "stride"), [(1, 1), (3, 1), (4, 2)])
def test_windows_against_a_loop(spark, h, stride):
    r = np.random.default_rng(h)
    rows, want = [], set()
    for e in range(12):
        frames = np.cumsum(r.choice([1, 1, 1, 1, 2], 25)).tolist()
        ts = np.cumsum(r.choice([0.1, 0.1, 0.1, 0.0, NAN], 25, p=[0.4, 0.3, 0.2, 0.08, 0.02])).tolist()
        ok = (r.random(25) < 0.9).tolist()
        rows += [(e, f, t, o) for f, t, o in zip(frames, ts, ok, strict=True)]
        want |= {(e, s) for s in windows_by_hand(frames, ok, ts, h, stride)}
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, ok boolean")
    w = sequence.training_windows(df, h, stride, F.col("ok"))
    assert {(x[EPISODE], x.start_frame) for x in w.collect()} == want
    covered = {(x[EPISODE], x[FRAME]) for x in sequence.covered(df, w).collect()}
    assert covered == {(e, s + i) for e, s in want for i in range(h)}


def test_smoothing_against_least_squares(spark):
    r = np.random.default_rng(5)
    xs = [r.normal(size=n).cumsum() for n in (1, 2, 3, 4, 5, 6, 30)]
    got = {(x[EPISODE], x[FRAME]): x.smoothed for x in sequence.smoothed(episodes(spark, *xs), "x", 5, 2, INF).collect()}
    for e, x in enumerate(xs):
        size = min(5, len(x) if len(x) % 2 else len(x) - 1)
        want = x.copy()
        if size >= 4:
            half, h = size // 2, sequence.hat_matrix(size, 2)
            for i in range(len(x)):
                a = min(max(i - half, 0), len(x) - size)
                want[i] = h[i - a] @ x[a : a + size]
        assert np.allclose([got[e, f] for f in range(len(x))], want)
    assert np.allclose(sequence.hat_matrix(5, 2) * 35, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]])


def test_hysteresis_against_a_loop(spark):
    r = np.random.default_rng(6)
    xs = [r.random(n) for n in (3, 5, 20, 60)]
    got = {x[EPISODE]: x.trigger_frame for x in sequence.trigger_frames(episodes(spark, *xs), "x", 0.4).collect()}
    for e, x in enumerate(xs):
        hit = [i for i in range(4, len(x)) if (x[i - 4 : i + 1] >= 0.4).sum() >= 4]
        assert got[e] == (hit[0] if hit else None)


def test_interpolation_and_labels(spark):
    x = np.arange(23) ** 1.5
    df = episodes(spark, x).withColumn("s", F.when(sequence.every_kth(5), F.col("x")))
    got = [r.interpolated for r in sequence.interpolated(df, "s").orderBy(FRAME).collect()]
    at = [0, 5, 10, 15, 20, 22]
    assert np.allclose(got, np.interp(np.arange(23), at, x[at]))
    labels = sequence.proxy_labels(episodes(spark, np.zeros(100), np.zeros(7))).orderBy(FRAME).collect()
    assert [(r[FRAME], r.label) for r in labels] == [(0, 0), (13, 0), (26, 0), (39, 0), (85, 1), (89, 1), (94, 1), (99, 1)]


def test_plans():
    assert sequence.stratified(50, 5, np.random.default_rng(0)) == [0, 12, 24, 37, 49]
    plan = sequence.sampling_plan({0: 8, 1: 100}, 3, 16, 0)
    assert [p for p in plan if p[0] == 0] == [(0, 0, 8)] * 3
    assert all(0 <= a < b <= 100 for _, a, b in plan) and plan == sequence.sampling_plan({0: 8, 1: 100}, 3, 16, 0)
    assert sum(b - a for _, a, b in sequence.sampling_plan({1: 1000}, 3, 16, 900)) >= 900


def test_splits(spark):
    s = splits.split_of(range(50), (0.7, 0.1), 42)
    assert [len(s[k]) for k in ("train", "val", "test")] == [35, 5, 10]
    assert s["train"][:5] == [5, 25, 20, 49, 39] and s["val"] == [6, 11, 22, 19, 35] and sorted(s["test"]) == [0, 1, 2, 8, 12, 13, 14, 33, 36, 48]
    assert splits.split_of(range(50))["val"] == [0, 12, 14, 48, 2]
    with pytest.raises(ValueError):
        splits.split_of([1, 2])
    bad = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "episode_index long, split string")
    assert [r[EPISODE] for r in splits.leakage(bad).collect()] == [1]


def test_metrics_by_hand(spark):
    low, high = spark.range(1).select(*metrics.wilson(F.lit(80), F.lit(100))).first()
    assert round(low, 5) == 0.71117 and round(high, 5) == 0.86663
    assert math.isnan(spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0))[0]).first()[0])
    y, s = [1, 0, 1, 1, 0], [0.9, 0.9, 0.5, 0.2, 0.1]
    df = spark.createDataFrame(list(zip(range(5), y, s, strict=True)), "k long, y int, s double")
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, u in zip(s, y, strict=True) if u for b, v in zip(s, y, strict=True) if not v])
    assert math.isclose(metrics.roc_auc(df, "y", "s").first()[0], auc)
    assert math.isclose(metrics.average_precision(df, "y", "s", "k").first()[0], (1 + 2 / 3 + 3 / 4) / 3)
    c = metrics.confusion(df, "y", "s", 0.5).first()
    assert (c.tp, c.tn, c.fp, c.fn) == (2, 1, 1, 1) and math.isclose(c.f1, 2 / 3)
    assert math.isnan(metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0])
    assert math.isnan(metrics.confusion(df.filter("y = 0"), "y", "s", 0.95).first().precision)
    assert metrics.bootstrap_draws(range(5), 3, 1) == metrics.bootstrap_draws(range(5), 3, 1)


def test_logistic_optimum(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 2))
    y = (x[:, 0] + r.normal(size=80) > 0.4).astype(int)
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y, strict=True)], "f array<double>, y int")
    w = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (1 - y).sum()))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x / 80 + np.eye(2) / 80, x.T @ (w * (p - y)) / 80 + theta / 80)
    assert np.allclose(ml.fit_logistic(df, "f", "y").coefficients.toArray(), theta, atol=1e-4)


def test_normaliser(spark):
    df = spark.createDataFrame([([float(i), 5.0],) for i in range(101)], "a array<double>")
    n = export.fit(df, F.col("a"), 3)
    assert n.low == (1.0, 5.0) and n.high == (99.0, 6.0) and export.Normaliser.from_dict(n.to_dict()) == n
    e = df.select(n.encode(F.col("a")).alias("e"), n.mask().alias("m")).collect()
    assert all(len(r.e) == 3 and r.e[2] == 0 and r.m == [1.0, 1.0, 0.0] for r in e) and e[0].e[0] == -1 and e[100].e[0] == 1
    assert export.round_trip(df, F.col("a"), n).first().max_abs_error <= 1.0 + 1e-6
    assert export.manifest_errors({"split": 1}) and export.manifest_errors({k: 1 for k in "action_statistics_path curation_policy dataset_repo_id dataset_revision n_examples split".split()}) == []


def test_delta_actions(spark):
    rows = [(0, 0, [1.0, 9.0]), (0, 1, [3.0, 8.0]), (0, 3, [7.0, 7.0]), (1, 4, [2.0, 6.0])]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, a array<double>")
    got = [r.d for r in df.select(EPISODE, FRAME, sequence.delta_actions(F.col("a"), 1).alias("d")).orderBy(EPISODE, FRAME).collect()]
    assert got == [[0.0, 9.0], [2.0, 8.0], [0.0, 7.0], [0.0, 6.0]]
    assert df.select(vectors.pad(F.col("a"), 4)).first()[0] == [1.0, 9.0, 0.0, 0.0]


def test_protocol(spark):
    m = protocol.rollout_matrix(spark)
    assert m.count() == 100 and m.agg(F.count_distinct("seed")).first()[0] == 100 and protocol.paired_templates(spark).count() == 36
    docs = m.select(F.to_json(F.struct(*m.columns)).alias("doc"))
    assert protocol.protocol_violations(docs, 36).count() == 0
    assert [r.code for r in protocol.protocol_violations(docs, 0).collect()] == ["paired_comparisons"]
    good = {k: "x" for k in protocol.RESULT_FIELDS}
    import json

    bad = good | {"ground_truth_success_source": protocol.UNDER_TEST, "policy_inputs": {"simulator_success": 1}}
    bad.pop("seed")
    found = protocol.result_violations(spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(bad))], "record long, doc string")).collect()
    assert sorted((r.record, r.code) for r in found) == [(1, "invalid_gt_source"), (1, "missing_required_field"), (1, "simulator_gt_leakage")]


PATHS = [
    ("https://x.org/a", "https://x.org/a"), ("owner/name", "owner/name"), ("data/x.json", "data/x.json"), ("/repo/configs/a.yaml", "configs/a.yaml"), ("/home/me/.cache/huggingface/hub/models--a/b", "<HF_HOME>/hub/models--a/b"),
    ("/Users/me/work/configs/a.yaml", "configs/a.yaml"), ("/home/me/some/dir/file.txt", "dir/file.txt"), ("/home/me/file.txt", HIDDEN), ("/root", HIDDEN), ("C:\\Users\\me\\proj\\data\\x", "data/x"), ("/mnt/x", HIDDEN), ("D:\\x", HIDDEN), ("a\\b", "a/b"), ("", ""),
]


def test_paths(spark):
    df = spark.createDataFrame(PATHS, "p string, want string")
    for r in df.select("p", "want", portable(F.col("p"), "/repo").alias("got")).collect():
        assert r.got == r.want == portable_text(r.p, "/repo"), r
    assert portable_tree({"a": ["/home/me/x/y", "plain text / here", 1]}, "/repo") == {"a": ["x/y", "plain text / here", 1]}


def test_config():
    assert fingerprint({"b": 1, "a": 2}) == fingerprint({"a": 2, "b": 1}) != fingerprint({"a": 2, "b": 2})
    assert filled(Curation, {"horizon": 8, "episode": {"min_frames": 3}}).episode.min_frames == 3
    with pytest.raises(ValueError):
        filled(Curation, {"nonsense": 1})


def test_two_wide_vectors_do_not_mix(spark):
    """Element 1,000 of the first vector and element 0 of the second are told apart."""
    rows = [(0, f, [0.0] * 1000 + [10.0 * f], [0.5 * (f >= 5)]) for f in range(8)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, a array<double>, b array<double>")
    limits = {"k": 1.0, "range_share": 0.25}
    got = discontinuity.timestep_flags(df, {"a": F.col("a"), "b": F.col("b")}, limits, limits).filter("severe_discontinuity").collect()
    assert [r.frame_index for r in got] == [5]


def test_ranking_with_ties_against_a_loop(spark):
    r = np.random.default_rng(8)
    y, s = (r.random(300) < 0.4).astype(int), np.round(r.random(300), 2)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "id long, y int, s double").repartition(5)
    order = sorted(range(300), key=lambda i: (-s[i], i))
    hits = np.cumsum(y[order])
    want = float(np.mean([hits[k] / (k + 1) for k, i in enumerate(order) if y[i]]))
    assert abs(metrics.average_precision(df, "y", "s", "id").first()[0] - want) < 1e-9
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert abs(metrics.roc_auc(df, "y", "s").first()[0] - auc) < 1e-9
    curve = {x["score"]: (x["precision"], x["recall"]) for x in metrics.precision_recall_curve(df, "y", "s").collect()}
    assert len(curve) == len({*s}) and all(abs(p - y[s >= t].mean()) < 1e-9 and abs(q - y[s >= t].sum() / y.sum()) < 1e-9 for t, (p, q) in curve.items())
    assert math.isnan(metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0])


@pytest.mark.parametrize("name", ["diverse_batch", "export_deltas"])
def test_export_reads_events_few_times(spark, sf, name):
    """Curation, cover, target and sides by windows: before, 78 scans and more."""
    from tracewright.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") <= 4


def test_cover_and_target_with_odd_frames(spark):
    """Repeated, missing and null frames and episodes: windows of the table itself
    cover what covered() finds, and targets are those of a set."""
    rng = np.random.default_rng(5)
    rows = [(int(e), int(f), f / 10, bool(rng.random() < 0.9)) for e in range(6) for f in range(40) if rng.random() < 0.95]
    rows += [(1, 7, 0.75, True), (2, 9, 0.9, True), (None, 3, 0.3, True), (3, None, 0.3, True)] + [(None, i, i / 10, True) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, ok boolean")
    w = sequence.training_windows(df, 4, 1, F.col("ok"))
    starts = {(r[EPISODE], r.start_frame) for r in w.collect() if r[EPISODE] is not None}
    want = sorted(r for r in rows if None not in r[:2] and any((r[0], r[1] - i) in starts for i in range(4)))
    assert len(want) > 40
    assert sorted(map(tuple, sequence.covered(df, w).collect())) == want
    assert sorted(map(tuple, sequence.in_windows(df, 4, 1, F.col("ok")).filter("in_window").drop("in_window").collect())) == want
    have = {r[:2] for r in rows}
    for offset in (1, 5, -2):
        there = sorted(r for r in rows if None not in r[:2] and (r[0], r[1] + offset) in have)
        assert sorted(map(tuple, sequence.future_exists(df, offset).collect())) == there


def test_timestep_flags_against_thresholds(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    rows = [(e, f, [float(rng.normal()) * (50 if rng.random() < 0.1 else 1), *([float(f)] if f % 3 else [])], [float(f % 2)]) for e in range(3) for f in range(30)]
    rows += [(3, 0, [nan, 1.0], [0.0]), (3, 1, [inf, 1.0], [None]), (3, 2, [1.0, 1.0], [5.0]), (3, 3, None, [0.0]), (3, 4, [2.0], None), (4, 0, [1.0], [1.0]), (None, 1, [1.0], [9.0])]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, a array<double>, b array<double>")
    low, high = {"k": 2.0}, {"k": 4.0, "least": 0.5, "range_share": 0.25}
    want = {}
    for v in ("a", "b"):
        d = discontinuity.element_deltas(df, F.col(v))
        for i, p in enumerate((low, high)):
            for r in discontinuity.element_flags(d, discontinuity.thresholds(d, **p)).collect():
                want.setdefault((r[EPISODE], r[FRAME]), [False, False])[i] |= r.flag_any
    got = {(r[EPISODE], r[FRAME]): [r.any_discontinuity, r.severe_discontinuity] for r in discontinuity.timestep_flags(df, {"a": F.col("a"), "b": F.col("b")}, low, high).collect()}
    assert got == want and any(s for _, s in want.values()) and not all(a for a, _ in want.values())


@pytest.mark.parametrize("n", [1, 6, 11])
def test_diverse_rows_against_a_loop(spark, n):
    cells = ["trainearly", "trainmiddle", "trainlate", "valmiddle", "testearly", "testlate"]
    rows = [(e, f, ["train", "val", "test", "train"][e % 4]) for e in range(9) if e != 2 for f in range(e % 3 + 3)]
    df = spark.createDataFrame(rows[::-1], "episode_index long, frame_index long, split string").repartition(3)
    seen, order = set(), []
    for e, f, s in sorted(rows):
        share = f / max(y for x, y, _ in rows if x == e)
        cell = s + ("early" if share <= 0.25 else "late" if share >= 0.75 else "middle")
        order.append((cells.index(cell) if cell in cells and cell not in seen else 99, e, f))
        seen.add(cell)
    assert [(r[EPISODE], r[FRAME]) for r in export.diverse_rows(df, n).collect()] == [x[1:] for x in sorted(order)[:n]]
