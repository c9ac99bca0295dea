import random

import numpy as np
import pyarrow as pa
from llm_helpers import prose
import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality as q
from tracewright.llm.textcodes import Words


def documents(n=600):
    r = random.Random(1)
    rows = []
    for i in range(n):
        good = i % 3 != 0
        text = prose(i, r.randint(30, 90)).capitalize() + "."
        if not good:
            text = " ".join(w.upper() + r.choice(["!!", "***", " |", "%%%"]) for w in text.split())
        rows.append((i, text, r.choice(["en", "de"]), f"s{r.randint(0, 5) + (0 if good else 4)}", len(text), int(good)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = documents()
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2], "doc_id long, quality int")
    return rows, df, labels, q.written(q.features(df), "t")


def test_held_out_accuracy(table):
    rows, df, labels, features = table
    got = {r.doc_id: r for r in q.score(df, labels).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert np.mean([got[r[0]].keep == bool(r[5]) for r in held]) >= 0.98
    assert all(0 <= got[i].score <= 1 for i in got)
    kept = q.keep_good(df, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep} and kept.columns == df.columns
    bounded = q.train(features, labels, max_rows=100)
    assert sum(bounded.sample.values()) == 100


def test_both_views_teach_in_every_round(table):
    rows, df, labels, features = table
    model = q.train(features, labels)
    assert len(model.exchange) == q.ROUNDS
    for told in model.exchange:
        for side in ("text", "meta"):
            assert told[side]["bad"] > 0 and told[side]["good"] > 0, told
            assert told[side]["after"] <= told[side]["before"] + 0.02, told
    alone = q.train(features, labels, weight=0.0)
    assert np.abs(model.text.w - alone.text.w).max() > 1e-3 and np.abs(model.meta.w - alone.meta.w).max() > 1e-3


def test_against_plain_numpy(table, spark):
    """The same exchange, written out over one array of all documents."""
    _, _, labels, features = table
    labels = labels.limit(200).collect()
    model = q.train(features, spark.createDataFrame(labels, "doc_id long, quality int"))
    t = features.toArrow()
    doc = t["doc_id"].to_pylist()
    raw = {"text": np.array(t["text"].to_pylist(), float), "meta": model.numbers.matrix(t)}
    known = {r.doc_id: r.quality for r in labels}
    at = [i for i, d in enumerate(doc) if d in known]
    h = {r.doc_id: r.h for r in features.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    held = np.array([int(q.mix(np.array([h[doc[i]]], np.int64).view(np.uint64))[0]) % 1000 < 300 for i in at])
    y = np.array([known[doc[i]] for i in at], float)
    fit, out = [i for i, x in zip(at, held, strict=True) if not x], [i for i, x in zip(at, held, strict=True) if x]
    yf, yh = y[~held], y[held]
    own = {s: m[fit].copy() for s, m in raw.items()}
    own["meta"] = model.numbers.matrix(t.take(pa.array(fit)), yf)
    free = [i for i, d in enumerate(doc) if d not in known]

    def solve(x, target, weight, steps):
        w = np.zeros(x.shape[1] + 1)
        x = np.c_[x, np.ones(len(x))]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ w))
            pull = np.append(np.full(x.shape[1] - 1, q.RIDGE), 1e-6)
            w = w + np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pull), x.T @ (weight * (target - p)) - pull * w)
        return w

    scale = {s: (m.mean(0), np.where(m.std(0) > 1e-6, m.std(0), 1.0)) for s, m in raw.items()}
    z = {s: (m - scale[s][0]) / scale[s][1] for s, m in raw.items()}
    zf = {s: (m - scale[s][0]) / scale[s][1] for s, m in own.items()}
    w = {s: solve(zf[s], yf, np.ones(len(fit)), 12) for s in z}
    value = lambda s: z[s] @ w[s][:-1] + w[s][-1]
    odds = {s: np.polyval(q.platt(value(s)[out], yh), value(s)) for s in z}
    prior = yf.mean()
    for _ in range(q.ROUNDS):
        new = {}
        for s, teacher in (("text", "meta"), ("meta", "text")):
            bins = np.clip(np.floor((odds[teacher][free] + q.LIMIT) / (2 * q.LIMIT) * q.BINS), 0, q.BINS - 1)
            order = np.sort(bins)
            n = len(free)
            low = next(b for b in order if (bins <= b).sum() >= q.SHARE * (1 - prior) * n)
            high = next(b for b in order[::-1] if (bins >= b).sum() >= q.SHARE * prior * n)
            assert low < high
            told = [(i, q.PSEUDO * (yf == k).sum() / side.sum()) for k, side in ((0, bins <= low), (1, bins >= high)) for i, yes in zip(free, side, strict=True) if yes]
            x = np.r_[zf[s], z[s][[i for i, _ in told]]]
            target = np.r_[yf, 1 / (1 + np.exp(-odds[teacher][[i for i, _ in told]]))]
            new[s] = solve(x, target, np.r_[np.ones(len(fit)), [v for _, v in told]], q.STEPS)
        w = new
        odds = {s: np.polyval(q.platt(value(s)[out], yh), value(s)) for s in z}
    assert np.allclose(w["meta"], model.meta.w, atol=1e-4) and np.allclose(w["text"], model.text.w, atol=1e-3)
    mine = 1 / (1 + np.exp(-(odds["text"] + odds["meta"] - np.log(yh.mean() / (1 - yh.mean())))))
    theirs = model.scores(raw["text"], t)[2]
    assert np.abs(mine - theirs).max() < 1e-3


def test_cuts_never_cross():
    r = np.random.default_rng(1)
    for prior in (0.001, 0.5, 0.999):
        for counts in (np.zeros(q.BINS), np.eye(1, q.BINS, 7)[0] * 50, r.integers(0, 3, q.BINS).astype(float)):
            low, high, a, b = q.cuts(counts, prior, q.SHARE)
            assert low < high and (a, b) == (counts[: low + 1].sum(), counts[high:].sum())


def test_many_sources_and_missing_metadata(spark, table):
    """A rate for every source, however many; columns that aren't there are null."""
    rows, df, labels, _ = table
    numbers = q.Meta(0.5, (q.rates([f"s{i}" for i in range(1000)] * 2, np.tile(np.arange(1000) % 2, 2)), {}))
    t = pa.table({"source": [f"s{i}" for i in range(1000)] + [None, "new"], "lang": [None] * 1002, "n_chars": [None] * 1002})
    m = numbers.matrix(t)
    assert (np.sign(m[:1000, 0]) == np.arange(1000) % 2 * 2 - 1).all() and not m[1000:, 0].any()
    out = q.score(df.select("doc_id", "text"), labels)
    assert out.count() == len(rows) and out.filter("score is null").count() == 0
    named = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "lang", "source", "n_chars")
    marked = labels.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "quality")
    kept = {r.doc_id for r in q.keep_good(named, marked).collect()}
    assert np.mean([(f"d{r[0]}" in kept) == bool(r[5]) for r in rows]) > 0.97


def test_newton_sums_equal_one_fit():
    r = np.random.default_rng(2)
    x, y = np.c_[r.normal(size=(200, 3)), np.ones(200)], (r.random(200) < 0.5).astype(float)
    w = r.normal(size=4)
    parts = q.newton(x[:70], y[:70], np.ones(70), w) + q.newton(x[70:], y[70:], np.ones(130), w)
    assert np.allclose(parts, q.newton(x, y, np.ones(200), w))


def test_features_by_hand():
    t = q.text_features(pa.array(["AB a a!", "", None, "é"]), Words())
    assert np.allclose(t[0, 0] ** 2, 2 / 7) and np.allclose(t[0, 5] ** 2, 1 / 7)
    assert np.allclose(t[0, len(q._CLASSES) + 1], 2 / 3) and not t[1].any() and not t[2].any()
    assert np.allclose((t[0, -q.BUCKETS :] ** 2).sum(), 1)


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (8, None), (1, 1), (7, 0), (9, 1)], "doc_id long, quality int")
    out = q.score(odd, labels)
    assert out.count() == odd.count() and out.filter("score is null").count() == 0
    assert q.keep_good(odd, labels).columns == odd.columns
    assert q.score(none, labels).count() == 0
    nothing = q.score(odd, labels.filter(F.lit(False)))
    assert nothing.filter("keep").count() == odd.count()
