import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.config import Curation, ImageRules
from tracewright.functions import images
from tracewright.operators import annotations
from tracewright.sources import frames as sources
from tracewright.sources import sinks
from tracewright.streaming import monitors


def picture(spark, *arrays):
    rows = [(0, i, None if a is None else a.tobytes(), *((8, 8) if a is None else a.shape[:2]), 1 if a is None or a.ndim == 2 else 3) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "episode_index long, frame_index long, pixels binary, height int, width int, channels int")


def test_scores(spark):
    flat = np.full((8, 8), 255, np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, (8, 8), dtype=np.uint8)
    got = images.scored(picture(spark, flat, noise, None)).orderBy("frame_index").collect()
    assert got[0].overexposed and got[0].blurred and got[0].low_entropy and got[0].sharpness == 0
    assert math.isclose(got[1].mean_luma, noise.mean()) and not got[1].blurred and got[2].sharpness is None
    x = noise.astype(float)
    lap = [[x[i - 1, j] + x[i + 1, j] + x[i, j - 1] + x[i, j + 1] - 4 * x[i, j] for j in range(1, 7)] for i in range(1, 7)]
    assert math.isclose(got[1].sharpness, np.var(lap))
    assert images.laplacian_variance(np.zeros((2, 2), np.uint8)) == 0
    ones = np.ones((4, 4, 3), np.uint8)
    assert images.gray(ones).max() == 254 and images.gray(ones, rescale=False).max() in (0, 1)


def test_duplicates(spark):
    a = np.random.default_rng(2).integers(10, 240, (8, 8), dtype=np.uint8)
    b = a.copy()
    b[0, 0] += 5
    got = images.with_duplicates(picture(spark, a, a, b, (b + 3).astype(np.uint8), 255 - a, None, a)).orderBy("frame_index").collect()
    kinds = ["exact" if r.exact_duplicate else "lossless" if r.near_lossless_duplicate else "near" if r.near_duplicate else "" for r in got]
    assert kinds == ["", "exact", "lossless", "near", "", "", ""]
    from tracewright.operators.curation import with_duplicates

    rows = [(0, i, [float(x) for x in v]) for i, v in enumerate(([1, 1], [1, 1], [1, 2], [4, 6], [90, 90]))] + [(0, 9, [90.0, 90.0])]
    d = with_duplicates(spark.createDataFrame(rows, "episode_index long, frame_index long, x array<double>"), "x", ImageRules()).orderBy("frame_index").collect()
    assert [r.exact_duplicate for r in d] == [False, True, False, False, False, False] and d[2].near_lossless_duplicate and d[3].near_duplicate


def test_resize_augment_features(spark):
    a = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    assert (images.resized(a, 8, 8) == a).all() and images.resized(a, 5, 3).shape == (5, 3, 3)
    df = picture(spark, a)
    one = images.augment(df, 3).collect()[0].pixels
    assert one == images.augment(df.repartition(4), 3).collect()[0].pixels and len(one) == 192
    with pytest.raises(ValueError):
        images.augment(df, 3, ["horizontal_flip"])
    assert len(images.prepared(df, 16).first().pixels) == 16 * 16 * 3
    f = images.features(df).first().features
    assert len(f) == 512 + 900 and math.isclose(sum(f[:512]), 1.0)


def test_results_leave_python_in_slices(spark, monkeypatch):
    """A worker holds some SLICE bytes of results, not those of a whole batch."""
    taken = []
    monkeypatch.setattr(images.F, "pandas_udf", lambda kind: lambda run: lambda *_: taken.append(run) or F.lit(None).cast(kind))
    a = np.random.default_rng(3).integers(0, 256, (8, 8), dtype=np.uint8)
    df = picture(spark, a)
    images.features(df), images.prepared(df, 224), images.augment(df, 3)
    monkeypatch.undo()
    n = 900
    batch = [[a.tobytes(), None, *[a.tobytes()] * (n - 2)], [8] * n, [8] * n, [1] * n, range(n)]
    for run, width, each in zip(taken, (4, 4, 5), (1412 * 8, 224 * 224 * 3, 64), strict=True):
        got = list(run(iter([tuple(batch[:width])])))
        assert sum(map(len, got)) == n and pd.concat(got).reset_index(drop=True).isna().to_numpy().nonzero()[0].tolist() == [1]
        assert max(len(s) for s in got) <= images.SLICE // each + 2
    rows = [(0, i, None if i == 7 else np.roll(a, i).tobytes(), 8, 8, 1) for i in range(n)]
    many = spark.createDataFrame(rows, df.schema).repartition(2)
    want = {i: None if p is None else images.features_of(np.frombuffer(p, np.uint8).reshape(8, 8)) for _, i, p, *_ in rows}
    for r in images.features(many).select("frame_index", "features").collect():
        assert (r.features is None) == (want[r.frame_index] is None) and (r.features is None or np.array_equal(r.features, want[r.frame_index]))


REV = "r1"


def golden():
    seg = lambda i, a, b, p: {"annotation_id": f"p{i}", "start_frame": a, "end_frame": b, "phase": p, "start_timestamp": a / 10, "end_timestamp": b / 10}
    return {k: "x" for k in annotations.TOP_FIELDS} | {
        "schema_version": "1.0.0", "dataset_revision": REV, "fps": 10.0, "n_frames": 30, "exhaustive_phase_timeline": True, "episode_label": {k: 1 for k in annotations.LABEL_FIELDS} | {"annotation_id": "e"},
        "phase_segments": [seg(0, 0, 10, "approach"), seg(1, 10, 20, "lift"), seg(2, 20, 30, "retract")], "events": [{"annotation_id": "v0", "frame_index": 3, "event_type": "collision", "timestamp": 0.3}],
        "attention_proxy_rois": [{"annotation_id": "r0", "shape": "bbox_xyxy", "coordinates": [0.1, 0.1, 0.5, 0.5]}], "visibility_labels": [{"annotation_id": "w0", "visibility": "uncertain"}], "failure_moments": [],
    }


def changed(**kw):
    d = golden()
    d.update(kw)
    return d


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def part(name, i, **kw):
    d = golden()
    d[name][i].update(kw)
    return d


CASES = [
    (golden(), []),
    (without(golden(), "events"), ["missing_required_field"]),
    (changed(schema_version="2"), ["invalid_schema_version"]),
    (changed(dataset_revision="z"), ["invalid_dataset_revision"]),
    (changed(episode_label={"annotation_id": "p0"}), ["duplicate_annotation_id"] + ["missing_required_field"] * 6),
    (part("phase_segments", 0, end_frame=0, end_timestamp=0.0), ["exhaustive_timeline_gap", "invalid_frame_range"]),
    (part("phase_segments", 2, end_frame=31, end_timestamp=3.1), ["invalid_frame_range"]),
    (part("phase_segments", 0, phase="dance"), ["unknown_enum_value"]),
    (part("phase_segments", 1, start_timestamp=1.2), ["frame_timestamp_mismatch"]),
    (part("phase_segments", 1, start_frame=8, start_timestamp=0.8), ["overlapping_primary_phases"]),
    (part("phase_segments", 1, start_frame=12, start_timestamp=1.2), ["exhaustive_timeline_gap"]),
    (part("phase_segments", 1, alignment_error_s=0.06), ["alignment_error_exceeds_tolerance"]),
    (part("events", 0, frame_index=30, timestamp=3.0), ["event_outside_episode_bounds"]),
    (part("events", 0, event_type="party"), ["unknown_enum_value"]),
    (changed(failure_moments=[{"annotation_id": "f", "failure_type": "boredom", "frame_index": 99}]), ["event_outside_episode_bounds", "unknown_enum_value"]),
    (part("visibility_labels", 0, visibility="maybe"), ["unknown_enum_value"]),
    (part("attention_proxy_rois", 0, coordinates=[]), ["invalid_roi_coordinates"]),
    (part("attention_proxy_rois", 0, coordinates=[0.1, 1.4]), ["invalid_roi_coordinates"]),
    (part("attention_proxy_rois", 0, coordinates=[0.5, 0.1, 0.1, 0.5]), ["invalid_roi_coordinates"]),
]


def test_annotations(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)], "doc_id long, doc string")
    got = {i: [] for i in range(len(CASES))}
    for r in annotations.violations(df, REV).collect():
        got[r.doc_id].append(r.code)
    for i, (_, want) in enumerate(CASES):
        assert sorted(got[i]) == want, i
    report = {r.doc_id: r for r in annotations.report(df, REV).collect()}
    assert report[0].ok and report[1].n_errors == 1 and len(report) == len(CASES)


def test_view_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.1), (1, 0, 0.0)], "episode_index long, frame_index long, timestamp double")
    episodes = spark.createDataFrame([(0, True), (1, False)], "episode_index long, accepted boolean")
    windows = spark.createDataFrame([(0, 0, 2, "strict")], "episode_index long, start_frame long, end_frame long, policy string")
    root = str(tmp_path / "view")
    assert "config_hash" in sinks.write_view(root, episodes, rows, windows, Curation(), dry_run=True) and not (tmp_path / "view").exists()
    sinks.write_view(root, episodes, rows, windows, Curation())
    with pytest.raises(FileExistsError):
        sinks.write_view(root, episodes, rows, windows, Curation())
    sinks.write_view(root, episodes, rows, windows, Curation(), force=True)
    view = sources.CuratedView.load(spark, root)
    assert view.timesteps.count() == 3 and view.of_policy("strict").count() == 1 and view.of_policy("x").count() == 0
    sinks.write_by_episode(rows, episodes, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if "=" in p.name) == ["episode_index=0"]
    sinks.write_csv(episodes, str(tmp_path / "csv"))
    sinks.write_jsonl(windows, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 1
    sinks.write_report({"x": np.float64("nan"), "p": "/home/me/a/b"}, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": None, "p": "a/b"}


def test_sources(spark, tmp_path):
    df = spark.range(6).selectExpr("id % 3 as episode_index", "id as frame_index", "1 as `observation.images.top`", "2.0 as action")
    df.write.parquet(str(tmp_path / "data/chunk-000"))
    got = sources.read_frames(spark, str(tmp_path / "data"), ["action"], max_episodes=2)
    assert sorted(got.columns) == ["action", "episode_index"] and got.count() == 4
    assert len(sources.data_files(spark, str(tmp_path))) >= 1
    features = {"observation.state": {"dtype": "float32", "names": {"motors": ["a", "gripper"]}}, "action": {"dtype": "float32", "names": ["a"]}, "observation.images.wrist": {"dtype": "video"}, "observation.images.top": {"dtype": "video"}}
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/info.json").write_text(json.dumps({"fps": 30, "features": features}))
    m = sources.build_manifest(tmp_path, "n", "r")
    assert m.keys["state"] == "observation.state" and [c["viewpoint"] for c in m.cameras] == ["verified_egocentric", "verified_external"]
    assert sources.motor_names(features["observation.state"]) == ["a", "gripper"] and sources.motor_names({}) is None
    views = spark.createDataFrame([("cam_wrist",), ("top",), ("wrist_top",), ("cam",)], "k string").select(sources.viewpoint(F.col("k"))).collect()
    assert [r[0] for r in views] == ["verified_egocentric", "verified_external", "ambiguous", "ambiguous"]
    assert sources.gate("ambiguous")["status"] == "blocked" and sources.read_stats(tmp_path) is None
    assert sources.video_file(["videos/b/1.mp4", "videos/a/2.mp4", "videos/a/1.mp4"], "a") == "videos/a/1.mp4"


def test_streams(spark, tmp_path):
    rows = [(e, f, 0.9 if f > 3 * (e + 1) else 0.1) for e in range(2) for f in range(12)]
    spark.createDataFrame(rows, "episode_index long, frame_index long, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("episode_index long, frame_index long, score double").parquet(str(tmp_path / "in"))
    q = monitors.live_triggers(stream, "score", 0.5).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    # With timeouts in processing time there is always one more batch to run, so wait no longer than needed.
    q.awaitTermination(40)
    q.stop()
    assert {(r.episode_index, r.trigger_frame) for r in spark.sql("select * from live").collect()} == {(0, 7), (1, 10)}
