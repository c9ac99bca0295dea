"""Constraint queries over nested annotation documents.

A document is one JSON object a row: (doc_id, doc). Each rule is a query that
gives the violations (doc_id, code, annotation_id, detail); their union is the
report. Missing fields are looked for among the JSON's keys, since a typed
column can't tell a missing field from a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import frame_matches, tally

VERSION = "1.0.0"
MOST_FRAMES_OFF = 0.5
TOP_FIELDS = "annotator_id confidence created_at dataset_repo_id dataset_revision episode_index episode_label events fps phase_segments review_status schema_version source_modality status".split()
LABEL_FIELDS = "confidence demonstration_quality failure_types intervention_occurred n_recovery_attempts task_outcome".split()
PHASES = "approach grasp_verification gripper_close idle_or_reset lift lower place_alignment pregrasp_alignment recovery release retract terminal_hold transport uncertain".split()
EVENTS = "collision failure_onset first_contact gripper_close_start motion_start object_liftoff object_over_target object_slip operator_intervention placement_contact recovery_start release_complete release_start stable_grasp task_success_visible transport_start".split()
FAILURES = "ambiguous_visual_failure collision_visible exposure_failure frozen_camera missed_grasp object_lost_from_view severe_occlusion target_lost_from_view visual_slip".split()
VISIBILITIES = "fully_visible heavily_occluded not_visible partially_visible uncertain".split()
CONTAINERS = "attention_proxy_rois events failure_moments object_interaction_flags phase_segments visibility_labels wrist_interaction_states".split()

_ID = "annotation_id: string"
SCHEMA = (
    "struct<schema_version: string, dataset_revision: string, fps: double, n_frames: bigint, exhaustive_phase_timeline: boolean, episode_label: struct<annotation_id: string>, "
    f"phase_segments: array<struct<{_ID}, start_frame: bigint, end_frame: bigint, phase: string, start_timestamp: double, end_timestamp: double, alignment_error_s: double>>, "
    f"events: array<struct<{_ID}, frame_index: bigint, event_type: string, timestamp: double, alignment_error_s: double>>, "
    f"failure_moments: array<struct<{_ID}, failure_type: string, frame_index: bigint>>, visibility_labels: array<struct<{_ID}, visibility: string>>, "
    f"attention_proxy_rois: array<struct<{_ID}, shape: string, coordinates: array<double>>>, wrist_interaction_states: array<struct<{_ID}>>, object_interaction_flags: array<struct<{_ID}, flags: map<string, string>>>>"
)


def parsed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "doc", F.from_json("doc", SCHEMA).alias("d"))


def _found(df: DataFrame, code: str | Column, ident: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("doc_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), (ident if ident is not None else none).alias("annotation_id"), (detail.cast("string") if detail is not None else none).alias("detail"))


def _not_in(c: Column, values: list[str]) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def missing_fields(docs: DataFrame) -> DataFrame:
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    gone = F.concat(F.array_except(F.array(*map(F.lit, TOP_FIELDS)), keys(F.col("doc"))), F.transform(F.array_except(F.array(*map(F.lit, LABEL_FIELDS)), keys(F.get_json_object("doc", "$.episode_label"))), lambda x: F.concat(F.lit("episode_label."), x)))
    return _found(docs.select("doc_id", F.explode(gone).alias("f")), "missing_required_field", detail=F.col("f"))


def constants(docs: DataFrame, revision: str) -> DataFrame:
    wrong = F.array_compact(F.array(F.when(~F.coalesce(F.col("d.schema_version") == VERSION, F.lit(False)), "invalid_schema_version"), F.when(~F.coalesce(F.col("d.dataset_revision") == revision, F.lit(False)), "invalid_dataset_revision")))
    return _found(docs.select("doc_id", F.explode(wrong).alias("c")), F.col("c"))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """One violation for each occurrence of an id after the first."""
    own = [F.transform(F.coalesce(F.col(f"d.{c}"), F.array()), lambda x: x["annotation_id"]) for c in CONTAINERS]
    ids = F.concat(F.array(F.col("d.episode_label.annotation_id")), *own)
    counted = docs.select("doc_id", F.explode(F.filter(ids, lambda x: x.isNotNull() & (x != ""))).alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
    return _found(counted.select("doc_id", "id", F.explode(F.sequence(F.lit(2), F.col("n")))), "duplicate_annotation_id", F.col("id"))


def segments(docs: DataFrame) -> DataFrame:
    """Phase segments, a row each, ranked by (start, end) within the document."""
    s = docs.select("doc_id", F.coalesce("d.fps", F.lit(30.0)).alias("fps0"), F.col("d.n_frames").alias("n_frames"), F.col("d.exhaustive_phase_timeline").alias("exhaustive"), F.posexplode("d.phase_segments").alias("pos", "s"))
    flat = s.select("doc_id", F.when(F.col("fps0") == 0, 30.0).otherwise(F.col("fps0")).alias("fps"), "n_frames", "exhaustive", "pos", F.col("s.annotation_id").alias("id"), F.coalesce("s.start_frame", F.lit(-1)).alias("sf"), F.coalesce("s.end_frame", F.lit(-1)).alias("ef"), F.col("s.phase").alias("phase"), F.col("s.start_timestamp").alias("st"), F.col("s.end_timestamp").alias("et"), F.col("s.alignment_error_s").alias("off"))
    return flat.withColumn("bad_range", (F.col("sf") < 0) | (F.col("ef") < 0) | (F.col("ef") <= F.col("sf")))


def prior_end(ok: DataFrame) -> DataFrame:
    """Adds the greatest end of the segments before, in order: a segment that
    begins before it overlaps one of them, one that begins after leaves a gap."""
    w = Window.partitionBy("doc_id").orderBy("sf", "ef", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return ok.withColumn("prior_end", F.max("ef").over(w))


def segment_violations(seg: DataFrame) -> DataFrame:
    ok = prior_end(seg.filter(~F.col("bad_range")))
    off = lambda c: F.abs(c * F.col("fps")) > MOST_FRAMES_OFF
    codes = F.array_compact(
        F.array(
            F.when(F.col("n_frames").isNotNull() & ((F.col("sf") >= F.col("n_frames")) | (F.col("ef") > F.col("n_frames"))), "invalid_frame_range"),
            F.when(_not_in(F.col("phase"), PHASES), "unknown_enum_value"),
            F.when(F.col("st").isNotNull() & ~frame_matches(F.col("sf"), F.col("st"), F.col("fps")), "frame_timestamp_mismatch"),
            F.when(F.col("et").isNotNull() & ~frame_matches(F.col("ef"), F.col("et"), F.col("fps")), "frame_timestamp_mismatch"),
            F.when(F.col("prior_end") > F.col("sf"), "overlapping_primary_phases"),
            F.when(off(F.col("off")), "alignment_error_exceeds_tolerance"),
        )
    )
    return _found(seg.filter("bad_range"), "invalid_frame_range", F.col("id")).unionByName(_found(ok.select("doc_id", "id", F.explode(codes).alias("c")), F.col("c"), F.col("id")))


def timeline_gaps(seg: DataFrame, exhaustive: bool | None = None) -> DataFrame:
    """Of documents whose timeline is to be complete (or all, if `exhaustive`):
    a start after 0, gaps between segments, and one at the end."""
    want = F.lit(exhaustive) if exhaustive is not None else F.coalesce("exhaustive", F.lit(False))
    ok = prior_end(seg.filter(~F.col("bad_range") & want & F.col("n_frames").isNotNull()))
    inner = ok.filter(F.col("sf") > F.col("prior_end")).select("doc_id", F.format_string("[%d, %d)", "prior_end", "sf").alias("g"))
    ends = ok.groupBy("doc_id").agg(F.min("sf").alias("first"), F.max("ef").alias("last"), F.first("n_frames").alias("n"))
    outer = ends.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("first") != 0, F.format_string("starts at %d", "first")), F.when(F.col("last") < F.col("n"), F.format_string("[%d, %d)", "last", "n"))))).alias("g"))
    return _found(inner.unionByName(outer), "exhaustive_timeline_gap", detail=F.col("g"))


def event_violations(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", F.coalesce("d.fps", F.lit(30.0)).alias("fps"), F.col("d.n_frames").alias("n"), "d")
    e = base.select("doc_id", "fps", "n", F.explode("d.events").alias("e")).withColumn("f", F.coalesce("e.frame_index", F.lit(-1)))
    outside = F.col("n").isNotNull() & ((F.col("f") < 0) | (F.col("f") >= F.col("n")))
    codes = F.array_compact(
        F.array(
            F.when(outside, "event_outside_episode_bounds"),
            F.when(_not_in(F.col("e.event_type"), EVENTS), "unknown_enum_value"),
            F.when(F.col("e.timestamp").isNotNull() & (F.col("f") >= 0) & ~frame_matches(F.col("f"), F.col("e.timestamp"), F.col("fps")), "frame_timestamp_mismatch"),
            F.when(F.abs(F.col("e.alignment_error_s") * F.col("fps")) > MOST_FRAMES_OFF, "alignment_error_exceeds_tolerance"),
        )
    )
    events = _found(e.select("doc_id", F.col("e.annotation_id").alias("id"), F.explode(codes).alias("c")), F.col("c"), F.col("id"))
    m = base.select("doc_id", "n", F.explode("d.failure_moments").alias("e")).withColumn("f", F.coalesce("e.frame_index", F.lit(-1)))
    codes = F.array_compact(F.array(F.when(_not_in(F.col("e.failure_type"), FAILURES), "unknown_enum_value"), F.when(outside, "event_outside_episode_bounds")))
    return events.unionByName(_found(m.select("doc_id", F.col("e.annotation_id").alias("id"), F.explode(codes).alias("c")), F.col("c"), F.col("id")))


def other_violations(docs: DataFrame) -> DataFrame:
    v = docs.select("doc_id", F.explode("d.visibility_labels").alias("v")).filter(_not_in(F.col("v.visibility"), VISIBILITIES))
    r = docs.select("doc_id", F.explode("d.attention_proxy_rois").alias("r")).withColumn("c", F.coalesce("r.coordinates", F.array().cast("array<double>")))
    at = lambda i: F.get("c", F.lit(i))
    empty = F.size("c") == 0
    outside = F.exists("c", lambda x: x.isNull() | (x < 0) | (x > 1))
    crossed = (F.col("r.shape") == "bbox_xyxy") & (F.size("c") == 4) & ((at(2) < at(0)) | (at(3) < at(1)))
    codes = F.array_compact(F.array(F.when(empty, "no coordinates"), F.when(outside, "outside [0, 1]"), F.when(~empty & crossed, "corners crossed")))
    rois = _found(r.select("doc_id", F.col("r.annotation_id").alias("id"), F.explode(codes).alias("m")), "invalid_roi_coordinates", F.col("id"), F.col("m"))
    return _found(v, "unknown_enum_value", F.col("v.annotation_id"), F.col("v.visibility")).unionByName(rois)


def violations(documents: DataFrame, revision: str, exhaustive: bool | None = None) -> DataFrame:
    """All violations of (doc_id, doc)."""
    docs = parsed(documents)
    seg = segments(docs)
    out = missing_fields(docs)
    for part in (constants(docs, revision), duplicate_ids(docs), segment_violations(seg), timeline_gaps(seg, exhaustive), event_violations(docs), other_violations(docs)):
        out = out.unionByName(part)
    return out


def report(documents: DataFrame, revision: str, exhaustive: bool | None = None) -> DataFrame:
    """(doc_id, ok, n_errors, n_warnings) of every document."""
    n = violations(documents, revision, exhaustive).groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n_errors"), F.lit(0).cast("long").alias("n_warnings"))


def code_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n"), tally(F.col("annotation_id").isNotNull()).alias("n_with_id"))
