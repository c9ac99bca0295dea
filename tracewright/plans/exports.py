"""Curation as a whole, export, protocol, annotation and image queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Curation, ImageRules
from ..functions import images
from ..functions.paths import portable
from ..functions.scalar import slug
from ..functions.vectors import clipped, long_form, norm
from ..model import EPISODE, FRAME, TIME, consecutive, previous
from ..operators import annotations, curation, discontinuity, export, protocol, sequence, splits
from .catalogue import LONG, TRAJ, W, events, query, read, vectors

_SPLIT = splits.split_of(range(10), (0.7, 0.1), 42)
_TRAIN = ", ".join(map(str, sorted(_SPLIT["train"])))
_BOUNDS = f"{LONG}, b AS (SELECT dim, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM long WHERE episode_index IN ({_TRAIN}) GROUP BY dim)"


def _train(spark, d):
    return vectors(spark, d).filter(F.col(EPISODE).isin(_SPLIT["train"]))


@query(f"WITH {_BOUNDS} SELECT dim, round(low, 6) AS low, round(high, 6) AS high FROM b")
def normalizer_fit(spark, d):
    return export.bounds(_train(spark, d), F.col("x"))


@query(f"WITH {LONG} SELECT dim, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END, 6) AS scale FROM long GROUP BY dim")
def standardiser_fit(spark, d):
    return export.standardiser(vectors(spark, d), F.col("x"))


_ENC = f"{_BOUNDS}, u AS (SELECT episode_index, frame_index, dim, value, low, high, 2 * (value - low) / (high - low + 1e-6) - 1 AS x FROM long JOIN b USING (dim))"


@query(f"WITH {_ENC} SELECT episode_index, frame_index, dim, round(least(greatest(x, -1), 1), 6) AS value FROM u UNION ALL SELECT label, vec_id, 64, 0.0 FROM embeddings")
def normalizer_transform(spark, d):
    n = export.fit(_train(spark, d), F.col("x"), width=65)
    return long_form(vectors(spark, d), n.encode(F.col("x")), [EPISODE, FRAME])


@query(f"WITH {_ENC} SELECT round(avg(CASE WHEN abs(x) > 1 THEN 1.0 ELSE 0.0 END), 6) AS beyond, round(avg(CASE WHEN abs(x) >= 1 - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS at_bounds FROM u")
def clip_fractions(spark, d):
    return export.clip_fraction(vectors(spark, d), F.col("x"), export.fit(_train(spark, d), F.col("x"), width=65))


@query(f"WITH {_ENC}, e AS (SELECT abs((least(greatest(x, -1), 1) + 1) * 0.5 * (high - low + 1e-6) + low - value) AS e FROM u) SELECT round(max(e), 6) AS max_abs_error, round(avg(e), 6) AS mean_abs_error, max(e) < 1 AS ok FROM e")
def round_trip(spark, d):
    return export.round_trip(vectors(spark, d), F.col("x"), export.fit(_train(spark, d), F.col("x"), width=65))


def _curated(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole of curation over events: (episodes, timesteps, windows). A score
    between 0 and 255 stands for the picture: mean luma is v, sharpness k."""
    rules = Curation()
    base = events(spark, d).withColumns(
        {
            "decode_failure": F.col("v") < 0.05,
            "sharpness": F.col("k"),
            "mean_luma": F.col("v"),
            "underexposed": F.col("v") < 1.0,
            "overexposed": F.col("v") > 150.0,
            "low_entropy": F.col("k") < 3.0,
            "exact_duplicate": consecutive() & F.coalesce(F.col("kind") == previous("kind"), F.lit(False)),
            "near_lossless_duplicate": F.lit(False),
            "near_duplicate": F.lit(False),
            "state_motion": sequence.delta_norm(F.col("state")),
            "action_motion": sequence.delta_norm(F.col("action")),
        }
    )
    episodes = curation.episode_validation(base, rules.episode)
    flagged = curation.visual_flags(base, ImageRules(overexposed_run=2, frozen_run=2))
    smooth = sequence.smoothed(flagged, "v", rules.smoothing.window, rules.smoothing.degree, rules.smoothing.most_ratio, "v_smoothed").drop("rmse", "std", "applied")
    jumps = discontinuity.timestep_flags(base, {"state": F.col("state"), "action": F.col("action")}, {"k": 8.0}, {"k": 20.0, "least": 0.05, "range_share": 0.25})
    timesteps = smooth.join(jumps, [EPISODE, FRAME]).join(episodes.select(EPISODE, "accepted"), EPISODE)
    timesteps = timesteps.withColumns({"hard_valid": ~F.col("decode_failure") & F.col("accepted"), "soft_exclude_strict": F.col("soft_exclude") | F.col("severe_discontinuity"), "state_smoothed": F.array("v_smoothed")})
    windows = sequence.training_windows(timesteps, rules.horizon, rules.stride, curation.policy_ok("conservative"), "conservative").unionByName(sequence.training_windows(timesteps, rules.horizon, rules.stride, curation.policy_ok("strict"), "strict"))
    return episodes, timesteps, windows


_TS = f"""{TRAJ}, x0 AS (SELECT *, v < 0.05 AS fail, v > 150 AS over, coalesce(kind = lag(kind) OVER ({W}), false) AS dup, coalesce(abs(v - lag(v) OVER ({W})), 0) AS mo, count(*) OVER (PARTITION BY episode_index) >= 64 AS acc, v - lag(v) OVER ({W}) AS dv, k - lag(k) OVER ({W}) AS dk FROM traj),
e AS (SELECT episode_index, coalesce(quantile_cont(mo, 0.5) FILTER (frame_index > 0), 0) AS m, quantile_cont(k, 0.05) AS ls, greatest(20 * greatest(coalesce(mad(dv), 0), 1e-6), 0.05, 0.25 * (max(v) - min(v))) AS tv, greatest(20 * greatest(coalesce(mad(dk), 0), 1e-6), 0.05, 0.25 * (max(k) - min(k))) AS tk FROM x0 GROUP BY episode_index),
x1 AS (SELECT *, CASE WHEN m > 0 THEN mo >= m ELSE mo > 0 END AS mv, dup AND (CASE WHEN m > 0 THEN mo >= m ELSE mo > 0 END) AS fz FROM x0 JOIN e USING (episode_index)),
x2 AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index, over ORDER BY frame_index) AS io, frame_index - row_number() OVER (PARTITION BY episode_index, fz ORDER BY frame_index) AS iz FROM x1),
ts AS (SELECT *, NOT fail AND acc AS hard, (over AND count(*) OVER (PARTITION BY episode_index, over, io) >= 2) OR (fz AND count(*) OVER (PARTITION BY episode_index, fz, iz) >= 2) OR coalesce(abs(dv) > tv, false) OR coalesce(abs(dk) > tk, false) AS soft,
over AND count(*) OVER (PARTITION BY episode_index, over, io) >= 2 AS so, fz AND count(*) OVER (PARTITION BY episode_index, fz, iz) >= 2 AS sz FROM x2)"""


@query(
    f"""WITH {_TS} SELECT episode_index, frame_index, hard AS hard_valid, soft AS soft_exclude_strict, array_to_string(list_filter([CASE WHEN fail THEN 'missing_or_undecodable_wrist' END, CASE WHEN k < ls THEN 'low_sharpness_soft' END, CASE WHEN v < 1 THEN 'underexposed' END, CASE WHEN over THEN 'overexposed' END, CASE WHEN so THEN 'sustained_overexposure' END,
CASE WHEN k < 3 THEN 'low_entropy_heuristic' END, CASE WHEN dup THEN 'exact_duplicate' END, CASE WHEN fz THEN 'frozen_while_moving_candidate' END, CASE WHEN sz THEN 'sustained_frozen_while_moving' END, CASE WHEN dup AND NOT mv THEN 'stationary_duplicate_keep' END], lambda x: x IS NOT NULL), '|') AS reasons FROM ts"""
)
def curated_timesteps(spark, d):
    _, timesteps, _ = _curated(spark, d)
    return timesteps.select(EPISODE, FRAME, "hard_valid", "soft_exclude_strict", curation.joined_reasons().alias("reasons"))


def _windows_sql(ok: str, policy: str) -> str:
    return f"SELECT episode_index, frame_index AS start_frame, '{policy}' AS policy FROM (SELECT *, count(*) OVER a AS n, min(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER a AS o FROM ts WINDOW a AS ({W} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE n = 16 AND o = 1"


_BOTH = f"{_TS}, w AS ({_windows_sql('hard', 'conservative')} UNION ALL {_windows_sql('hard AND NOT soft', 'strict')})"


@query(f"WITH {_BOTH} SELECT policy, count(*) AS n_windows, count(DISTINCT episode_index) AS n_episodes FROM w GROUP BY policy")
def curated_windows(spark, d):
    return sequence.window_counts(_curated(spark, d)[2])


@query(f"WITH {_BOTH} SELECT (SELECT count(*) FROM (SELECT DISTINCT episode_index FROM ts)) AS n_episodes, (SELECT count(DISTINCT episode_index) FROM ts WHERE acc) AS n_accepted, (SELECT count(*) FROM ts) AS n_frames, (SELECT count(*) FROM ts WHERE hard) AS n_hard_valid, (SELECT count(*) FROM ts WHERE hard AND NOT soft) AS n_strict, (SELECT count(*) FROM w WHERE policy = 'conservative') AS n_conservative_windows, (SELECT count(*) FROM w WHERE policy = 'strict') AS n_strict_windows, (SELECT count(*) = 0 FROM (SELECT episode_index, start_frame FROM w WHERE policy = 'strict' EXCEPT SELECT episode_index, start_frame FROM w WHERE policy = 'conservative')) AS strict_is_subset")
def curation_summary(spark, d):
    episodes, timesteps, windows = _curated(spark, d)
    t = F.count(F.lit(1))
    out = episodes.agg(t.alias("n_episodes"), F.count(F.when(F.col("accepted"), 1)).alias("n_accepted"))
    out = out.crossJoin(timesteps.agg(t.alias("n_frames"), F.count(F.when(F.col("hard_valid"), 1)).alias("n_hard_valid"), F.count(F.when(F.col("hard_valid") & ~F.col("soft_exclude_strict"), 1)).alias("n_strict")))
    out = out.crossJoin(windows.agg(F.count(F.when(F.col("policy") == "conservative", 1)).alias("n_conservative_windows"), F.count(F.when(F.col("policy") == "strict", 1)).alias("n_strict_windows")))
    loose = sequence.not_subset(windows.filter("policy = 'strict'"), windows.filter("policy = 'conservative'")).agg((F.count(F.lit(1)) == 0).alias("strict_is_subset"))
    return out.crossJoin(loose)


def _examples(spark, d, mode: str = "absolute", offset: int = 0) -> DataFrame:
    rules = Curation()
    timesteps = sequence.in_windows(_curated(spark, d)[1], rules.horizon, rules.stride, curation.policy_ok("strict"))
    sides = read(spark, d, "events").select(F.col("user_id").cast("long").alias(EPISODE)).distinct().select(EPISODE, F.when(F.col(EPISODE) % 10 < 8, "train").when(F.col(EPISODE) % 10 == 8, "val").otherwise("test").alias("split"))
    n = export.Normaliser((0.0,), (100.0,), 2)
    return export.examples(timesteps.select(EPISODE, FRAME, TIME, "state", "action", "state_smoothed", "hard_valid", "decode_failure", "overexposed", "exact_duplicate", "in_window"), None, sides, n, "strict", "pick up the block", mode, None, offset, {"dataset_revision": "r1"})


_COVER = f"{_BOTH}, cov AS (SELECT * FROM ts AS f WHERE hard AND EXISTS (SELECT 1 FROM w WHERE w.policy = 'strict' AND w.episode_index = f.episode_index AND f.frame_index >= start_frame AND f.frame_index < start_frame + 16)), ex AS (SELECT *, CASE WHEN episode_index % 10 < 8 THEN 'train' WHEN episode_index % 10 = 8 THEN 'val' ELSE 'test' END AS split, 2 * k / (100 + 1e-6) - 1 AS enc FROM cov)"


@query(f"WITH {_COVER} SELECT episode_index, frame_index, split, round(least(greatest(enc, -1), 1), 6) AS encoded, CAST(0 AS DOUBLE) AS padding, 2 AS n_mask, overexposed FROM (SELECT *, over AS overexposed FROM ex)")
def export_examples(spark, d):
    x = _examples(spark, d)
    return x.select(EPISODE, FRAME, "split", F.get("action_encoded", F.lit(0)).alias("encoded"), F.get("action_encoded", F.lit(1)).alias("padding"), F.size("action_mask").alias("n_mask"), F.col("image_quality_flags.overexposed").alias("overexposed"))


@query(f"WITH {_COVER} SELECT count(*) AS n_examples, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, round(count(*) FILTER (abs(least(greatest(enc, -1), 1)) >= 1 - 1e-12) / greatest(count(*), 1), 6) AS clip_fraction, count(*) FILTER (abs(least(greatest(enc, -1), 1)) >= 1 - 1e-12) AS n_at_bounds FROM ex")
def export_summary(spark, d):
    return export.export_summary(_examples(spark, d), export.Normaliser((0.0,), (100.0,), 2))


@query(f"WITH {_COVER} SELECT split, count(*) AS n, round(sum(dd), 6) AS total FROM (SELECT a.*, coalesce(a.dk, 0) AS dd FROM ex AS a SEMI JOIN ex AS b ON a.episode_index = b.episode_index AND a.frame_index + 1 = b.frame_index) GROUP BY split")
def export_deltas(spark, d):
    return _examples(spark, d, "delta", 1).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.get("action_raw", F.lit(0))).alias("total"))


@query(f"WITH {_COVER}, p AS (SELECT *, max(frame_index) OVER (PARTITION BY episode_index) AS top FROM ex), q AS (SELECT *, CASE WHEN top <= 0 OR frame_index / top <= 0.25 THEN 'early' WHEN frame_index / top >= 0.75 THEN 'late' ELSE 'middle' END AS part FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY split, part ORDER BY episode_index, frame_index) AS rn, list_position(['trainearly', 'trainmiddle', 'trainlate', 'valmiddle', 'testearly', 'testlate'], split || part) AS cell FROM q) SELECT episode_index, frame_index, split, part AS temporal_position FROM r ORDER BY CASE WHEN rn = 1 AND cell > 0 THEN cell ELSE 99 END, episode_index, frame_index LIMIT 6")
def diverse_batch(spark, d):
    return export.diverse_rows(_examples(spark, d)).select(EPISODE, FRAME, "split", "temporal_position")


@query(f"WITH {_COVER}, b AS (SELECT split, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY episode_index, frame_index) - 1) / 32) AS BIGINT) AS batch FROM ex) SELECT split, batch, count(*) AS batch_size, 0 AS n_errors FROM b GROUP BY split, batch")
def collated_batches(spark, d):
    batches = export.collate(_examples(spark, d), 32)
    return batches.join(export.batch_errors(batches, 2, 1), ["split", "batch"]).select("split", F.col("batch").cast("long").alias("batch"), "batch_size", F.size("errors").alias("n_errors"))


_SLICES = " UNION ALL ".join(f"SELECT '{n}' AS slice, {c} AS n, {sum([*protocol.SLICES.values()][:i])} AS b" for i, (n, c) in enumerate(protocol.SLICES.items()))


@query(f"WITH s AS ({_SLICES}), r AS (SELECT slice, b + i AS k, i FROM s, range(40) AS r(i) WHERE i < n) SELECT printf('R%03d', k) AS rollout_id, slice, 42000 + k AS seed, 'PAIR_' || (42000 + k) AS paired_comparison_group, slice <> 'nominal_held_out' AS enabled, CASE WHEN slice = 'object_target_shift' THEN 5 * (i % 4) END AS target_yaw_deg, round(CASE WHEN slice = 'lighting_camera_perturbation' THEN 0.7 + 0.1 * (i % 5) END::DOUBLE, 6) AS brightness_scale, CASE WHEN slice = 'control_latency_dynamics' THEN 20 + 10 * (i % 4) END AS action_delay_ms, CASE WHEN slice = 'occlusion_distractor' THEN 1 + i % 2 END AS distractor_count FROM r")
def rollout_matrix(spark, d):
    m = protocol.rollout_matrix(spark)
    return m.select("rollout_id", "slice", "seed", "paired_comparison_group", *[f"perturbations.{c}" for c in ("enabled", "target_yaw_deg", "brightness_scale", "action_delay_ms", "distractor_count")])


@query("SELECT s AS seed, v AS training_view, o AS observation_config, x AS state_features, 'PAIR_' || s AS paired_comparison_group FROM (VALUES (42000), (42001), (42040)) AS a(s), (VALUES ('conservative'), ('strict')) AS b(v), (VALUES ('wrist_only'), ('top_only'), ('wrist_plus_top')) AS c(o), (VALUES ('raw'), ('smoothed')) AS e(x)")
def paired_templates(spark, d):
    return protocol.paired_templates(spark)


@query("SELECT * FROM (VALUES ('duplicate_seed', NULL), ('rollout_count', NULL), ('slice_count', 'nominal_held_out'), ('missing_field', 'R001'), ('missing_perturbations', 'R001'), ('simulator_gt_leakage', 'R001'), ('simulator_gt_leakage', 'R002')) AS v(code, subject)")
def protocol_violations(spark, d):
    """The matrix with one row gone, one without perturbations and flag and with
    another's seed, and one whose policy sees the outcome."""
    full = protocol.rollout_matrix(spark).filter("rollout_id <> 'R000'")
    doc = F.to_json(F.struct(*full.columns))
    broken = F.when(F.col("rollout_id") == "R001", F.regexp_replace(F.to_json(F.struct("rollout_id", "slice", F.lit(42005).alias("seed"), "observation_config", "training_view", "paired_comparison_group")), "^", "")).when(F.col("rollout_id") == "R002", F.regexp_replace(doc, r"^\{", '{"policy_inputs":{"simulator_success":1},')).otherwise(doc)
    return protocol.protocol_violations(full.select(broken.alias("doc")), 36)


def _documents(spark, d) -> DataFrame:
    """Conversations as annotation documents: a segment a turn, some too long,
    phases from roles, an event a document, few required fields."""
    t = read(spark, d, "conversations")
    length = 2 + F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    seg = F.struct(F.concat(F.lit("s"), F.col("turn")).alias("annotation_id"), (2 * F.col("turn") + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") > 0), 1).otherwise(0)).alias("start_frame"), (2 * F.col("turn") + length).alias("end_frame"), F.when(F.col("role") == "user", "approach").otherwise("lift").alias("phase"))
    by = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(seg)).alias("phase_segments"), F.count("*").alias("n"))
    event = F.struct(F.lit("s0").alias("annotation_id"), (F.col("conv_id") % 9).alias("frame_index"), F.when(F.col("conv_id") % 4 == 0, "unheard_of").otherwise("collision").alias("event_type"))
    doc = F.struct(F.lit("1.0.0").alias("schema_version"), F.lit("r1").alias("dataset_revision"), F.lit(10.0).alias("fps"), (2 * F.col("n")).alias("n_frames"), (F.col("conv_id") % 2 == 0).alias("exhaustive_phase_timeline"), "phase_segments", F.array(event).alias("events"))
    return by.select(F.col("conv_id").alias("doc_id"), F.to_json(doc).alias("doc"))


_DOCS = """t AS (SELECT conv_id, turn, 2 * turn + CASE WHEN conv_id % 5 = 0 AND turn > 0 THEN 1 ELSE 0 END AS sf, 2 * turn + 2 + (conv_id + turn) % 3 AS ef, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT *, max(ef) OVER (PARTITION BY conv_id ORDER BY sf, ef, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM t)"""


@query(f"WITH {_DOCS} SELECT conv_id AS doc_id, 's' || turn AS annotation_id FROM p WHERE pe > sf")
def timeline_overlap(spark, d):
    found = annotations.segment_violations(annotations.segments(annotations.parsed(_documents(spark, d))))
    return found.filter("code = 'overlapping_primary_phases'").select("doc_id", "annotation_id")


@query(f"WITH {_DOCS}, e AS (SELECT conv_id, min(sf) AS a, max(ef) AS b, any_value(n) AS n FROM t GROUP BY conv_id) SELECT conv_id AS doc_id, '[' || pe || ', ' || sf || ')' AS detail FROM p WHERE conv_id % 2 = 0 AND sf > pe UNION ALL SELECT conv_id, '[' || b || ', ' || 2 * n || ')' FROM e WHERE conv_id % 2 = 0 AND b < 2 * n UNION ALL SELECT conv_id, 'starts at ' || a FROM e WHERE conv_id % 2 = 0 AND a <> 0")
def timeline_gaps(spark, d):
    return annotations.timeline_gaps(annotations.segments(annotations.parsed(_documents(spark, d)))).select("doc_id", "detail")


@query(
    f"""WITH {_DOCS}, c AS (SELECT DISTINCT conv_id, n FROM t), a AS (
SELECT 'overlapping_primary_phases' AS code FROM p WHERE pe > sf UNION ALL SELECT 'invalid_frame_range' FROM t WHERE sf >= 2 * n OR ef > 2 * n UNION ALL SELECT 'unknown_enum_value' FROM c WHERE conv_id % 4 = 0 UNION ALL SELECT 'event_outside_episode_bounds' FROM c WHERE conv_id % 9 >= 2 * n
UNION ALL SELECT 'duplicate_annotation_id' FROM c UNION ALL SELECT 'missing_required_field' FROM c, range(15) UNION ALL SELECT 'exhaustive_timeline_gap' FROM p WHERE conv_id % 2 = 0 AND sf > pe UNION ALL SELECT 'exhaustive_timeline_gap' FROM (SELECT conv_id, max(ef) AS b, any_value(n) AS n FROM t GROUP BY conv_id) WHERE conv_id % 2 = 0 AND b < 2 * n)
SELECT code, count(*) AS n FROM a GROUP BY code"""
)
def annotation_violations(spark, d):
    """15 fields are missing: nine at the top and the six of the absent label."""
    return annotations.code_counts(annotations.violations(_documents(spark, d), "r1")).select("code", "n")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(url) WHEN page_id % 3 = 1 THEN 'docs/p' || page_id ELSE '<REDACTED_LOCAL_PATH>' END AS path, regexp_replace(url, '^.*/', '') AS slug FROM pages")
def path_sanitize(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/home/someone/work/docs/p"), F.col("page_id"))).otherwise(F.concat(F.lit("/mnt/disk/p"), F.col("page_id")))
    return read(spark, d, "pages").select("page_id", portable(raw, "/srv/project").alias("path"), slug(F.col("url")).alias("slug"))


def _pictures(spark, d) -> DataFrame:
    """Embeddings as 8 x 8 gray pictures."""
    x = vectors(spark, d)

    @F.pandas_udf("binary")
    def pixels(v):
        return v.map(lambda a: np.clip(np.rint(128 + 300 * np.asarray(a)), 0, 255).astype(np.uint8).tobytes())

    return x.select(EPISODE, FRAME, pixels("x").alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"))


_PIX = "px AS (SELECT label AS episode_index, vec_id AS frame_index, CAST(greatest(least(round_even(128 + 300 * CAST(unnest(embedding) AS DOUBLE), 0), 255), 0) AS BIGINT) AS g FROM embeddings)"


@query(f"WITH {_PIX}, h AS (SELECT episode_index, frame_index, g, count(*) AS n FROM px GROUP BY ALL), e AS (SELECT episode_index, frame_index, -sum(n / 64.0 * log2(n / 64.0)) AS e FROM h GROUP BY ALL) SELECT episode_index, frame_index, round(avg(g), 6) AS mean_luma, round(avg(CASE WHEN g <= 5 THEN 1.0 ELSE 0.0 END), 6) AS dark_share, round(avg(CASE WHEN g >= 250 THEN 1.0 ELSE 0.0 END), 6) AS bright_share, round(any_value(e), 6) AS entropy FROM px JOIN e USING (episode_index, frame_index) GROUP BY episode_index, frame_index")
def image_score(spark, d):
    return images.scored(_pictures(spark, d)).select(EPISODE, FRAME, "mean_luma", "dark_share", "bright_share", "entropy")


@query()
def image_quality(spark, d):
    """All scores and flags of a picture (rows only; tests have them in numpy)."""
    return images.with_duplicates(images.scored(_pictures(spark, d)), luma=True).drop("pixels")


@query()
def safe_augment(spark, d):
    return images.augment(images.prepared(_pictures(spark, d), 16, swap=False), 7).select(EPISODE, FRAME, F.length("pixels").alias("n_bytes"), F.sha2("pixels", 256).alias("digest"))


@query()
def image_features(spark, d):
    return images.features(_pictures(spark, d)).select(EPISODE, FRAME, norm(F.slice("features", 1, 512)).alias("colour"), F.size("features").alias("n"), F.array_max(clipped(F.col("features"))).alias("top"))
