"""The matrix of planned rollouts, and checks of matrices and result records."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = dict(zip("nominal_held_out object_target_shift lighting_camera_perturbation control_latency_dynamics occlusion_distractor".split(), (40, 20, 15, 15, 10), strict=True))
SEED = 42_000
FORBIDDEN = "evaluation_labels ground_truth_success simulator_success task_success_label".split()
ROLLOUT_FIELDS = "observation_config paired_comparison_group perturbations rollout_id seed slice training_view".split()
RESULT_FIELDS = "curation_view dataset_repo_id dataset_revision evaluation_slice ground_truth_success_source observation_config policy_checkpoint_id rollout_id seed task_outcome".split()
UNDER_TEST = "wrist_success_detector_under_test"


def rollout_matrix(spark: SparkSession, seed: int = SEED, training_view: str = "conservative", observation: str = "wrist_plus_top") -> DataFrame:
    """A row for each planned rollout: its slice, seed and what is changed, by
    modular steps of its number within the slice. What a slice doesn't change is
    null."""
    slices = spark.createDataFrame([(i, n, c, sum([*SLICES.values()][:i])) for i, (n, c) in enumerate(SLICES.items())], "slice_no int, slice string, count int, before int")
    each = slices.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).withColumn("k", F.col("before") + F.col("i"))
    i = F.col("i")
    only = lambda name, c: F.when(F.col("slice") == name, c)
    changes = F.struct(
        (F.col("slice") != "nominal_held_out").alias("enabled"),
        F.col("slice").alias("type"),
        only("object_target_shift", F.array(0.02 * (i % 5 - 2), 0.015 * (i % 3 - 1))).alias("object_xy_offset_m"),
        only("object_target_shift", (5 * (i % 4)).cast("int")).alias("target_yaw_deg"),
        only("lighting_camera_perturbation", 0.7 + 0.1 * (i % 5)).alias("brightness_scale"),
        only("lighting_camera_perturbation", 0.9 + 0.05 * (i % 3)).alias("gamma"),
        only("control_latency_dynamics", (20 + 10 * (i % 4)).cast("int")).alias("action_delay_ms"),
        only("control_latency_dynamics", 0.9 + 0.05 * (i % 3)).alias("friction_scale"),
        only("occlusion_distractor", F.lit(True)).alias("occluder"),
        only("occlusion_distractor", (1 + i % 2).cast("int")).alias("distractor_count"),
    )
    number = (F.lit(seed) + F.col("k")).cast("int")
    return each.select(
        F.format_string("R%03d", "k").alias("rollout_id"), "slice", number.alias("seed"), F.lit(observation).alias("observation_config"), F.lit(training_view).alias("training_view"), F.lit("raw").alias("state_features"), changes.alias("perturbations"), F.concat(F.lit("PAIR_"), number).alias("paired_comparison_group"), F.lit(True).alias("policy_inputs_forbid_simulator_success")
    )


def paired_templates(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """Same seeds under every combination of view, observation and state."""
    rows = product([seed, seed + 1, seed + 40], ["conservative", "strict"], ["wrist_only", "top_only", "wrist_plus_top"], ["raw", "smoothed"])
    out = spark.createDataFrame(list(rows), "seed int, training_view string, observation_config string, state_features string")
    return out.withColumn("paired_comparison_group", F.concat(F.lit("PAIR_"), F.col("seed")))


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def protocol_violations(rollouts: DataFrame, n_templates: int, slices: dict[str, int] = SLICES) -> DataFrame:
    """(code, subject). rollouts: one JSON object a row, `doc`; presence of a
    field is that of its key, so that null and missing differ."""
    spark = rollouts.sparkSession
    field = lambda n: F.get_json_object("doc", f"$.{n}")
    r = rollouts.select(field("rollout_id").alias("id"), field("slice").alias("slice"), field("seed").alias("seed"), field("observation_config").alias("observation"), F.get_json_object("doc", "$.perturbations").alias("perturbations"), field("policy_inputs_forbid_simulator_success").alias("forbid"), _keys(F.col("doc")).alias("keys"), _keys(field("policy_inputs")).alias("inputs"))
    expected = sum(slices.values())
    total = r.agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.count_distinct("id").alias("different_ids"), F.count("seed").alias("seeds"), F.count_distinct("seed").alias("different_seeds"))
    whole = total.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != expected, "rollout_count"), F.when(F.col("ids") != F.col("different_ids"), "duplicate_rollout_id"), F.when(F.col("seeds") != F.col("different_seeds"), "duplicate_seed")))).alias("code")).select("code", F.lit(None).cast("string").alias("subject"))
    wanted = spark.createDataFrame(list(slices.items()), "slice string, want int")
    have = r.groupBy("slice").agg(F.count("*").alias("have"))
    by_slice = wanted.join(have, "slice", "left").filter(F.coalesce("have", F.lit(0)) != F.col("want")).select(F.lit("slice_count").alias("code"), F.col("slice").alias("subject"))
    leaks = F.transform(F.array_intersect("inputs", F.array(*map(F.lit, FORBIDDEN))), lambda _: F.lit("simulator_gt_leakage"))
    own = F.concat(
        F.array_compact(
            F.array(
                F.when(F.size(F.array_except(F.array(*map(F.lit, ROLLOUT_FIELDS)), "keys")) > 0, "missing_field"),
                F.when(F.coalesce("observation", F.lit("")) == "", "missing_observation_config"),
                F.when(~F.startswith(F.coalesce("perturbations", F.lit("")), F.lit("{")), "missing_perturbations"),
                F.when(F.coalesce("forbid", F.lit("")) != "true", "simulator_gt_leakage"),
            )
        ),
        leaks,
    )
    each = r.select(F.explode(own).alias("code"), F.col("id").alias("subject"))
    templates = spark.createDataFrame([] if n_templates else [("paired_comparisons", None)], "code string, subject string")
    return whole.unionByName(by_slice).unionByName(each).unionByName(templates)


def result_violations(records: DataFrame) -> DataFrame:
    """(record, code, field) of result records, one JSON object a row: (record, doc)."""
    k = records.select("record", _keys(F.col("doc")).alias("keys"), _keys(F.get_json_object("doc", "$.policy_inputs")).alias("inputs"), F.get_json_object("doc", "$.ground_truth_success_source").alias("source"))
    entry = lambda code: lambda f: F.struct(F.lit(code).alias("code"), f.alias("field"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, RESULT_FIELDS)), "keys"), entry("missing_required_field"))
    leaks = F.transform(F.array_intersect("inputs", F.array(*map(F.lit, FORBIDDEN))), entry("simulator_gt_leakage"))
    source = F.when(F.col("source") == UNDER_TEST, F.array(F.struct(F.lit("invalid_gt_source").alias("code"), F.lit("ground_truth_success_source").alias("field")))).otherwise(F.array().cast("array<struct<code:string,field:string>>"))
    return k.select("record", F.explode(F.concat(missing, leaks, source)).alias("v")).select("record", "v.*")
