"""Training examples: rows of a policy's windows, encoded by bounds fitted on
the training episodes only."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import share, tally
from ..functions.vectors import clipped, literal, long_form, mask, normalise, pad, restore
from ..model import EPISODE, FRAME, TIME
from .sequence import covered, delta_actions, future_exists, temporal_position


@dataclass(frozen=True)
class Normaliser:
    low: tuple[float, ...]
    high: tuple[float, ...]
    width: int
    eps: float = 1e-6

    @property
    def dims(self) -> int:
        return len(self.low)

    def unclipped(self, v: Column) -> Column:
        return normalise(v, literal(self.low), literal(self.high), self.eps)

    def encode(self, v: Column) -> Column:
        return pad(clipped(self.unclipped(v)), self.width)

    def decode(self, v: Column) -> Column:
        return restore(v, literal(self.low), literal(self.high), self.eps)

    def mask(self) -> Column:
        """As long as an encoded vector; 0 keeps the padding out of the loss."""
        return mask(max(self.width, self.dims), self.dims)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Normaliser:
        return cls(tuple(map(float, d["low"])), tuple(map(float, d["high"])), int(d["width"]), float(d.get("eps", 1e-6)))


def bounds(rows: DataFrame, vector: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(dim, low, high): exact quantiles of each element; a span of nothing is 1."""
    p = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    t = long_form(rows, vector).groupBy("dim").agg(p.alias("p")).select("dim", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))
    return t.select("dim", "low", F.when(F.col("high") - F.col("low") < 1e-8, F.col("low") + 1.0).otherwise(F.col("high")).alias("high"))


def fit(rows: DataFrame, vector: Column, width: int = 7, low: float = 0.01, high: float = 0.99) -> Normaliser:
    """bounds() brought to the driver: as many rows as a vector has elements."""
    got = bounds(rows, vector, low, high).orderBy("dim").collect()
    return Normaliser(tuple(r["low"] for r in got), tuple(r["high"] for r in got), width)


def standardiser(rows: DataFrame, vector: Column) -> DataFrame:
    """(dim, mean, scale) with the population's deviation, 1 for one of nothing."""
    t = long_form(rows, vector).groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return t.select("dim", "mean", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")).alias("scale"))


def clip_fraction(rows: DataFrame, vector: Column, n: Normaliser) -> DataFrame:
    """(beyond, at_bounds): shares of elements that lie beyond the bounds, and
    that end up on them."""
    x = rows.select(F.explode(n.unclipped(vector)).alias("x"))
    return x.agg(share(F.abs("x") > 1.0).alias("beyond"), share(F.abs("x") >= 1.0 - 1e-12).alias("at_bounds"))


def export_rows(timesteps: DataFrame, windows: DataFrame | None, policy: str, require_future_target: int = 0) -> DataFrame:
    """Hard-valid frames of the policy's windows; with an offset only those whose
    episode also has, among them, the frame that far on. Without a table of
    windows the timesteps tell by in_window which frames lie in the policy's."""
    valid = timesteps.filter("hard_valid")
    rows = valid.filter("in_window") if windows is None else covered(valid, windows.filter(F.col("policy") == policy))
    return future_exists(rows, require_future_target)


def examples(timesteps: DataFrame, windows: DataFrame | None, split: DataFrame, n: Normaliser, policy: str = "conservative", instruction: str = "", mode: str = "absolute", gripper: int | None = None, require_future_target: int = 0, constants: dict[str, str] | None = None) -> DataFrame:
    """Nested records, a row for each frame to train on. Differences of actions
    are taken over whole episodes, before any row goes."""
    action = delta_actions(F.col("action"), gripper) if mode == "delta" else F.col("action")
    base = timesteps.withColumn("action_raw", action)
    rows = export_rows(base, windows, policy, require_future_target).join(split, EPISODE)
    where = [F.col(EPISODE), F.col(FRAME), F.col(TIME)]
    flags = [c for c in ("hard_valid", "decode_failure", "overexposed", "exact_duplicate") if c in timesteps.columns]
    optional = [c for c in ("global_index", "state_smoothed") if c in timesteps.columns]
    return rows.select(
        *[F.lit(v).alias(k) for k, v in (constants or {}).items()],
        F.lit(policy).alias("curation_policy"),
        "split",
        *where,
        *optional,
        F.lit(instruction).alias("instruction"),
        F.struct(F.lit("wrist").alias("camera"), *where).alias("wrist_image_ref"),
        F.struct(F.lit("top").alias("camera"), *where).alias("top_image_ref"),
        F.col("state").alias("state_raw"),
        "action_raw",
        n.encode(F.col("action_raw")).alias("action_encoded"),
        n.mask().alias("action_mask"),
        F.lit(require_future_target).alias("action_offset_frames"),
        F.struct(*flags).alias("image_quality_flags"),
        F.struct(*where).alias("source_identity"),
        F.lit(True).alias("valid_for_training"),
        F.array().cast("array<string>").alias("invalidity_reasons"),
    )


def export_summary(rows: DataFrame, n: Normaliser) -> DataFrame:
    """One row: examples, by side, and the share of encoded elements at a bound."""
    at = F.exists("action_encoded", lambda x: F.abs(x) >= 1.0 - 1e-12)
    on = F.size(F.filter(F.slice("action_encoded", 1, n.dims), lambda x: F.abs(x) >= 1.0 - 1e-12))
    return rows.agg(F.count("*").alias("n_examples"), *[tally(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")], (F.coalesce(F.sum(on), F.lit(0)) / F.greatest(F.count("*") * n.dims, F.lit(1))).alias("clip_fraction"), tally(at).alias("n_at_bounds"))


def diverse_rows(rows: DataFrame, n: int = 6) -> DataFrame:
    """A small batch that covers sides and parts of episodes: the first row of
    each of six (side, part) cells, then others in order until there are n."""
    cells = [c.split(":") for c in "train:early train:middle train:late val:middle test:early test:late".split()]
    placed = rows.withColumn("temporal_position", temporal_position())
    rank = F.row_number().over(Window.partitionBy("split", "temporal_position").orderBy(EPISODE, FRAME))
    want = F.lit(None).cast("int")
    for i, (s, p) in enumerate(cells):
        want = F.when((F.col("split") == s) & (F.col("temporal_position") == p), F.lit(i)).otherwise(want)
    # A row that fills up has fewer than n others before it, and its cell's first:
    # n + 1 rows of a cell are all that can be needed, and no task sorts a cell.
    marked = placed.withColumn("_rank", rank).filter(F.col("_rank") <= n + 1)
    order = F.when(F.col("_rank") == 1, F.coalesce(want, F.lit(len(cells)))).otherwise(len(cells))
    return marked.withColumn("_order", order).orderBy("_order", EPISODE, FRAME).limit(n).drop("_rank", "_order")


def round_trip(rows: DataFrame, vector: Column, n: Normaliser, tolerance: float = 1e-2) -> DataFrame:
    """One row: largest and mean error after encoding and decoding; ok if the
    largest is within the tolerance, or below 1."""
    err = rows.select(F.explode(F.zip_with(vector, n.decode(n.encode(vector)), lambda a, b: F.abs(a - b))).alias("e"))
    return err.agg(F.max("e").alias("max_abs_error"), F.avg("e").alias("mean_abs_error")).withColumn("ok", (F.col("max_abs_error") <= tolerance + 1e-6) | (F.col("max_abs_error") < 1.0))


def collate(rows: DataFrame, size: int) -> DataFrame:
    """Batches of `size` rows in order within each side, as arrays of columns."""
    number = F.floor((F.row_number().over(Window.partitionBy("split").orderBy(EPISODE, FRAME)) - 1) / size)
    item = F.struct(EPISODE, FRAME, "instruction", "action_encoded", "action_mask")
    got = rows.withColumn("batch", number).groupBy("split", "batch").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def each(name: str) -> Column:
        return F.transform("items", lambda x: x[name]).alias(name)

    return got.select("split", "batch", F.size("items").alias("batch_size"), *map(each, ("instruction", "action_encoded", "action_mask")))


def batch_errors(batches: DataFrame, width: int = 7, real: int = 6) -> DataFrame:
    """(split, batch, errors): what is wrong with a batch's shapes."""
    bad_width = F.exists("action_encoded", lambda v: F.size(v) != width)
    bad_mask = F.exists(F.arrays_zip("action_encoded", "action_mask"), lambda x: F.size(x["action_encoded"]) != F.size(x["action_mask"]))
    loose = F.exists("action_mask", lambda m: F.exists(F.slice(m, real + 1, width), lambda x: x != 0)) if width > real else F.lit(False)
    errors = F.array_compact(F.array(F.when(bad_width, "encoded width"), F.when(bad_mask, "mask width"), F.when(loose, "padding not masked"), F.when(F.size("instruction") != F.col("batch_size"), "instructions")))
    return batches.select("split", "batch", errors.alias("errors"))


def manifest_errors(manifest: dict) -> list[str]:
    need = "action_statistics_path curation_policy dataset_repo_id dataset_revision n_examples split".split()
    bad = [f"missing {k}" for k in need if k not in manifest]
    return bad + (["claims a model download"] if manifest.get("model_checkpoint_downloaded") is True else [])
