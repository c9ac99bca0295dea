"""Grouped splits: whole episodes go to one side. The tables are as long as
there are episodes; their order comes from a seeded draw on the driver, so it
doesn't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EPISODE


def split_of(groups: Sequence[int], shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> dict[str, list[int]]:
    """train, val and test: groups shuffled and cut by the rounded shares of
    train and val; test gets the rest, one group at least, at val's cost. Raises
    if the groups don't suffice."""
    order = sorted({int(g) for g in groups})
    n = len(order)
    n_train, n_val = round(n * shares[0]), round(n * shares[1])
    if n < 3 or n_train >= n:
        raise ValueError(f"{n} groups can't be split by {shares}")
    np.random.default_rng(seed).shuffle(order)
    n_val = min(n_val, n - n_train - 1)
    return {"train": order[:n_train], "val": order[n_train : n_train + n_val], "test": order[n_train + n_val :]}


def split_table(spark: SparkSession, split: dict[str, list[int]]) -> DataFrame:
    return spark.createDataFrame([(e, s) for s, es in split.items() for e in es], f"{EPISODE} long, split string")


def with_split(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows of the episodes that have a side. Spark broadcasts the table below
    its limit and shuffles it beyond."""
    return rows.join(split, EPISODE)


def leakage(split: DataFrame) -> DataFrame:
    """Episodes on more than one side; empty if the split is sound."""
    return split.groupBy(EPISODE).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")
