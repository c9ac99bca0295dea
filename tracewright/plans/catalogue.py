"""Named queries, each with its SQL where SQL can express it.

Doubles are rounded to 6 places on both sides, since sums depend on order; NaN
becomes null; whole numbers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite
from ..model import as_trajectory

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EPOCH = "2024-01-01"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for x in df.schema.fields:
        c = F.col(f"`{x.name}`")
        if isinstance(x.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(finite(c.cast("double")), 6)
        elif isinstance(x.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(x.name))
    return df.select(*out)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as trajectories: v and k are scalar channels, state and
    action the vectors of one element made of them."""
    df = read(spark, sf_dir, "events")
    seconds = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts) / 1e6")
    v, k = F.col("value").cast("double"), F.get_json_object("props", "$.k").cast("double")
    return as_trajectory(df, "user_id", ["ts", "event_id"], seconds, v=v, k=k, kind=F.col("event_type"), state=F.array(v), action=F.array(k))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as a trajectory; frame numbers have gaps."""
    return as_trajectory(read(spark, sf_dir, "embeddings"), "label", [], frame=F.col("vec_id"), x=F.col("embedding").cast("array<double>"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_trajectory(read(spark, sf_dir, "conversations"), "conv_id", [], seconds=F.col("turn") / 2.0, frame=F.col("turn"), role=F.col("role"), size=F.length("text").cast("double"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return labels.join(docs, "doc_id").select("doc_id", "source", "y", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"))


TRAJ = f"""traj AS (
    SELECT user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
           date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) / 1e6 AS t, value AS v, CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS k, event_type AS kind
    FROM events)"""
LONG = "long AS (SELECT label AS episode_index, vec_id AS frame_index, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
SCORED = "scored AS (SELECT l.doc_id, d.source, l.quality AS y, d.n_chars / (d.n_chars + 2000.0) AS score FROM labels AS l JOIN documents AS d USING (doc_id))"
W = "PARTITION BY episode_index ORDER BY frame_index"
