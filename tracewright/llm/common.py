"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local
    session may go without; it gets a temporary folder of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tracewright-"))
    return f"file://{_own_dir[0]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for a block; dots are written as double underscores."""
    before = {}
    for k, v in conf.items():
        key = k.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for key, v in before.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and
    outlives any executor. Its shuffle files go once it is written, the table
    when the driver ends (or by drop)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}-{name}"
    schema = df.schema
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tracewright_path = path
    _tables.append((spark, path))
    return out


_tables: list[tuple[SparkSession, str]] = []


def drop(df: DataFrame) -> None:
    """Removes what written() made; df can't be read any more."""
    path = df._tracewright_path
    remove(df.sparkSession, path)
    _tables[:] = [x for x in _tables if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session may have ended already
            pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """df with every other column than the named ones (of those spelt alike the
    first) called by its place, so that no name clashes, holds a dot or differs
    from another by case only. toDF(*df.columns) gives the names back."""
    left = set(names)
    out = []
    for i, n in enumerate(df.columns):
        out.append(n if n in left else f"__tw{i}")
        left.discard(n)
    if left:
        raise ValueError(f"columns {sorted(left)} are missing")
    return df.toDF(*out)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others can't clash with what is added."""
    return renamed(df, *names).select(*names)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns of exactly these names."""
    kept = [i for i, n in enumerate(df.columns) if n not in names]
    plain = df.toDF(*[f"__tw{i}" for i in range(len(df.columns))])
    return plain.select(*[f"__tw{i}" for i in kept]).toDF(*[df.columns[i] for i in kept]) if len(kept) < len(df.columns) else df


def kind(df: DataFrame, name: str) -> str:
    """The named column's type, as in a schema string: ids of any type are kept as they are."""
    return next(f for f in df.schema.fields if f.name == name).dataType.simpleString()
