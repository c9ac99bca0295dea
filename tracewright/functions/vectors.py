"""Vector columns: array<double> expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import clip


def as_vector(df: DataFrame, name: str) -> Column:
    """A vector of doubles; a scalar column becomes a vector of one."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name).cast("array<double>")
    return F.array(F.col(name).cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def pick(v: Column, dims: Sequence[int]) -> Column:
    return F.array(*[F.get(v, F.lit(d)) for d in dims])


def without(v: Column, dims: Sequence[int]) -> Column:
    return F.filter(v, lambda _, i: ~i.isin(*dims)) if dims else v


def pad(v: Column, width: int) -> Column:
    """Zeros at the end, up to the width."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def mask(width: int, real: int) -> Column:
    """1 for the real elements, 0 for the padding."""
    return F.array(*[F.lit(1.0 if i < real else 0.0) for i in range(width)])


def mean_square(a: Column, b: Column) -> Column:
    """Over the elements both have; null if there are none."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / F.nullif(n, F.lit(0)))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def normalise(v: Column, low: Column, high: Column, eps: float = 1e-6) -> Column:
    """To about [-1, 1] by each element's bounds, unclipped."""
    return F.zip_with(F.zip_with(v, low, lambda x, lo: x - lo), F.zip_with(high, low, lambda h, lo: h - lo + eps), lambda x, span: 2.0 * x / span - 1.0)


def clipped(v: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.transform(v, lambda x: clip(x, low, high))


def restore(v: Column, low: Column, high: Column, eps: float = 1e-6) -> Column:
    """normalise() backwards, on as many elements as there are bounds."""
    v = F.slice(v, 1, F.size(low))
    spans = F.zip_with(high, low, lambda h, lo: h - lo + eps)
    return F.zip_with(F.zip_with(v, spans, lambda x, s: (x + 1.0) * 0.5 * s), low, lambda x, lo: x + lo)


def long_form(df: DataFrame, vector: Column, keep: Sequence[str] = (), dim: str = "dim", value: str = "value") -> DataFrame:
    """A row for each element."""
    return df.select(*keep, F.posexplode(vector).alias(dim, value))
