"""Embedding near-duplicates (operator 7).

Method: every vector is compared with every other, as products of blocks of unit
vectors: first with 24 bits, and in double precision where those can't tell on
which side of the limit a pair is. So all pairs are found, nothing is calibrated,
capped or drawn. Counting collisions on random lines, as the method was, costs more
(see the README) and misses pairs. A task has two blocks of up to `block_rows` vectors.

classes() gives a row for each vec_id: its class, which is what hangs together by
links, and the number of its links. Of a pair of blocks come the sums of links
and only so many links that the same vectors hang together, so the result and
what is moved for it grow with the table, not with the pairs of a class.

Equal vectors are compared as one, which counts as many times as it has ids. pairs()
writes out all pairs instead; the ids of a group of equal vectors are dealt into
slices of about `SLICE`, by their hash, and a task's share is pairs of slices,
so a large group is gathered and written out by many tasks and is never one row.

Edge cases: null, empty and zero vectors, and those with a null or non-finite
element, have no links and are a class of their own; rows without vec_id are left
out; rows that share a vec_id are one item, linked with all that one of its vectors
is near, never with itself; vec_id may be of any type with an order; vectors
of different lengths are compared only within their length; ties in distance
don't matter; an empty table has no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, need, written
from .simhash import components, forest

COSINE = 0.95
#: Vectors in a block, and bytes of a block in double precision, at most.
BLOCK_ROWS, BLOCK_BYTES = 131_072, 64 << 20
#: Vectors whose products are taken at once, of the two blocks.
TILE = 512, 4_096
#: Ids of equal vectors in a row; two rows make up to SLICE ** 2 pairs.
SLICE = 256


def near(a: np.ndarray, b: np.ndarray, cosine: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(i, j, cosine) of the unit vectors whose cosine is at least the limit, by
    tiles; the cosine is None if not exact."""
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    # Bounds the error of a product of unit vectors, rounded and added up in single precision.
    slack = (a.shape[1] + 8) * 2.0**-23
    for lo in range(0, len(a), TILE[0]):
        for at in range(0, len(b), TILE[1]):
            c = fa[lo : lo + TILE[0]] @ fb[at : at + TILE[1]].T
            flat = np.flatnonzero(c >= np.float32(cosine - slack))
            if not len(flat):
                continue
            i, j = np.divmod(flat, c.shape[1])
            c = c.ravel()[flat].astype(np.float64)
            i, j = i + lo, j + at
            open_ = np.arange(len(c)) if exact else np.flatnonzero(c < cosine + slack)
            for s in range(0, len(open_), 100_000):
                o = open_[s : s + 100_000]
                c[o] = np.einsum("ij,ij->i", a[i[o]], b[j[o]])
            ok = c >= cosine
            yield i[ok], j[ok], c[ok] if exact else None


def _blocks(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(keys, unit vectors, rows) of each block in t, one or two."""
    out = []
    for block in np.unique(t["block"].to_numpy()).tolist():
        own = t.filter(pa.array(t["block"].to_numpy() == block))
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in own["e"].chunks]).astype(np.float64).reshape(own.num_rows, -1)
        out.append((own["key"].to_numpy(), x / np.sqrt((x * x).sum(axis=1, keepdims=True)), own))
    return out


def _sides(t: pa.Table, cosine: float, exact: bool):
    """The near vectors in a pair of blocks, each pair once: (blocks, iterator of (i, j, cosine))."""
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    blocks = _blocks(t)
    if lo == hi:
        return blocks * 2, ((i[i < j], j[i < j], c[i < j] if exact else None) for i, j, c in near(blocks[0][1], blocks[0][1], cosine, exact))
    return blocks, near(blocks[0][1], blocks[1][1], cosine, exact) if len(blocks) > 1 else iter(())


def _all_pairs(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        blocks, found = _sides(t, cosine, True)
        parts = [pa.table({"key_a": blocks[0][0][i], "key_b": blocks[1][0][j], "cosine": np.round(c, 6)}) for i, j, c in found]
        return pa.concat_tables([pa.table({"key_a": pa.array([], pa.int64()), "key_b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}), *parts])

    return run


def _sums_and_links(cosine: float):
    """(u, null, links of u to ids of one vector), (u, v, null) of enough links for the
    same vectors to hang together, and (u, v, 0) of all links of vectors that
    have an id of several."""

    def run(t: pa.Table) -> pa.Table:
        blocks, found = _sides(t, cosine, False)
        (ka, _, ra), (kb, _, rb) = blocks[0], blocks[-1]
        wa, wb, oa, ob = (r[c].to_numpy(zero_copy_only=False) for c in ("n", "odd") for r in (ra, rb))
        sa, sb = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
        none = np.zeros(0, np.int64)
        u, v, odd_u, odd_v = [none], [none], [none], [none]
        for i, j, _ in found:
            np.add.at(sa, i, wb[j]), np.add.at(sb, j, wa[i])
            x, y = ka[i], kb[j]
            odd = oa[i] | ob[j]
            odd_u.append(x[odd]), odd_v.append(y[odd])
            x, y = forest(x, y)
            u.append(x), v.append(y)
        u, v = forest(np.concatenate(u), np.concatenate(v))
        odd_u, odd_v = np.concatenate(odd_u), np.concatenate(odd_v)
        ends = [ka[sa > 0], kb[sb > 0]]
        key = np.concatenate([*ends, u, odd_u])
        other = pa.concat_arrays([pa.nulls(sum(map(len, ends)), pa.int64()), pa.array(v), pa.array(odd_v)])
        n = pa.concat_arrays([pa.array(sa[sa > 0]), pa.array(sb[sb > 0]), pa.nulls(len(u), pa.int64()), pa.array(np.zeros(len(odd_u), np.int64))])
        return pa.table([pa.array(key), other, n], names=["u", "v", "n"])

    return run


def _expanded(found: DataFrame, slices: DataFrame) -> DataFrame:
    """(vec_a, vec_b, cosine) of all ids that the pairs of keys stand for, and of
    all pairs of ids of one key. slices: (key, s, ids, several), several: the
    key has more ids than one."""
    # New names' ids, as both sides come from one table.
    a, b = (slices.select(*[F.col(c).alias(f"{c}_{side}") for c in slices.columns]) for side in "ab")
    across = found.join(a, "key_a").join(b, "key_b").select("ids_a", "ids_b", "cosine", F.lit(False).alias("own"))
    own = a.filter("several_a").join(b.filter("several_b"), (F.col("key_a") == F.col("key_b")) & (F.col("s_a") <= F.col("s_b"))).select("ids_a", "ids_b", F.lit(1.0).alias("cosine"), (F.col("s_a") == F.col("s_b")).alias("own"))
    # Dealt out before the ids are multiplied: the number given isn't made less by size in bytes.
    dealt = across.unionByName(own).repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = dealt.select(F.explode("ids_a").alias("a"), "ids_b", "cosine", "own").select("a", F.explode("ids_b").alias("b"), "cosine", "own")
    return ids.filter("a < b or a > b and not own").select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"), "cosine")


def _vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((vec_id, key) of the vectors that have a direction, (key, e, ids)). The rows of
    one vec_id may have several vectors, so a vector gets a key of its own."""
    df = need(df, "vec_id", "embedding")
    e = F.col("embedding").cast("array<float>" if kind(df, "embedding") == "array<float>" else "array<double>")
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    given = df.select("vec_id", e.alias("e")).filter("vec_id is not null and size(e) > 0").filter((square > 0) & (square < float("inf"))).distinct()
    keys = written(given.groupBy("e").agg(F.count("*").alias("ids")).withColumn("key", F.monotonically_increasing_id()), "embedding-distinct")
    return written(given.join(keys.select("e", "key", "ids"), "e").select("vec_id", "key", "ids"), "embedding-ids"), keys


def _block_pairs(keys: DataFrame, block_rows: int) -> DataFrame:
    """keys, with dim and block, in each pair (lo, hi) of blocks that holds its own."""
    spark = keys.sparkSession
    keys = keys.withColumn("dim", F.size("e"))
    # At least so many blocks that their pairs keep the partitions busy.
    least = 1 + int(np.ceil(np.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    sizes = [(r["dim"], r["n"]) for r in keys.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    counts = [(d, max(-(-n // max(1, min(block_rows, BLOCK_BYTES // (8 * d)))), min(least, -(-n // 1_024)))) for d, n in sizes]
    blocks = spark.createDataFrame(counts, "d int, blocks int")
    own = keys.join(blocks, F.col("dim") == F.col("d")).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # Dealt out by number, as small pairs would else be put into one task.
    dealt = max(1, min(10_000, sum(2 * b * (b + 1) for _, b in counts)))
    return own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o")).drop("blocks", "d", "o").repartition(dealt, "dim", "lo", "hi")


def pairs(df: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b: pairs whose cosine is at least the limit."""
    placed, keys = _vectors(df)
    slices = written(placed.withColumn("several", F.col("ids") > 1).groupBy("key", "several", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("ids") / SLICE)).cast("int").alias("s")).agg(F.collect_list("vec_id").alias("ids")), "embedding-copies")
    found = _block_pairs(keys.select("key", "e"), block_rows).groupBy("dim", "lo", "hi").applyInArrow(_all_pairs(cosine), "key_a long, key_b long, cosine double")
    return _expanded(found, slices).groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def classes(df: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, class_id, class_size, links) of every vec_id. Two are linked if the
    cosine of their vectors is at least the limit; a class is what hangs together by
    links, class_id its least vec_id; links: with how many others it is linked."""
    placed, keys = _vectors(df)
    many = placed.groupBy(F.col("vec_id").alias("_id")).agg(F.count("*").alias("c"), F.min("key").alias("first")).filter("c > 1")
    marked = placed.join(many, F.col("vec_id") == F.col("_id"), "left").select("vec_id", "key", F.col("c").isNotNull().alias("odd"), "first")
    marked = written(marked, "embedding-marked")
    weights = marked.groupBy("key").agg(F.count(F.when(~F.col("odd"), 1)).alias("n"), F.max("odd").alias("odd"))
    compared = _block_pairs(keys.select("key", "e").join(weights, "key"), block_rows).groupBy("dim", "lo", "hi")
    found = written(compared.applyInArrow(_sums_and_links(cosine), "u long, v long, n long"), "embedding-links")
    sums = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("near"))
    # The vectors of one vec_id are in one class, too.
    own = marked.filter("odd and key <> first").select(F.col("first").alias("u"), F.col("key").alias("v"))
    edges = written(found.filter("v is not null and n is null").select("u", "v").unionByName(own).distinct(), "embedding-edges")
    roots = components(edges)
    named = marked.join(roots, F.col("key") == F.col("node"), "left").join(weights.select("key", F.col("n").alias("copies")), "key").join(sums, "key", "left")
    rows = written(named.select("vec_id", F.coalesce("root", "key").alias("root"), "odd", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("plain")), "embedding-rows")
    least = rows.groupBy("root").agg(F.min("vec_id").alias("class_id"), F.count_distinct("vec_id").alias("class_size"))
    # Ids of several vectors may be near another by more than one: their links are told apart by id.
    near_keys = found.filter("n = 0 and v is not null").select("u", "v")
    near_keys = near_keys.unionByName(near_keys.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(marked.filter("odd").select(F.col("key").alias("u"), F.col("key").alias("v"))).distinct()
    left, right = marked.filter("odd").select(F.col("vec_id").alias("o"), F.col("key").alias("u")), marked.select(F.col("vec_id").alias("x"), F.col("key").alias("v"), F.col("odd").alias("x_odd"))
    told = written(near_keys.join(left, "u").join(right, "v").filter("o <> x").select("o", "x", "x_odd").distinct(), "embedding-told")
    extra = told.groupBy(F.col("o").alias("i")).count().unionByName(told.filter("not x_odd").groupBy(F.col("x").alias("i")).count())
    linked = rows.join(least, "root").groupBy("vec_id", "class_id", "class_size").agg(F.sum(F.when(~F.col("odd"), F.col("plain")).otherwise(0)).alias("plain"))
    linked = linked.join(extra, F.col("vec_id") == F.col("i"), "left").select("vec_id", "class_id", "class_size", (F.col("plain") + F.coalesce("count", F.lit(0))).alias("links"))
    alone = need(df, "vec_id").filter("vec_id is not null").distinct().join(placed.select(F.col("vec_id").alias("_id")), F.col("vec_id") == F.col("_id"), "left_anti")
    return linked.unionByName(alone.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links")))
