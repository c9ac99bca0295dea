"""SimHash near-duplicates (operator 1).

Method: generalised pigeonhole. A document's fingerprint has 128 bits: a probe
word and a second word of 64. Bits of the probe word that correlate over the
corpus are grouped into m partitions; a threshold vector (t_1 .. t_m) with
sum(t_i + 1) = tau + 1 is chosen by dynamic programming, so that any two probe
words within tau bits are within t_i on some partition i; unequal thresholds
(-1: the partition isn't probed) go where the estimated number of candidates
and probes is least. m is the cheapest of a few. For t_i each fingerprint emits a
ball around its bits, of radius ceil(t_i / 2), marked up to floor(t_i / 2); balls of
two within t_i meet at a place that is marked for one of them. All that meet so
are compared, in numpy, and are near if within tau on the probe word and within
tau_all on all 128 bits. No bucket is capped. As groups are all that is asked
for, a place with many near ones is followed until its group is whole, and its
members aren't compared with one another: a group of different near copies
costs its size times the rest of the bucket, not the square of its size.

Features are the distinct words, weighted by their length in bytes, so that
short words, which most texts share, say little. A run of more than 12 bytes
counts by all its windows of 12 (so does a text of a script without spaces),
and a text without a letter or digit is one feature as a whole. Equal
fingerprints are merged before the search, so exact copies cost nothing. Groups
are connected components of the pairs, by repeated contraction to a neighbour
of random rank, which takes rounds by the logarithm of the longest chain.

Edge cases: a null text, and one of white space only, is in no group; a row
with a null doc_id isn't either (and stays); rows that share a doc_id are one
document, near anything that one of its texts is near, and keep_one() keeps the
different texts of a document that stays; ties (equal fingerprints) are copies;
the least doc_id of a group is kept; doc_id may be of any type with an order; an
empty table gives no groups; other columns, whatever their names, are carried
along. A very long text takes some 60 bytes of a task's memory for each of its
own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, kind, need, renamed, written
from .textcodes import U8, Grams, mix

BITS = 64
#: Differing bits allowed on the probe word, and on both words.
TAU, TAU_ALL = 10, 20
PARTITIONS = (2, 3, 4, 5, 6)
#: Cost of verifying a candidate, in emitted probes.
VERIFY = 0.01
#: Probes in a part, as a rule; probes made, and pairs compared, in one array.
PART_ROWS, PROBES_AT_ONCE, PAIRS_AT_ONCE = 1_000_000, 500_000, 1 << 16
#: Buckets of fewer than twice SMALL probes are compared together; in those of LARGE
#: and more, PIVOTS places are tried for a group of MANY.
SMALL, LARGE, PIVOTS, MANY = 16, 512, 16, 64


def bit_counts(keys: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each run of keys (64 bits) the weight of those that have each bit, least first."""
    bits = np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits *= weight[:, None]
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def fingerprints_of(column: pa.Array, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have features, probe words, second words)."""
    rows, first, second = [], [], []
    for a, _, row, code, length in grams(column):
        if not len(row):
            continue
        # Features of a row, sorted and distinct: 20 bits of the row, 40 of the code, 4 of the weight.
        key = np.unique((row.astype(U8) << U8(44)) | (code >> U8(24) << U8(4)) | length.astype(U8))
        own = (key >> U8(44)).astype(np.int64)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        weight = (key & U8(15)).astype(np.uint8)
        total = np.add.reduceat(weight, starts, dtype=np.int64)[:, None]
        key = (key >> U8(4)) & U8((1 << 40) - 1)
        rows.append(own[starts] + a)
        for out, salt in ((first, 0x5851F42D4C957F2D), (second, 0x14057B7EF767814F)):
            out.append(packed(2 * bit_counts(mix(key ^ U8(salt)), starts, weight) > total))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(rows), np.concatenate(first), np.concatenate(second)


def _fingerprinter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        rows, a, b = fingerprints_of(batch.column(1), grams)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(a), pa.array(b)], names=["doc_id", "a", "b"])


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, a, b) of the rows that have a doc_id and features."""
    rows = need(df, "doc_id", "text").select("doc_id", F.lower("text").alias("text")).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(_fingerprinter, f"doc_id {kind(df, 'doc_id')}, a long, b long")


def _bit_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        a = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.unpackbits(a.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += x.T @ x
        n += len(a)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()])], names=["n", "both"])


def bit_stats(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how many have both bits i and j)."""
    rows = distinct.select("a").mapInArrow(_bit_stats, "n long, both array<double>").select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in rows:
        both[r["pos"]], n = r["s"], r["n"]
    return n, both.reshape(BITS, BITS)


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m partitions of nearly equal size; each begins with the most
    correlated pair left and takes the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, out))) // (m - i)
        rest = sorted(left)
        sub = corr[np.ix_(rest, rest)]
        own = [rest[int(sub.max(axis=1).argmax())]]
        while len(own) < size:
            rest = sorted(left - set(own))
            own.append(rest[int(corr[np.ix_(rest, own)].mean(axis=1).argmax())])
        left -= set(own)
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def within(p: np.ndarray) -> np.ndarray:
    """P(at most r of independent bits differ between two), r = 0 .. len(p)."""
    d = np.ones(1)
    for q in 2 * p * (1 - p):
        d = np.append(d * (1 - q), 0) + np.insert(d * q, 0, 0)
    return np.cumsum(d)


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 of the least total cost;
    cost[i][t + 1] is that of t on partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t1, x in enumerate(own):
                if used + t1 <= tau + 1 and (used + t1 not in new or c + x < new[used + t1][0]):
                    new[used + t1] = (c + x, [*ts, t1 - 1])
        best = new
    return best[tau + 1]


def plan(distinct: DataFrame, tau: int = TAU, partitions: tuple[int, ...] = PARTITIONS, verify: float = VERIFY) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe. Candidates of a threshold:
    pairs expected if bits were independent, scaled by how many pairs in fact
    agree on all bits of the partition (counted over the whole table)."""
    n, both = bit_stats(distinct)
    if n < 2:
        return []
    p = np.diag(both) / n
    choices = [grouped(n, both, m) for m in partitions]
    every = [bits for groups in choices for bits in groups]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("a").bitwiseAND(F.lit(mask_of(bits))).alias("v")) for i, bits in enumerate(every)]))
    equal = {r["i"]: r["s"] for r in distinct.select(keys.alias("k")).groupBy("k").count().groupBy("k.i").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("s")).collect()}
    options, at = [], 0
    for groups in choices:
        cost = []
        for bits in groups:
            model = within(p[bits])
            pairs = n * (n - 1) / 2
            scale = max(1.0, equal.get(at, 0.0) / max(pairs * model[0], 1e-9))
            at += 1
            # What agrees on all bits agrees within any radius: the excess over independence is added once.
            excess = (scale - 1) * pairs * model[0]
            cost.append([0.0] + [n * ball(len(bits), -(-t // 2)) + verify * (pairs * model[t] + excess) * ball(t, t // 2) for t in range(min(tau, len(bits) - 1) + 1)])
        total, ts = allocate(cost, tau)
        options.append((total, [(b, t) for b, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def mask_of(bits: tuple[int, ...] | list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def flips(bits: list[int], radius: int) -> list[int]:
    return [mask_of(c) for r in range(radius + 1) for c in combinations(bits, r)]


def _places(a: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition as one number of up to 32 bits."""
    out = np.zeros(len(a), np.uint32)
    for i, x in enumerate(bits):
        out |= ((a >> U8(x)) & U8(1)).astype(np.uint32) << np.uint32(i)
    return out


#: A probe: its place in the partition, and the fingerprint.
PROBE = np.dtype([("k", "<u4"), ("a", "<u8"), ("b", "<u8")])


def _probes(thresholds: list[tuple[list[int], int]], parts: list[int]):
    """(a, b) to (part, inner, data): the places of the outer ball around each
    fingerprint, as arrays by part; inner: those of the smaller radius."""
    balls = [_places(np.array(flips(bits, -(-t // 2)), dtype=np.int64).view(U8), bits) for bits, t in thresholds]
    inner = [ball(len(bits), t // 2) for bits, t in thresholds]
    first = np.cumsum([0, *parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False).view(U8) for c in batch.columns)
            for i, (bits, _) in enumerate(thresholds):
                own = _places(a, bits)
                for near, flip in ((True, balls[i][: inner[i]]), (False, balls[i][inner[i] :])):
                    step = max(1, PROBES_AT_ONCE // max(1, len(flip)))
                    for lo in range(0, len(a) if len(flip) else 0, step):
                        k = (own[lo : lo + step, None] ^ flip).ravel()
                        part = ((k * np.uint32(2_654_435_761)) >> np.uint32(12)) % np.uint32(parts[i])
                        order = np.argsort(part.astype(np.uint16) if parts[i] < 1 << 16 else part, kind="stable")
                        row = order // len(flip) + lo
                        data = np.empty(len(k), PROBE)
                        data["k"], data["a"], data["b"] = k[order], a[row], b[row]
                        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts[i]))])
                        blobs = pa.Array.from_buffers(pa.binary(), parts[i], [None, pa.py_buffer((ends * PROBE.itemsize).astype(np.int32)), pa.py_buffer(data)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts[i], dtype=np.int32) + np.int32(first[i])), pa.array(np.full(parts[i], near)), blobs], names=["part", "inner", "data"]).filter(pa.array(np.diff(ends) > 0))

    return run


def close(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, tau: int, tau_all: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), places in rows and in columns, of all that are within both limits."""
    i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ a[columns]) <= tau)
    x, y = rows[i], columns[j]
    # The sum of two counts of up to 64 fits a byte.
    ok = np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y]) <= tau_all
    return i[ok], j[ok]


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node that it hangs together with."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = flat[: len(i)], flat[len(i) :]
    root = np.arange(len(nodes))
    while (u := root[x] != root[y]).any():
        low, high = np.minimum(root[x[u]], root[y[u]]), np.maximum(root[x[u]], root[y[u]])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def whole_groups(a: np.ndarray, b: np.ndarray, tau: int, tau_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(those left, u, v) of a large bucket: of some of its places, those with
    many near ones, the group is followed to its end, each member being compared
    with all that aren't in it. Nothing left is near a member then."""
    left, us, vs = np.arange(len(a)), [], []
    for pivot in np.linspace(0, len(a) - 1, PIVOTS).astype(int):
        if left[min(np.searchsorted(left, pivot), len(left) - 1)] != pivot:
            continue
        near = left[close(a, b, np.array([pivot]), left, tau, tau_all)[1]]
        if len(near) < MANY:
            continue
        group, front = [near], [near]
        left = np.setdiff1d(left, near, assume_unique=True)
        while front and len(left):
            own, front = np.concatenate(front), []
            step = max(1, PAIRS_AT_ONCE // len(left))
            for lo in range(0, len(own), step):
                new = left[np.unique(close(a, b, own[lo : lo + step], left, tau, tau_all)[1])]
                if len(new):
                    group.append(new), front.append(new)
                    left = np.setdiff1d(left, new, assume_unique=True)
        group = np.concatenate(group)
        root = group[np.lexsort((b[group], a[group]))[0]]
        us.append(np.full(len(group) - 1, root)), vs.append(group[group != root])
        if not len(left):
            break
    none = np.zeros(0, np.int64)
    return left, np.concatenate([none, *us]), np.concatenate([none, *vs])


def bucket_links(k: np.ndarray, inner: np.ndarray, a: np.ndarray, b: np.ndarray, tau: int, tau_all: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all near probes that share a place, at least one being inner; not
    every: only so many that the same probes hang together."""
    order = np.lexsort((~inner, k))
    k, inner = k[order], inner[order]
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k)))
    some = np.add.reduceat(inner, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 2
    while at <= SMALL:  # buckets of at to 2 at - 1 probes together, each probe with the n-th after it
        of = (sizes >= at) & (sizes < 2 * at) & (some > 0)
        rows = np.flatnonzero(np.repeat(of, sizes))
        for n in range(1, 2 * at - 1 if len(rows) else 0):
            x, y = rows[:-n], rows[n:]
            ok = np.flatnonzero((k[x] == k[y]) & inner[x] & (np.bitwise_count(a[x] ^ a[y]) <= tau))
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y]) <= tau_all
            us.append(x[ok]), vs.append(y[ok])
        at *= 2
    for s, q, n in zip(*(c[(sizes >= at) & (some > 0)].tolist() for c in (starts, sizes, some)), strict=True):
        oa, ob, left, mine = a[s : s + q], b[s : s + q], None, ([], [])
        if not every and q >= LARGE:
            left, u, v = whole_groups(oa, ob, tau, tau_all)
            us.append(u + s), vs.append(v + s)
            oa, ob, n = oa[left], ob[left], int((left < n).sum())
        step = max(1, PAIRS_AT_ONCE // q)
        for lo in range(0, n, step):
            i, j = close(oa, ob, np.arange(lo, min(lo + step, n)), np.arange(lo, len(oa)), tau, tau_all)
            ok = i < j
            mine[0].append(i[ok] + lo), mine[1].append(j[ok] + lo)
        if not mine[0]:
            continue
        i, j = map(np.concatenate, mine)
        if not every and len(i) > q:
            i, j = forest(i, j)
        if left is not None:
            i, j = left[i], left[j]
        us.append(i + s), vs.append(j + s)
    return order[np.concatenate(us)], order[np.concatenate(vs)]


def _meeting(tau: int, tau_all: int, every: bool):
    def run(t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), PROBE) for x in t["data"]]
        inner = np.repeat(t["inner"].to_numpy(), [len(x) for x in blobs])
        data = np.concatenate(blobs)
        k, a, b = (np.ascontiguousarray(data[c]) for c in "kab")
        i, j = bucket_links(k, inner, a, b, tau, tau_all, every)
        first = (a[i] < a[j]) | (a[i] == a[j]) & (b[i] <= b[j])
        i, j = np.where(first, i, j), np.where(first, j, i)
        found = np.unique(np.stack([a[i], b[i], a[j], b[j]], axis=1), axis=0).view(np.int64)
        return pa.table([pa.array(c) for c in found.T], names=["la", "lb", "ra", "rb"])

    return run


def near_pairs(distinct: DataFrame, thresholds: list[tuple[list[int], int]], tau: int = TAU, tau_all: int = TAU_ALL, every: bool = True) -> DataFrame:
    """(u, v), u < v: reps whose fingerprints are within both limits, each once;
    not every: of them (and of reps that hang together through them) so many that
    the same reps hang together. distinct: (rep, a, b). Probes travel as arrays by part,
    parts being ranges of places by hash, and are compared in numpy."""
    spark = distinct.sparkSession
    if not thresholds:
        return spark.createDataFrame([], f"u {kind(distinct, 'rep')}, v {kind(distinct, 'rep')}")
    n, least = distinct.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [n * ball(len(bits), -(-t // 2)) for bits, t in thresholds]
    parts = [max(1, -(-x // PART_ROWS), round(least * x / max(1, sum(sizes)))) for x in sizes]
    probes = distinct.select("a", "b").mapInArrow(_probes(thresholds, parts), "part int, inner boolean, data binary")
    found = probes.groupBy("part").applyInArrow(_meeting(tau, tau_all, every), "la long, lb long, ra long, rb long").distinct()
    left_rep, right_rep = (distinct.select(F.col("a").alias(f"{s}a"), F.col("b").alias(f"{s}b"), F.col("rep").alias(f"{s}rep")) for s in "lr")
    named = found.join(left_rep, ["la", "lb"]).join(right_rep, ["ra", "rb"]).filter("lrep <> rrep")
    # Of equal fingerprints each pair comes in both orders.
    same = (F.col("la") == F.col("ra")) & (F.col("lb") == F.col("rb"))
    return named.filter(~same | (F.col("lrep") < F.col("rrep"))).select(F.least("lrep", "rrep").alias("u"), F.greatest("lrep", "rrep").alias("v"))


def components(pairs: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) of all nodes of the pairs; root is the least node reached.
    Each round maps a node to that of its neighbours (or itself) which has the
    least rank, drawn anew each round, and contracts the graph. On a chain, in
    whatever order, that leaves about half of the nodes. rounds: gets how many
    edges each round left."""
    edges = pairs
    maps: list[DataFrame] = []
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.least(F.min(rank("v")), F.first(rank("u")))["to"].alias("r")), "components-map")
        maps.append(to)
        f, g = to.select(F.col("u"), F.col("r").alias("ru")), to.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        left = written(edges.join(f, "u").join(g, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "components-edges")
        if edges is not pairs:
            drop(edges)
        edges = left
        n = edges.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
    drop(edges)
    out = maps[0].select(F.col("u").alias("node"), F.col("r").alias("root"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("u").alias("root"), F.col("r").alias("_r")), "root", "left").select("node", F.coalesce("_r", "root").alias("root"))
    out = written(out, "components-roots")
    for m in maps:
        drop(m)
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    return out.join(least, "root").select("node", F.col("least").alias("root"))


def groups(df: DataFrame, tau: int = TAU, tau_all: int = TAU_ALL) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of the documents that are in a group
    of two or more; group_id is the least doc_id, the one to keep."""
    prints = written(fingerprints(df), "simhash-prints")
    by = Window.partitionBy("a", "b")
    distinct = written(prints.groupBy("a", "b").agg(F.min("doc_id").alias("rep")).select("rep", "a", "b"), "simhash-distinct")
    found = written(near_pairs(distinct, plan(distinct, tau), tau, tau_all, every=False), "simhash-pairs")
    copies = prints.select("doc_id", F.min("doc_id").over(by).alias("rep"))
    # A rep with several fingerprints (rows that share a doc_id) joins them all.
    links = written(copies.filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).unionByName(found.filter("u <> v")).distinct(), "simhash-links")
    for t in (prints, distinct, found):
        drop(t)
    own = written(components(links), "simhash-components")
    drop(links)
    sized = own.withColumn("group_size", F.count("*").over(Window.partitionBy("root")))
    return sized.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), "group_size", (F.col("node") == F.col("root")).alias("keep"))


def keep_one(df: DataFrame, tau: int = TAU, tau_all: int = TAU_ALL) -> DataFrame:
    """df without the documents that groups() doesn't keep, all columns; of rows
    that share doc_id and text one stays (the first by the other columns)."""
    names, df = df.columns, renamed(df, "doc_id", "text")
    gone = written(groups(df, tau, tau_all).filter("not keep").select(F.col("doc_id").alias("_gone")), "simhash-gone")
    left = df.join(gone, df["doc_id"] == gone["_gone"], "left_anti")
    repeated = written(df.filter("doc_id is not null").groupBy(df["doc_id"].alias("_again")).count().filter("count > 1").select("_again"), "simhash-repeated")
    if repeated.isEmpty():
        return left.toDF(*names)
    once = left.join(repeated, left["doc_id"] == repeated["_again"], "left_anti")
    order = [F.col(c).cast("string") for c in df.columns if c not in ("text", "doc_id")] or [F.lit(0)]
    again = left.join(repeated, left["doc_id"] == repeated["_again"], "left_semi").withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order))).filter("_rank = 1").drop("_rank")
    return once.unionByName(again).toDF(*names)
