"""Benchmark decontamination (operator 2).

Method: pigeonhole edit matching. A test item of m characters with a budget of
k edits is split into k + 1 pieces; a passage within k edits has one of them
unchanged. Aho-Corasick finds all exact piece hits in a text; each gives a
window that must hold the item, and Myers' bit-parallel algorithm finds the
least edit distance of the item to any part of that window.

Texts and items are compared in lower case with every run of other characters
than letters and digits as one space, and a space before and after, so that an
item is matched by whole words. The budget is `rate` of the item's length. An
item of fewer than `whole_chars` characters is no evidence inside a longer text:
it matches a text that is, within its budget, that item and nothing else.

Items are cut into slices of about `slice_chars` characters, an automaton each,
so what a task holds of them is bounded. Up to `pass_chars` characters of slices
take one pass over the texts: a task reads its texts in groups of `group_chars`
and goes through the slices for each, so the number of scans grows only with
benchmarks of many times that size.

Edge cases: null and empty texts or items, and items without a letter or digit,
match nothing; items with the same text each match by themselves; repeated rows
of either side give repeated results only once (results are distinct); of ties
the least distance counts; a null item_id or doc_id is reported as null, and ids
may be of any type; empty tables give no result; other columns, whatever their
names, are ignored by find() and kept by keep_clean(). A very long text is
matched whole; a task holds it once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop, kind, need, renamed, written

RATE = 0.08
#: Shorter items match only texts that consist of them.
WHOLE_CHARS = 20
#: Characters of items in one automaton: some 30 MB of it.
SLICE_CHARS = 300_000
#: Characters of items that one pass over the texts takes: what is sent to a task.
PASS_CHARS = 20_000_000
#: Characters of texts that a task holds while it goes through the slices.
GROUP_CHARS = 16_000_000
NORM = "__tracewright_norm"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def budget_of(m: int, rate: float = RATE) -> int:
    return int(m * rate)


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of lengths that differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def peq_of(item: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of text nearest to the item, the first of
    equals; None if it is further than `most`."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if d < best:
            best, at = d, j + 1
            if not d:
                break
    return (best, at) if best <= most else None


def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance of two whole texts, None beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] if row[-1] <= most else None


class Slice:
    """An automaton of the pieces of some items. Items are normalised."""

    def __init__(self, items: list[str], rate: float, whole_chars: int):
        import ahocorasick

        self.items = [f" {item} " for item in items]
        self.budgets = [budget_of(len(item), rate) for item in items]
        self.whole = [len(item) < whole_chars for item in items]
        self.peqs = [peq_of(item) for item in self.items]
        self.found = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (item, k) in enumerate(zip(self.items, self.budgets, strict=True)):
            for offset, piece in pieces_of(item, k):
                by_piece.setdefault(piece, []).append((n, offset))
        for piece, where in by_piece.items():
            self.found.add_word(piece, (len(piece), where))
        self.found.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Least distances by item. text: normalised, with a space at both ends."""
        spans: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.found.iter(text):
            for n, offset in where:
                start = last - size + 1 - offset
                lo, hi = start - self.budgets[n], start + len(self.items[n]) + self.budgets[n]
                own = spans.setdefault(n, [])
                # Hits come in order of their ends; windows that overlap by far most become one.
                if own and lo <= own[-1][1] and hi - own[-1][0] <= 2 * (hi - lo):
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out: dict[int, int] = {}
        for n, windows in spans.items():
            item, most = self.items[n], self.budgets[n]
            if self.whole[n]:
                if (d := edits(item, text, most)) is not None:
                    out[n] = d
                continue
            if item in text:
                out[n] = 0
                continue
            for lo, hi in windows:
                if (hit := myers(self.peqs[n], len(item), text[max(lo, 0) : hi], most)) and hit[0] < out.get(n, most + 1):
                    out[n] = hit[0]
        return out


def _groups(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until their texts (the last column) have so many bytes."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.column(b.num_columns - 1).nbytes
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _matcher(sent, rate: float, whole_chars: int, group_chars: int, item_type: pa.DataType, pairs: bool):
    """sent: a broadcast of slices, each a list of (item_id, text). The texts are
    the last column. Results are pairs, or the rows whose texts match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = sent.value
        # A slice alone is built once, several are built anew for each group: one automaton is held at a time.
        built = lru_cache(maxsize=1)(lambda i: Slice([t for _, t in slices[i]], rate, whole_chars))
        for group in _groups(batches, group_chars):
            clean = [[True] * b.num_rows for b in group]
            for i, items in enumerate(slices):
                own = built(i)
                for k, b in enumerate(group):
                    found = []
                    for row, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                        if t and (pairs or clean[k][row]):
                            hits = own.matches(f" {t} ")
                            if hits:
                                clean[k][row] = False
                            if pairs:
                                found += [(row, items[n][0], d, len(items[n][1])) for n, d in hits.items()]
                    if found:
                        ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], item_type), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], names=["doc_id", "item_id", "distance", "item_chars"])
            if not pairs:
                for b, keep in zip(group, clean, strict=True):
                    yield b.select(range(b.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    return run


def _passes(benchmark: DataFrame, slice_chars: int, pass_chars: int) -> Iterator[list[list[tuple[object, str]]]]:
    """The slices of one pass at a time, each collected by itself. A slice is of
    items by a hash of the text; how many there are follows from the total."""
    items = written(need(benchmark, "item_id", "text").select("item_id", normalised(F.col("text")).alias("text")).filter("text <> ''").dropDuplicates(), "decontam-items")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // slice_chars)
    each = max(1, pass_chars // slice_chars)
    for a in range(0, n, each):
        slices: dict[int, list[tuple[object, str]]] = {}
        for r in items.withColumn("_slice", F.pmod(F.xxhash64("text"), F.lit(n))).filter(F.col("_slice").between(a, a + each - 1)).collect():
            slices.setdefault(r["_slice"], []).append((r["item_id"], r["text"]))
        if slices:
            yield [sorted(v, key=lambda x: (x[1], x[0] is None, str(x[0]))) for _, v in sorted(slices.items())]
    drop(items)


def find(df: DataFrame, benchmark: DataFrame, rate: float = RATE, whole_chars: int = WHOLE_CHARS, slice_chars: int = SLICE_CHARS, pass_chars: int = PASS_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars) of every document and item within
    the item's budget; distance is the least over the document."""
    spark = df.sparkSession
    texts = need(df, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias(NORM))
    schema = f"doc_id {kind(df, 'doc_id')}, item_id {kind(benchmark, 'item_id')}, distance long, item_chars long"
    of_item = to_arrow_type(next(f for f in benchmark.schema.fields if f.name == "item_id").dataType)
    found = [texts.mapInArrow(_matcher(spark.sparkContext.broadcast(own), rate, whole_chars, group_chars, of_item, True), schema) for own in _passes(benchmark, slice_chars, pass_chars)]
    empty = spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found, empty).groupBy("doc_id", "item_id", "item_chars").agg(F.min("distance").alias("distance")).select("doc_id", "item_id", "distance", "item_chars")


def keep_clean(df: DataFrame, benchmark: DataFrame, rate: float = RATE, whole_chars: int = WHOLE_CHARS, slice_chars: int = SLICE_CHARS, pass_chars: int = PASS_CHARS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of df that hold no item, with all their columns."""
    spark, names, out = df.sparkSession, df.columns, renamed(df, "text")
    of_item = to_arrow_type(next(f for f in benchmark.schema.fields if f.name == "item_id").dataType)
    for own in _passes(benchmark, slice_chars, pass_chars):
        plain = T.StructType(list(out.schema.fields))
        out = out.withColumn(NORM, normalised(F.col("text"))).mapInArrow(_matcher(spark.sparkContext.broadcast(own), rate, whole_chars, group_chars, of_item, False), plain)
    return out.toDF(*names)
