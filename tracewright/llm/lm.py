"""Language-model scores (operator 6).

Method: stupid backoff, computed relationally. The model is one of trigrams over
the corpus itself, and each word is scored by the counts of all other places: a
word after two others scores (count(trigram) - 1) / (count(its first pair) - 1)
if the trigram occurs elsewhere too, else `backoff` times what it scores after
one word, (count(pair) - 1) / (count(first) - 1) if the pair occurs elsewhere,
else `backoff` times (count(word) - 1) / (words of the corpus - 1), or, for a
word that occurs nowhere else, `backoff` / words of the corpus. The first words
of a text begin with the order they have. A document's score is the sum of logs.
Without taking off the place itself, a model of the corpus would have seen every
trigram it scores and never back off.

Relations: the unigram table is a plain aggregate. The places of the corpus, each
with the two words before and the one after, are partitioned by a hash of the
word, so that one partition holds every place of its words: it aggregates its
part of the pair table and of the trigram table (by their last word and by their
middle word), joins them to its places, and gives sums by document. What a pair
still needs, its first word's count, comes from the unigram table: a bounded
list of the most frequent words goes to every task, for the others the rows are
joined to the table by Spark. All sums are added by document at the end.

The places of a batch of documents travel as one row of arrays for each
partition (words as a dictionary and numbers), a fifth of the bytes and a tenth
of the time of a row for each place. Words so frequent that they would fill a
partition are spread over all of them by the pair they end; their counts are in
the list. The partitions are dealt with in `passes`, each reading the texts
again, so that at most that part of the places is on disk at once. The number of
partitions follows from the number of words and `rows`, to be raised with the
memory that a task has.

Words are compared in lower case by 64-bit hashes (see textcodes); of n distinct
words, pairs or trigrams n**2 / 2**65 are expected to collide.

Edge cases: a null or empty text has no words and a null score; rows without
doc_id count for the tables, but aren't scored; rows that share a doc_id are one
document of several texts; repeated rows count as often as they are there; ids
that aren't whole numbers are told apart by a 64-bit hash; an empty table has no
scores; other columns, whatever their names, are ignored. A very long text takes
some 100 bytes of a task's memory for each of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, need, settings, written
from .textcodes import U8, Words, mix

BACKOFF, ORDER = 0.4, 3
#: Places in a partition, about: some 150 MB of a task's memory.
ROWS = 1_000_000
PASSES = 2
#: Words whose counts go to every task: 0.8 MB, whatever the input.
FREQUENT = 50_000
#: Words held before they are sent on: with their sorted copies some 150 MB.
BATCH_WORDS = 1_200_000
#: In place of a word before a text's first and after its last.
START, END = np.uint64(0), np.uint64(1)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()

    def counted(codes: list[np.ndarray]) -> pa.RecordBatch:
        w, n = np.unique(np.concatenate(codes), return_counts=True)
        codes.clear()
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    codes, total = [], 0
    for batch in batches:
        for *_, code, _ in words(batch.column(0)):
            codes.append(code)
            total += len(code)
            if total >= BATCH_WORDS:
                yield counted(codes)
                total = 0
    if codes:
        yield counted(codes)


def unigram_table(texts: DataFrame) -> DataFrame:
    """(word, n) of (text)."""
    return texts.mapInArrow(_unigrams, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spot(before: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Where a place belongs, on a scale of 64 bits: by its word, or with the
    word before it if the word is hot (sorted)."""
    at = mix(word)
    if len(hot):
        i = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, word), len(hot) - 1)] == word)
        at[i] = mix(word[i] ^ mix(before[i] + U8(1)))
    return at


def small(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.array([len(a), ord(a.dtype.char)], np.int64).tobytes() + a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, kind = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(data, np.dtype(chr(kind)), n, at + 16))
        at += 16 + out[-1].nbytes
    return out


def _explode(parts: int, first: int, last: int, hot: np.ndarray):
    """(key, text) to rows (part, data): the places of the parts from `first` up to `last`."""
    width = U8(((1 << 64) - 1) // parts + 1) if parts > 1 else None

    def rows(ids: np.ndarray, known: np.ndarray, doc: np.ndarray, code: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, bytes]]:
        # Words by number; 0 and 1 are no words.
        words, number = np.unique(code, return_inverse=True)
        vocabulary = np.append(np.array([START, END]), words)
        n = len(code)
        number = (number + 2).astype(np.int32)
        p, pp, after = np.zeros(n, np.int32), np.zeros(n, np.int32), np.ones(n, np.int32)
        p[1:], pp[2:], after[:-1] = number[:-1], number[:-2], number[1:]
        starts = np.flatnonzero(begins)
        p[starts] = pp[starts] = 0
        pp[starts[starts + 1 < n] + 1] = 0
        after[starts[1:] - 1] = 1
        at = spot(vocabulary[p], code, hot)
        part = (at // width).astype(np.int64) if width is not None else np.zeros(n, np.int64)
        own = np.flatnonzero((part >= first) & (part < last))
        own = own[np.argsort(at[own])]
        at, part = at[own], part[own]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        mark, renumber = np.zeros(len(vocabulary), bool), np.zeros(len(vocabulary), np.int32)
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            z = own[a:b]
            around = np.concatenate([p[z], pp[z], after[z]])
            mark[around] = True
            used = np.flatnonzero(mark)
            mark[used] = False
            renumber[used] = np.arange(len(used))
            runs = np.flatnonzero(np.diff(at[a:b], prepend=at[a] ^ U8(1)))
            docs, mine = np.unique(doc[z], return_inverse=True)
            ident = zlib.compress(np.diff(ids[docs], prepend=0).tobytes(), 1)
            yield int(part[a]) - first, pack(code[z[runs]], np.diff(np.append(runs, b - a)).astype(np.uint32), vocabulary[used], renumber[around].astype(small(len(used))), mine.astype(small(len(docs))), np.frombuffer(ident, np.uint8), known[docs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def send() -> pa.RecordBatch:
            doc, code, begins = (np.concatenate([k[i] for k in kept]) for i in range(3))
            kept.clear()
            out = list(rows(np.concatenate(ids), np.concatenate(known), doc, code, begins))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["part", "data"])

        ids, known, kept = [], [], []
        base = n = 0
        for batch in batches:
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            for a, _, row, code, _ in words(batch.column(1)):
                if not len(row):
                    continue
                kept.append(((row + a + base).astype(np.int32), code, np.diff(row, prepend=-1) > 0))
                n += len(row)
                if n >= BATCH_WORDS:
                    yield send()
                    n = 0
            base += batch.num_rows
            if not n:
                ids, known, base = [], [], 0
        if kept:
            yield send()

    return run


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many rows have the same keys, and the first key's order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out, order


def joined(*words: np.ndarray) -> np.ndarray:
    """One code for several words in order."""
    out = mix(words[0] + U8(1))
    for w in words[1:]:
        out = mix(out ^ w) + U8(0x9E3779B97F4A7C15)
    return out


def score_part(w: np.ndarray, p: np.ndarray, pp: np.ndarray, after: np.ndarray, doc: np.ndarray, total: float, frequent: tuple[np.ndarray, np.ndarray], order: int, backoff: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sums of a partition, ((doc, words, log score)), and what awaits a
    count, ((doc, first word, pairs)): the log of its count less 1, times the
    pairs, is to be taken off. w: the word of each place; p, pp: the one before
    and before that; after: the one after."""
    words, counts = frequent
    c1 = runs_of(w)[0].astype(np.float64)
    at, listed = lookup(words, w)
    c1[listed] = counts[at[listed]]
    c2 = runs_of(joined(p, w))[0]
    no_pair, no_triple = p == START, pp == START
    value = np.zeros(len(w))
    if order > 2:
        ahead = runs_of(joined(p, w, after))[0]
        seen = ~no_pair & (after != END) & (ahead > 1)
        value[seen] = np.log(ahead[seen] - 1) - np.log(c2[seen] - 1)
        fewer = no_triple | (runs_of(joined(pp, p, w))[0] == 1)
        steps = np.where(no_triple, 0, 1)
    else:
        fewer, steps = np.ones(len(w), bool), np.zeros(len(w), np.int64)
    pair = fewer & ~no_pair & (c2 > 1)
    alone = fewer & ~pair
    once = alone & (c1 <= 1)
    alone &= ~once
    cut = np.log(backoff)
    value[pair] += steps[pair] * cut + np.log(c2[pair] - 1)
    value[alone] += (steps + ~no_pair)[alone] * cut + np.log(c1[alone] - 1) - np.log(max(total - 1, 1))
    value[once] += (steps + ~no_pair)[once] * cut + cut - np.log(total)
    first, is_first = lookup(words, p)
    now = pair & is_first
    value[now] -= np.log(counts[first[now]] - 1)
    docs, inverse = np.unique(doc, return_inverse=True)
    later = pair & ~is_first
    by = np.lexsort((p[later], doc[later]))
    d, f = doc[later][by], p[later][by]
    starts = np.flatnonzero((np.diff(d, prepend=d[:1] - 1) != 0) | (np.diff(f, prepend=f[:1] ^ U8(1)) != 0)) if len(d) else np.zeros(0, int)
    return (docs, np.bincount(inverse), np.bincount(inverse, weights=value)), (d[starts], f[starts], np.diff(np.append(starts, len(d))))


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return i, table[i] == keys


def _score(total: float, frequent: tuple[np.ndarray, np.ndarray], order: int, backoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for data in batch.column(1).to_pylist():
                last, runs, words, around, own, ident, known = unpack(data)
                ids = np.cumsum(np.frombuffer(zlib.decompress(ident.tobytes()), np.int64))
                kept.append((np.repeat(last, runs), *words[around].reshape(3, -1), ids[own], known[own].astype(bool)))
        if not kept:
            return
        w, p, pp, after, doc, known = (np.concatenate([k[i] for k in kept]) for i in range(6))
        kept.clear()
        if not known.all():  # rows without doc_id only count: they become a document of their own, left out below
            numbers, doc = np.unique(doc, return_inverse=True)
            doc = np.where(known, doc, -1)
        else:
            numbers = None
        (d, n, s), (ld, lw, ln) = score_part(w, p, pp, after, doc, total, frequent, order, backoff)
        if numbers is not None:
            ok, lok = d >= 0, ld >= 0
            d, n, s, ld, lw, ln = numbers[d[ok]], n[ok], s[ok], numbers[ld[lok]], lw[lok], ln[lok]
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d), none, pa.array(n.astype(np.int64)), pa.array(s)], names=["key", "word", "n", "s"])
        yield pa.RecordBatch.from_arrays([pa.array(ld), pa.array(lw.view(np.int64)), pa.array(ln.astype(np.int64)), pa.array(np.zeros(len(ld)))], names=["key", "word", "n", "s"])

    return run


def score(df: DataFrame, order: int = ORDER, backoff: float = BACKOFF, rows: int = ROWS, frequent: int = FREQUENT, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every doc_id. order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = df.sparkSession
    plain = need(df, "doc_id", "text")
    whole = isinstance(plain.schema["doc_id"].dataType, T.IntegralType)
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    texts = plain.select("doc_id", key.alias("key"), F.lower("text").alias("text"))
    unigrams = written(unigram_table(texts.select("text").filter("text is not null")), "lm-unigrams")
    total = unigrams.agg(F.sum("n")).first()[0] or 0
    found = texts.filter("doc_id is not null").select("key", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    if total:
        top = unigrams.orderBy(F.desc("n"), "word").limit(frequent).collect()
        words, counts = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.float64)
        by = np.argsort(words)
        table = words[by], counts[by]
        # A fixed share of a partition: at most 4 * parts words are hot.
        hot = np.sort(words[counts >= rows / 4])
        parts = max(1, -(-total // rows))
        passes = min(passes, parts)
        scored = []
        for i in range(passes):
            first, last = i * parts // passes, (i + 1) * parts // passes
            exploded = texts.select("key", "text").filter("text is not null").mapInArrow(_explode(parts, first, last, hot), "part int, data binary").repartitionById(last - first, F.col("part"))
            with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="128"):
                scored.append(written(exploded.mapInArrow(_score(float(total), table, order, backoff), "key long, word long, n long, s double"), "lm-sums"))
        sums = reduce(DataFrame.unionByName, scored)
        later = sums.filter("word is not null").join(unigrams.withColumnRenamed("n", "of"), "word").select("key", F.lit(0).cast("long").alias("n"), (-F.col("n") * F.log(F.col("of") - 1)).alias("s"))
        found = found.unionByName(sums.filter("word is null").select("key", "n", "s")).unionByName(later)
    else:
        drop(unigrams)
    out = found.groupBy("key").agg(F.sum("n").alias("n_words"), F.sum("s").alias("s"))
    out = out.withColumnRenamed("key", "doc_id") if whole else texts.filter("doc_id is not null").select("doc_id", "key").distinct().join(out, "key")
    any_word = F.col("n_words") > 0
    return out.select(F.col("doc_id").cast(plain.schema["doc_id"].dataType).alias("doc_id"), "n_words", F.when(any_word, F.round("s", 3)).alias("log_score"), F.when(any_word, F.round(F.col("s") / F.col("n_words"), 6)).alias("mean_log_score"))


def oracle_sql(backoff: float = BACKOFF) -> str:
    """Of order 3."""
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents
), exploded AS (
    SELECT row_no, doc_id, unnest(words) AS w3, generate_subscripts(words, 1) AS i FROM texts
), grams AS (
    SELECT doc_id, lag(w3, 2) OVER (PARTITION BY row_no ORDER BY i) AS w1, lag(w3) OVER (PARTITION BY row_no ORDER BY i) AS w2, w3 FROM exploded
), unigrams AS (SELECT w3 AS word, count(*) AS n FROM grams GROUP BY w3
), bigrams AS (SELECT w2, w3, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY w2, w3
), trigrams AS (SELECT w1, w2, w3, count(*) AS n FROM grams WHERE w1 IS NOT NULL GROUP BY w1, w2, w3
), size AS (SELECT count(*) AS n FROM grams
), scored AS (
    SELECT g.doc_id, CASE WHEN t.n > 1 THEN ln(t.n - 1) - ln(c.n - 1)
        WHEN b.n > 1 THEN CASE WHEN g.w1 IS NULL THEN 0 ELSE ln({backoff}) END + ln(b.n - 1) - ln(u2.n - 1)
        ELSE CASE WHEN g.w1 IS NULL THEN 0 ELSE ln({backoff}) END + CASE WHEN g.w2 IS NULL THEN 0 ELSE ln({backoff}) END + CASE WHEN u3.n > 1 THEN ln(u3.n - 1) - ln(greatest(size.n - 1, 1)) ELSE ln({backoff}) - ln(size.n) END END AS s
    FROM grams AS g CROSS JOIN size JOIN unigrams AS u3 ON u3.word = g.w3 LEFT JOIN unigrams AS u2 ON u2.word = g.w2 LEFT JOIN bigrams AS b ON b.w2 = g.w2 AND b.w3 = g.w3
    LEFT JOIN bigrams AS c ON c.w2 = g.w1 AND c.w3 = g.w2 LEFT JOIN trigrams AS t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3
), sums AS (SELECT doc_id, count(*) AS n_words, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(s, 3) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) AS d LEFT JOIN sums ON sums.doc_id = d.doc_id"""
