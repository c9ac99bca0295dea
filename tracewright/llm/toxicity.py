"""Toxicity scores (operator 8).

Method: a weighted lexicon matched by Aho-Corasick over the folded text.
Folding lowers the case, strips accents, maps look-alike letters of other
scripts to Latin ones and digits and signs to the letters they stand for, so
that "1d10t" and "іdiot" are found as "idiot"; lexicon and exceptions are
folded alike, and each run of white space is one space. A hit must begin a word;
a word entry must also end it, a stem entry needn't. Where a word ends is seen in
the text as it was written: digits and signs beside a hit belong to a word only
if there is a letter beyond them ("@idiot" and "idiot1" are hits, "idiot1c"
isn't). Hits inside an exception phrase don't count. The score is the hits'
weight per 100 words.

Besides the fixed list, stems are learned: word beginnings that the labelled
documents show to be toxic, at most `max_rows` labelled rows being read.

Edge cases: a null or empty text scores 0 and isn't toxic; rows with a null
doc_id and repeated rows are scored each by itself; doc_id may be of any type;
of hits that begin at one place (ties too) one counts; an empty table gives no
rows; other columns, whatever their names, are ignored by score() and kept by
keep_clean(). The time for a text goes by its length and hits, and a task holds
a very long one three times.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, kind, need, renamed, written

#: Labelled rows that stems are learned from, at most: the bound of the sample.
MAX_ROWS = 20_000
#: Candidates that the driver chooses among at once; the rest follow in further passes.
AT_ONCE = 4_000
#: Weight per 100 words from which a document is toxic.
THRESHOLD = 0.15
#: Texts shorter than so many words are normalised as if they had as many.
LEAST_WORDS = 5

WORDS = {
    "idiot": 1.0, "idiots": 1.0, "idiotic": 0.9, "moron": 1.0, "morons": 1.0, "moronic": 0.9, "imbecile": 1.0, "stupid": 0.8, "dumb": 0.6, "dumbass": 1.0, "retard": 1.0,
    "loser": 0.8, "losers": 0.8, "pathetic": 0.8, "worthless": 0.8, "disgusting": 0.8, "scum": 1.0, "scumbag": 1.0, "trash": 0.7, "garbage": 0.5, "clown": 0.7, "clowns": 0.7,
    "vermin": 0.9, "filth": 0.8, "filthy": 0.7, "bastard": 0.9, "bastards": 0.9, "bitch": 1.0, "asshole": 1.0, "fuck": 1.0, "fucking": 1.0, "shit": 0.8, "bullshit": 0.8, "crap": 0.5,
    "whore": 1.0, "slut": 1.0, "freak": 0.6, "creep": 0.6, "jerk": 0.6, "ugly": 0.4, "hate": 0.4, "kys": 1.0, "subhuman": 1.0, "parasite": 0.5, "dimwit": 0.9, "halfwit": 0.9,
}
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "taking out the trash", "clown fish", "clown nose", "circus clown", "class clown", "garbage collector", "garbage collection", "garbage truck",
    "parasite host", "pond scum", "soap scum", "not stupid", "not worthless", "not pathetic", "crap game", "beer jerk", "jerk chicken", "ugly duckling", "freak wave", "freak storm", "hate crime", "hate speech", "sore loser", "clown car",
)

_ALIKE = {
    "a": "аαɑ", "b": "вьβ", "c": "сϲ", "d": "ԁɗ", "e": "еєεё", "g": "ɡ", "h": "һн", "i": "іιıɩӏ", "j": "ј", "k": "кκ", "l": "ⅼ", "m": "мⅿ", "n": "пη", "o": "оοσөօ", "p": "рρ",
    "q": "ԛ", "r": "гг", "s": "ѕ", "t": "тτ", "u": "υцս", "v": "ѵνⅴ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
_STANDS_FOR = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = frozenset(c for c in _STANDS_FOR if not c.isalpha())


def fold_table() -> dict[int, str | None]:
    """For str.translate, after lower(): one letter for all that look like it."""
    table: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2500)]:
        flat = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if flat != chr(code) and flat.isascii() and len(flat) == 1:
            table[code] = flat
    for code in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]:
        table[code] = None
    for letter, others in _ALIKE.items():
        table |= {ord(c): letter for c in others}
    table |= {code: _STANDS_FOR[to] for code, to in table.items() if to in _STANDS_FOR}
    return table | {ord(a): b for a, b in _STANDS_FOR.items()}


def clean(text: str, table: dict[int, str | None]) -> str:
    """In lower case, without invisible characters, white space as single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate({c: to for c, to in table.items() if to is None})
    return " ".join(text.split())


def fold(text: str, table: dict[int, str | None]) -> str:
    """Character for character of clean()."""
    return clean(text, table).translate(table)


def automaton(entries: list[tuple[str, float, str]]):
    """Of (text, weight, kind): kind is word, stem or exception."""
    import ahocorasick

    found = ahocorasick.Automaton()
    table = fold_table()
    for text, weight, kind in entries:
        key = fold(text, table)
        if not key:
            continue
        if key in found:  # a stem also finds the word that it is
            _, other, was = found.get(key)
            weight, kind = max(weight, other), "stem" if "stem" in (kind, was) else kind if weight >= other else was
        found.add_word(key, (len(key), weight, kind))
    found.make_automaton()
    return found


def lexicon(words: dict[str, float] = WORDS, exceptions: tuple[str, ...] = EXCEPTIONS, stems: dict[str, float] | None = None) -> list[tuple[str, float, str]]:
    return [*((w, x, "word") for w, x in words.items()), *((s, x, "stem") for s, x in (stems or {}).items()), *((e, 2.0, "exception") for e in exceptions)]


def ends_word(text: str, at: int, way: int) -> bool:
    """Whether a word ends before the character at `at`, seen from a hit and
    looking on by `way`; text: as clean() leaves it."""
    while 0 <= at < len(text) and (text[at].isdigit() or text[at] in _SIGNS):
        at += way
    return not (0 <= at < len(text) and text[at].isalpha())


def hits(text: str, found, table: dict[int, str | None], plain: dict[int, None] | None = None) -> tuple[float, int, int]:
    """(weight, hits, words) of a text; of hits that begin at one place the
    heaviest counts, then the longest. plain: of the table what is left out."""
    base = text.lower()
    if not base.isascii():
        base = base.translate(plain if plain is not None else {c: to for c, to in table.items() if to is None})
    words = base.split()
    base = " ".join(words)
    folded = base.translate(table)
    best: dict[int, tuple[float, int]] = {}
    spared = []
    for last, (size, weight, kind) in found.iter(folded) if len(found) else ():
        start = last - size + 1
        if not ends_word(base, start - 1, -1) or kind != "stem" and not ends_word(base, last + 1, 1):
            continue
        if kind == "exception":
            spared.append((start, last))
        elif (weight, last) > best.get(start, (0.0, 0)):
            best[start] = (weight, last)
    if spared and best:
        # By where they begin, with the furthest end so far: one step back finds what holds a hit.
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        best = {s: (w, e) for s, (w, e) in best.items() if not (i := bisect_right(begins, s)) or reach[i - 1] < e}
    return float(sum(w for w, _ in best.values())), len(best), len(words)


def _scorer(entries: list[tuple[str, float, str]], threshold: float, only_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = automaton(entries), fold_table()
        plain = {c: None for c, to in table.items() if to is None}
        for batch in batches:
            weights, counts, words = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                w, h, n = hits(text, found, table, plain) if text else (0.0, 0, 0)
                weights.append(100 * w / max(n, LEAST_WORDS))
                counts.append(h)
                words.append(n)
            toxic = pa.array([s >= threshold for s in weights])
            if only_clean:
                yield batch.filter(pc.invert(toxic))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array([round(s, 6) for s in weights]), toxic], names=["doc_id", "n_words", "n_hits", "score", "toxic"])

    return run


def score(df: DataFrame, entries: list[tuple[str, float, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_hits, score, toxic) of every row."""
    return need(df, "doc_id", "text").mapInArrow(_scorer(entries, threshold, False), f"doc_id {kind(df, 'doc_id')}, n_words long, n_hits long, score double, toxic boolean")


def keep_clean(df: DataFrame, entries: list[tuple[str, float, str]], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that aren't toxic, with all their columns."""
    rows = renamed(df, "text")
    return rows.mapInArrow(_scorer(entries, threshold, True), rows.schema).toDF(*df.columns)


def _stems_in(words: set[str], shortest: int, longest: int) -> set[str]:
    return {w[:k] for w in words for k in range(shortest, min(len(w), longest) + 1)}


def _words(text: str, table: dict[int, str | None]) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in fold(text, table)).split())


def _beginnings(shortest: int, longest: int, kept: frozenset[str] = frozenset()):
    """Counts of the beginnings in texts that have none of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _stems_in(_words(text, table), shortest, longest)
                for p in own if kept.isdisjoint(own) else ():
                    counts.setdefault(p, [0, 0])[1 if toxic else 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c for c, _ in counts.values()], pa.int64()), pa.array([t for _, t in counts.values()], pa.int64())], names=["stem", "clean", "toxic"])

    return run


def _present(stems: dict[str, int], shortest: int, longest: int, kept: frozenset[str] = frozenset()):
    """Numbers of the stems in each text, none in one that has any of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            own = [_stems_in(_words(t, table), shortest, longest) for t in batch.column(0).to_pylist()]
            found = [sorted(stems[p] for p in o if p in stems) if kept.isdisjoint(o) else [] for o in own]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["stems"])

    return run


def learn_stems(df: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shortest: int = 4, longest: int = 10, least: int = 5, precision: float = 0.97, at_once: int = AT_ONCE) -> dict[str, float]:
    """Word beginnings that show a labelled document to be toxic, with weights.

    Candidates are in `least` toxic documents or more, and the smoothed share
    of toxic ones among those that have them is at least `precision` (the
    weight). They are taken by that number, the longer of equals last, if
    `least` toxic documents or more have none taken before; so the words that
    copies of one toxic document happen to share aren't. All candidates are gone
    through, `at_once` of them in a pass; a further pass has only those that
    documents with none taken before still have.

    Of repeated labels the greatest counts. Labels without doc_id or toxic, documents without text and labels without a
    document are left out; without toxic labels no stem is learned. At most
    `max_rows` labels are used, chosen by a hash of doc_id."""
    labels = renamed(labels, "doc_id", "toxic").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    chosen = labels.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # At most max_rows rows of two numbers: safe to broadcast at any size of the input.
    sample = written(need(df, "doc_id", "text").filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "_toxic"), "toxicity-sample")
    counts = sample.mapInArrow(_beginnings(shortest, longest), "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean") + 0.1)
    candidates = written(counts.filter((F.col("toxic") >= least) & (share >= precision)).select("stem", "toxic", share.alias("share")), "toxicity-candidates")
    toxic = sample.filter("_toxic = 1")
    left, kept = candidates, {}
    while True:
        rows = left.orderBy(F.desc("toxic"), F.length("stem"), "stem").limit(at_once).collect()
        order, before = {r["stem"]: i for i, r in enumerate(rows)}, frozenset(kept)
        documents = [r["stems"] for r in toxic.select("text").mapInArrow(_present(order, shortest, longest, before), "stems array<int>").filter("size(stems) > 0").collect()] if rows else []
        having: dict[int, list[int]] = {}
        for d, found in enumerate(documents):
            for i in found:
                having.setdefault(i, []).append(d)
        explained = [False] * len(documents)
        for i, r in enumerate(rows):
            new = [d for d in having.get(i, []) if not explained[d]]
            if len(new) >= least:
                kept[r["stem"]] = round(float(r["share"]), 4)
                for d in new:
                    explained[d] = True
        if len(rows) < at_once:
            break
        still = toxic.select("text", "_toxic").mapInArrow(_beginnings(shortest, longest, frozenset(kept)), "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("toxic").alias("n")).filter(F.col("n") >= least).select("stem")
        last, size = rows[-1], F.length("stem")
        later = (F.col("toxic") < last["toxic"]) | (F.col("toxic") == last["toxic"]) & ((size > len(last["stem"])) | (size == len(last["stem"])) & (F.col("stem") > last["stem"]))
        left = candidates.filter(later).join(still, "stem", "left_semi")
    drop(sample)
    drop(candidates)
    return kept
