"""Quality classifier (operator 4).

Method: co-training. Two logistic regressions see a document each from its own
side: one the text's content (words, characters, repetition, lines), one the
page's metadata (source, language, recorded length), which never looks at the
text. Both begin with a bounded sample of labelled rows. In each round each view
scores every unlabelled document of the corpus, and the `SHARE` it is most
confident of, on either side in proportion to the classes, become pseudo-labels
for the other view, which is then fitted again (Newton steps on sums taken over all
of them; only sums of matrices and histograms reach the driver). A
pseudo-label is the teacher's calibrated probability, so a view that knows
little teaches little; those of a side weigh together `PSEUDO` of the labelled
rows of its class, however many there are, so the exchange is the same at any
size. The two cuts are quantiles of one histogram and never cross. At the end
each view is calibrated on labelled rows held out (Platt), and the calibrated
log-odds are added, less the prior's: document scores of the two views combined.

The content's features are shares of byte classes, word lengths, repetition,
line lengths, and shares of words by 64 hash buckets. The metadata's are the
labelled rate of the document's source and of its language (smoothed towards
the prior, a labelled row's own label left out; any number of sources), how
many labels the source has, and the recorded length with its powers.

Edge cases: a null or empty text has zero text features; null metadata is a
value (or a length of 0) of its own; columns lang, source and n_chars may be
missing, and are null then; a null doc_id is scored, but never labelled;
doc_id may be of any type; repeated rows are scored each by itself; ties share
their pseudo-label; labels without doc_id or quality are left out, of repeated
ones the least quality counts; with no labels or only one kind of label
everything is kept, at score 1 (or all of that kind); an empty table gives no
rows; other columns, whatever their names, are ignored by score(), kept by
keep_good(). A very long text takes some 60 bytes of a task's memory for each
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, kind, renamed, written
from .textcodes import U8, Words, buffers, mix, pieces

#: Labelled rows read for fitting and calibration, at most: the bound of the sample.
MAX_ROWS = 20_000
HELD_OUT = 0.3
ROUNDS, STEPS = 2, 8
#: The share of unlabelled documents that a view labels in a round.
SHARE = 0.1
#: Weight of a class's pseudo-labels together, against that of its labelled rows.
PSEUDO = 0.1
RIDGE = 1.0
#: Documents below this score go.
THRESHOLD = 0.3
#: Labels that a source's or language's rate is smoothed by.
SMOOTH = 5.0

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b"!", b"|", b"#$%&*+<=>@\\^_`~{}[]/", b".", b",;:", b"?", b"'\"()-"]
BUCKETS = 64
N_TEXT = len(_CLASSES) + 1 + 11 + BUCKETS
N_META = 6
_SIDES = ("text", "meta")
META_FIELDS = ("lang", "source", "n_chars")
#: Bins of the histogram of log-odds, from -LIMIT to LIMIT.
BINS, LIMIT = 4_096, 20.0


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), dtype=np.uint8)  # bytes outside ASCII, and controls
    for i, chars in enumerate(_CLASSES):
        table[list(chars)] = i
    return table


def _per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n).astype(np.float64)


def text_features(column: pa.Array, words: Words) -> np.ndarray:
    """Shares of byte classes, word lengths, repetition, lines and words by hash;
    square roots of shares."""
    data, off = buffers(column)
    n = len(column)
    out = np.zeros((n, N_TEXT))
    table, k = _class_table(), len(_CLASSES) + 1
    for a, b in pieces(off, 1 << 20):
        size = np.diff(off[a : b + 1])
        row = np.repeat(np.arange(b - a), size)
        counts = np.bincount(row * k + table[data[off[a] : off[b]]], minlength=(b - a) * k).reshape(-1, k)
        out[a:b, :k] = np.sqrt(counts / np.maximum(size, 1)[:, None])
        lines = counts[:, _CLASSES.index(b"\n")]
        out[a:b, k + 9] = np.log1p(lines) / 4
        out[a:b, k + 10] = np.log1p(size / (lines + 1)) / 8
    for a, b, row, code, length in words(column):
        m = b - a
        total = _per_row(row, m)
        w = np.maximum(total, 1)
        own = row.astype(U8) << U8(44)
        single = (np.unique(own | (code >> U8(20))) >> U8(44)).astype(np.int64)
        pair = mix(code[:-1] ^ (code[1:] << U8(1)))
        same = row[:-1] == row[1:]
        double = (np.unique((own[:-1] | (pair >> U8(20)))[same]) >> U8(44)).astype(np.int64)
        pairs = np.maximum(_per_row(row[:-1][same], m), 1)
        mean = _per_row(row, m, length) / w
        out[a:b, k + 0] = _per_row(single, m) / w
        out[a:b, k + 1] = _per_row(double, m) / pairs
        out[a:b, k + 2] = mean / 8
        out[a:b, k + 3] = np.sqrt(np.maximum(_per_row(row, m, length.astype(float) ** 2) / w - mean**2, 0)) / 8
        out[a:b, k + 4] = _per_row(row[length <= 3], m) / w
        out[a:b, k + 5] = _per_row(row[length >= 12], m) / w
        out[a:b, k + 6] = np.log1p(total) / 8
        out[a:b, k + 7] = np.minimum(_per_row(single, m) / np.sqrt(w), 20) / 20
        out[a:b, k + 8] = _per_row(double, m) / w
        share = np.bincount(row * BUCKETS + (code % U8(BUCKETS)).astype(np.int64), minlength=m * BUCKETS).reshape(m, BUCKETS) / w[:, None]
        out[a:b, k + 11 :] = np.sqrt(share)
    return out


def _features_of(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    return text_features(batch.column(batch.schema.get_field_index("text")), words)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, dtype=np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        i = batch.schema.get_field_index("text")
        t = _lists(_features_of(batch, words))
        yield pa.RecordBatch.from_arrays([t if j == i else c for j, c in enumerate(batch.columns)], names=batch.schema.names)


def plain(df: DataFrame) -> DataFrame:
    """df with the metadata it lacks as nulls, and other columns renamed."""
    lacking = {n: F.lit(None).cast("string") for n in META_FIELDS if n not in df.columns}
    return renamed(df, "doc_id", "text", *(n for n in META_FIELDS if n not in lacking)).withColumns(lacking)


def features(df: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, n_chars): a row for each of df's; text: its
    features, as 4-byte floats."""
    rows = plain(df).select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"))
    return rows.mapInArrow(_extract, f"doc_id {kind(df, 'doc_id')}, text array<float>, lang string, source string, n_chars double")


@dataclass
class Meta:
    """Makes metadata into numbers. rate: of each labelled source (0) and
    language (1), how many labels it has and their sum."""

    prior: float
    rate: tuple[dict[str | None, tuple[float, float]], dict[str | None, tuple[float, float]]]

    def matrix(self, batch: pa.RecordBatch | pa.Table, own: np.ndarray | None = None) -> np.ndarray:
        """own: labels to be left out of the rates, a row each."""
        n = batch.num_rows
        out = np.zeros((n, N_META))
        for at, (name, table) in enumerate(zip(("source", "lang"), self.rate, strict=True)):
            column = batch.column(batch.schema.get_field_index(name))
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            d = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
            if n:
                found = np.array([table.get(v, (0.0, 0.0)) for v in d.dictionary.to_pylist()])[d.indices.to_numpy(zero_copy_only=False)]
                count, total = found[:, 0] - (own is not None), found[:, 1] - (own if own is not None else 0)
                out[:, at] = logit((total + SMOOTH * self.prior) / (count + SMOOTH)) - logit(self.prior)
                if not at:
                    out[:, 2] = np.log1p(found[:, 0]) / 8
        chars = batch.column(batch.schema.get_field_index("n_chars"))
        chars = chars.combine_chunks() if isinstance(chars, pa.ChunkedArray) else chars
        size = np.log1p(np.maximum(np.nan_to_num(chars.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)), 0)) / 8
        out[:, 3], out[:, 4], out[:, 5] = size, size**2, size**3
        return out


def rates(values: list[str | None], y: np.ndarray) -> dict[str | None, tuple[float, float]]:
    table: dict[str | None, tuple[float, float]] = {}
    for v, label in zip(values, y.tolist(), strict=True):
        n, s = table.get(v, (0.0, 0.0))
        table[v] = (n + 1, s + label)
    return table


def sums(table: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of f over all batches, added up in two steps, so that the driver
    gets a few vectors whatever the number of partitions."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = f(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0).to_pylist():
                total = np.array(v) if total is None else total + np.array(v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["v"])

    rows = table.mapInArrow(first, "v array<double>").repartition(16).mapInArrow(second, "v array<double>").collect()
    return np.sum([r["v"] for r in rows], axis=0) if rows else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class View:
    """A logistic regression on standardised features; the last weight is the constant's."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    #: Platt's slope and shift.
    platt: tuple[float, float] = (1.0, 0.0)

    def x(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([(raw - self.mean) / self.scale, np.ones((len(raw), 1))], axis=1)

    def z(self, raw: np.ndarray) -> np.ndarray:
        return self.x(raw) @ self.w

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        return self.platt[0] * self.z(raw) + self.platt[1]


@dataclass
class Model:
    prior: float
    text: View | None = None
    meta: View | None = None
    numbers: Meta | None = None
    sample: dict[str, int] = field(default_factory=dict)
    #: For each round and view: the pseudo-labels it got of each side, and its loss on rows held out, before and after.
    exchange: list[dict[str, dict[str, float]]] = field(default_factory=list)

    def scores(self, t: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text view, metadata view, both."""
        if self.text is None or self.meta is None or self.numbers is None:
            p = np.full(len(t), self.prior)
            return p, p, p
        a, b = self.text.log_odds(t), self.meta.log_odds(self.numbers.matrix(batch))
        return sigmoid(a), sigmoid(b), sigmoid(a + b - logit(self.prior))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hessian and gradient of the weighted log loss, as one vector."""
    p = sigmoid(x @ w)
    h = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate([h.ravel(), x.T @ (weight * (y - p))])


def step(w: np.ndarray, total: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    d = len(w)
    h, g = total[: d * d].reshape(d, d), total[d * d :]
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-6
    return w + np.linalg.solve(h + np.diag(penalty), g - penalty * w)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift, with Platt's softened targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([0.0, float(logit((pos + 1) / (len(y) + 2)))])
    for _ in range(50):
        new = step(w, newton(x, target, np.ones(len(y)), w), 1e-3)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return max(float(w[0]), 0.0), float(w[1])


def loss(log_odds: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(sigmoid(log_odds), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def histogram(log_odds: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of(log_odds), minlength=BINS).astype(np.float64)


def bin_of(log_odds: np.ndarray) -> np.ndarray:
    return np.clip(((log_odds + LIMIT) * (BINS / (2 * LIMIT))).astype(np.int64), 0, BINS - 1)


def cuts(counts: np.ndarray, prior: float, share: float) -> tuple[int, int, float, float]:
    """(low, high, rows, rows): the bins up to `low` hold the share of rows that
    are least likely good, in proportion to the classes, those from `high` the
    most likely; and how many rows that is. A bin is taken whole, as equal rows
    can't be told apart; the two never overlap: of bins that both sides want,
    neither gets any."""
    total = counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), share * (1 - prior) * total))
    high = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), share * prior * total))
    if low >= high:
        return -1, BINS, 0.0, 0.0
    return low, high, float(counts[: low + 1].sum()), float(counts[high:].sum())


def _known(column: pa.Array, ids: pa.Array) -> np.ndarray:
    """Which rows are in the labelled sample, or have no doc_id."""
    import pyarrow.compute as pc

    return pc.or_(pc.is_null(column), pc.is_in(column, value_set=ids)).to_numpy(zero_copy_only=False)


def train(table: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, share: float = SHARE, weight: float = PSEUDO, steps: int = STEPS) -> Model:
    """table: features(). At most max_rows labels are used, chosen by a hash of
    doc_id; all rows of the table with a doc_id and without a label in that
    sample take part as unlabelled ones."""
    labels = renamed(labels, "doc_id", "quality").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    chosen = labels.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # At most max_rows rows of two numbers: safe to broadcast at any size of the input.
    rows = table.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).withColumn("_h", F.xxhash64("doc_id")).dropDuplicates(["doc_id"]).drop("_id").orderBy("_h", "doc_id").toArrow()
    y = rows["_y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y[0]) if len(y) else 1.0)
    held = (mix(rows["_h"].to_numpy().view(np.uint64)) % U8(1000)).astype(float) < 1000 * HELD_OUT
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.zeros(len(y), bool)
        held[::2] = True
        held = held if len({*y[held]}) == 2 and len({*y[~held]}) == 2 else np.ones(len(y), bool)
    fit = ~held if not held.all() else held
    prior = float(np.clip(y[fit].mean(), 1e-3, 1 - 1e-3))
    numbers = Meta(prior, tuple(rates(rows.filter(pa.array(fit))[c].to_pylist(), y[fit]) for c in ("source", "lang")))
    meta = numbers.matrix(rows)
    meta[fit] = numbers.matrix(rows.filter(pa.array(fit)), y[fit])
    raw = {"text": _matrix(rows["text"].combine_chunks(), N_TEXT), "meta": meta}
    ids = rows["doc_id"].combine_chunks()

    def sides(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"text": _matrix(b.column(1), N_TEXT), "meta": numbers.matrix(b)}

    def moments(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([[b.num_rows], *(np.concatenate([m.sum(0), (m * m).sum(0)]) for m in sides(b).values())])

    total = sums(table, moments)
    n, at, views = total[0], 1, {}
    for side, width in zip(_SIDES, (N_TEXT, N_META), strict=True):
        mean, square = total[at : at + width] / n, total[at + width : at + 2 * width] / n
        at += 2 * width
        sd = np.sqrt(np.maximum(square - mean**2, 0))
        view = View(mean, np.where(sd > 1e-6, sd, 1.0), np.zeros(width + 1))
        x = view.x(raw[side][fit])
        for _ in range(12):
            view.w = step(view.w, newton(x, y[fit], np.ones(len(x)), view.w))
        view.platt = platt(view.z(raw[side][held]), y[held])
        views[side] = view
    of_class = {0: float((y[fit] == 0).sum()), 1: float((y[fit] == 1).sum())}

    def seen(teachers: dict[str, View]) -> Callable[[pa.RecordBatch], np.ndarray]:
        def f(b: pa.RecordBatch) -> np.ndarray:
            free, x = ~_known(b.column(0), ids), sides(b)
            return np.concatenate([histogram(teachers[s].log_odds(x[s][free])) for s in _SIDES])

        return f

    def chosen_rows(teachers: dict[str, View], cut: dict[str, tuple[int, int, float, float]]):
        """The rows that a view is confident of, for the other view (0 text, 1
        metadata): (side, target, weight, x), x: the learner's numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                free, x = ~_known(b.column(0), ids), sides(b)
                for i, (side, other) in enumerate((("text", "meta"), ("meta", "text"))):
                    low, high, n_low, n_high = cut[other]
                    z = teachers[other].log_odds(x[other])
                    k = bin_of(z)
                    each = np.where(k <= low, weight * of_class[0] / max(n_low, 1), np.where(k >= high, weight * of_class[1] / max(n_high, 1), 0.0)) * free
                    sure = np.flatnonzero(each > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sure), i, np.int32)), pa.array(sigmoid(z[sure])), pa.array(each[sure]), _lists(x[side][sure])], names=["side", "target", "weight", "x"])

        return run

    def taught(learners: dict[str, View]) -> Callable[[pa.RecordBatch], np.ndarray]:
        def f(b: pa.RecordBatch) -> np.ndarray:
            which, target, each = (b.column(i).to_numpy() for i in range(3))
            out = []
            for i, side in enumerate(_SIDES):
                own = b.filter(pa.array(which == i)).column(3)
                x = learners[side].x(own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(np.float64) if len(own) else np.zeros((0, len(learners[side].mean))))
                out.append(newton(x, target[which == i], each[which == i], learners[side].w))
            return np.concatenate(out)

        return f

    exchange = []
    for _ in range(rounds):
        teachers = {s: View(v.mean, v.scale, v.w, v.platt) for s, v in views.items()}
        counts = sums(table, seen(teachers))
        cut = {s: cuts(counts[i * BINS : (i + 1) * BINS], prior, share) if len(counts) else (-1, BINS, 0.0, 0.0) for i, s in enumerate(_SIDES)}
        lessons = written(table.mapInArrow(chosen_rows(teachers, cut), "side int, target double, weight double, x array<float>"), "quality-lessons")
        # From nothing, as a step from weights that other labels made sharp overshoots.
        views = {s: View(v.mean, v.scale, np.zeros(len(v.w))) for s, v in views.items()}
        for _ in range(steps):
            total, at = sums(lessons, taught(views)), 0
            for side in _SIDES:
                view = views[side]
                d = len(view.w)
                x = view.x(raw[side][fit])
                own = total[at : at + d * d + d] if len(total) else 0.0
                view.w = step(view.w, newton(x, y[fit], np.ones(len(x)), view.w) + own)
                at += d * d + d
        drop(lessons)
        told = {}
        for side, other in (("text", "meta"), ("meta", "text")):
            views[side].platt = platt(views[side].z(raw[side][held]), y[held])
            told[side] = {"bad": cut[other][2], "good": cut[other][3], "before": loss(teachers[side].log_odds(raw[side][held]), y[held]), "after": loss(views[side].log_odds(raw[side][held]), y[held])}
        exchange.append(told)
    return Model(float(np.clip(y[held].mean(), 1e-3, 1 - 1e-3)), views["text"], views["meta"], numbers, {"fitted": int(fit.sum()), "held_out": int(held.sum())}, exchange)


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m, both = model.scores(_matrix(b.column(1), N_TEXT), b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(x, 6)) for x in (t, m, both)), pa.array(both >= threshold)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return run


def _filter(model: Model, threshold: float, width: int):
    """The first `width` columns of the rows to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keep = model.scores(_features_of(batch, words), batch)[2] >= threshold
            yield batch.select(range(width)).filter(pa.array(keep))

    return run


def score(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every row."""
    table = written(features(df), "quality-features")
    return table.mapInArrow(_score(train(table, labels, max_rows), threshold), f"doc_id {kind(df, 'doc_id')}, p_text double, p_meta double, score double, keep boolean")


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of df that score at least the threshold, with all their columns."""
    table = written(features(df), "quality-features")
    model = train(table, labels, max_rows)
    drop(table)
    rows, width = plain(df), len(df.columns)
    return rows.mapInArrow(_filter(model, threshold, width), T.StructType(rows.schema.fields[:width])).toDF(*df.columns)
