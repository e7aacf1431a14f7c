"""A quality classifier: a generalised additive model with pairwise interactions.

Features of a text (shares of character classes, word and line statistics, repetition, compression)
are cut into bins at quantiles. Shallow trees, one feature at a time in turn, are boosted on what is
left of the logistic loss; their sum is a lookup table for each feature. Trees over two features
follow for the pairs that lower the loss most. A score is the sum of one table entry for each
feature and pair, added up for whole batches of rows at once.

Training takes labels only from rows whose crc32 of the id is not 0 modulo ``FOLDS``, and at most
``MOST_ROWS`` of these: a bounded sample, chosen by a digest of the id, brought to the driver as
numbers only. Features are computed once for each whole text and written; the table is what both
training and scoring read. Labels, language, source and id are never features.

Defined results: null and empty texts have all-zero features and are scored like any other; rows
labelled more than once count with their highest label, null labels not at all; a null id is never
held out and never trained on; without labels of both kinds the model is the constant share of label 1
(one half without any label); a very long text is measured whole, its words as numbers; other columns are
not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialised

FOLDS = 5
MOST_ROWS = 40_000
THRESHOLD = 0.3
MOST_BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 40
PAIRS = 8
PAIR_BINS = 8
RATE = 0.1
_MIN_ROWS = 15

FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "short_words", "unique_words", "top_word", "lower", "upper", "digits", "symbols", "stops", "commas", "pipes",
    "other_punctuation", "high_bytes", "spaces", "log_lines", "line_words", "dup_lines", "upper_words", "capital_words", "punctuated_words", "repeat_pairs", "compression", "letter_entropy", "ends_in_stop",
)
_CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digits": b"0123456789", "symbols": b"#*$%&<>{}[]\\^~_=+@/", "stops": b".!?",
    "commas": b",;:", "pipes": b"|", "other_punctuation": b"'\"()-`", "high_bytes": bytes(range(128, 256)), "spaces": b" \t\r\x0b\x0c",
}


def features(raw: bytes, packer: zstandard.ZstdCompressor) -> list[float]:
    """The values of :data:`FEATURES` for a whole text."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {k: float(counts[list(v)].sum()) / size for k, v in _CLASSES.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:]) if n > 1 else seq
    lines = [line for line in raw.split(b"\n") if line.strip()]
    fold = counts[97:123] + counts[65:91]
    p = fold[fold > 0] / max(1, fold.sum())
    first = np.frombuffer(raw, np.uint8)[np.flatnonzero(np.diff(np.concatenate([[1], np.isin(np.frombuffer(raw, np.uint8), (32, 9, 10, 11, 12, 13))])) == -1)]
    return [
        math.log(n), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()), float((lengths < 4).mean()), len(ids) / n, float(np.bincount(seq).max()) / n,
        share["lower"], share["upper"], share["digits"], share["symbols"], share["stops"], share["commas"], share["pipes"], share["other_punctuation"], share["high_bytes"], share["spaces"],
        math.log(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, ids)) / len(ids), float(((first >= 65) & (first <= 90)).mean()),
        sum(1 for w in ids if not w[-1:].isalnum() and w[-1] < 128) / len(ids), 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0, size / len(packer.compress(raw)),
        float(-(p * np.log2(p)).sum()), float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


def feature_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``key`` (the id as text) and the features, an array of floats, for each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            rows = [features(raw or b"", packer) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["id", "x"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


def held_out(id: F.Column, folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))


class Gam:
    """Bins and tables."""

    def __init__(self, base: float, cuts: list[np.ndarray]):
        self.base, self.cuts = base, cuts
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.coarse: dict[int, np.ndarray] = {}
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for a, b, table in self.pairs:
            out += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A tree of ``depth`` levels over ordered bins: its value for each bin (Newton steps)."""
    leaf = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return leaf
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= _MIN_ROWS) & (nr >= _MIN_ROWS), gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0), -1.0)
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
        return leaf
    return np.concatenate([_splits(a, b, c, depth - 1) for a, b, c in ((g[: k + 1], h[: k + 1], n[: k + 1]), (g[k + 1 :], h[k + 1 :], n[k + 1 :]))])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut of each of two features over a grid: its gain and its table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = []
    for c, t in ((cg, tg), (ch, th)):
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        parts.append((a, top - a, left - a, t - top - left + a))
    gain = sum(x**2 / (y + 1.0) for x, y in zip(*parts, strict=True)) - tg**2 / (th + 1.0)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    table = np.empty_like(g)
    v = [float(x[i, j] / (y[i, j] + 1.0)) for x, y in zip(*parts, strict=True)]
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS) -> Gam:
    """Cyclic boosting of shallow trees on the logistic loss."""
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, MOST_BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    model = Gam(math.log(share / (1 - share)), cuts)
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    counts = [np.bincount(bins[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    margin = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = RATE * _splits(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), counts[j], 2)
            table += step
            margin += step[bins[:, j]]
    for j, c in enumerate(counts):  # a coarse grid of nearly equal counts
        model.coarse[j] = np.minimum((np.cumsum(c) - c / 2) * PAIR_BINS // max(1, c.sum()), PAIR_BINS - 1).astype(np.int64)
    coarse = np.stack([model.coarse[j][bins[:, j]] for j in range(bins.shape[1])], axis=1)

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = gradients()
    gains = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(bins.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = gradients()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            margin += step[coarse[:, a], coarse[:, b]]
    return model


def train(table: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id", most_rows: int = MOST_ROWS) -> Gam:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(label).alias("y"))
    known = known.where(~held_out(F.col("id"))).withColumn("at", F.xxhash64("id"))
    n = known.count()
    if n > most_rows:  # about twice as many as wanted pass the digest, then the first of them in its order
        known = known.where(F.pmod("at", F.lit(1 << 30)) < F.lit(min(1 << 30, math.ceil((1 << 30) * 2.0 * most_rows / n))))
    rows = table.join(known, "id").orderBy("at", "id").limit(most_rows).select("x", F.col("y").cast("double").alias("y")).toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.column("y").to_numpy())


def predict(table: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted``."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return table.select("id", held_out(F.col("id")).alias("held_out"), "x").mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = materialised(feature_table(docs), "features")
    return predict(table, train(table, labels)).withColumnRenamed("id", "doc_id")
