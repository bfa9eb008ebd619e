"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from Arrow buffers by numpy. Trees are grown level by level on binned statistics and flattened into
arrays of features, thresholds and leaves, so that all trees are walked for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without_dots

from .arrays import Words, chunks, lowered, span_hashes, text_buffers
from .training import SAMPLE_ROWS, labelled_texts

#: Bytes counted one by one, then the classes of the rest.
SYMBOLS = b"!*$&%#|.,;:?-_/()\"'<>=+@\n "
CLASSES = ("upper", "lower", "digit", "control", "other", "beyond")


def byte_classes() -> np.ndarray:
    out = np.full(256, len(SYMBOLS) + CLASSES.index("other"), np.int64)
    n = len(SYMBOLS)
    out[65:91], out[97:123], out[48:58], out[:32], out[128:] = n, n + 1, n + 2, n + 3, n + 5
    for i, b in enumerate(SYMBOLS):
        out[b] = i
    return out


BYTE_CLASS = byte_classes()


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of distinct keys, and how often the commonest occurs."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    runs = np.diff(np.append(new, len(d)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[new], runs)
    return np.bincount(d[new], minlength=n), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per document; an empty text has zeros throughout."""
    n, size = len(offsets) - 1, np.diff(offsets)
    k = len(SYMBOLS) + len(CLASSES)
    by_byte = np.bincount(np.repeat(np.arange(n) * k, size) + BYTE_CLASS[raw], minlength=n * k).reshape(n, k)
    words = Words(raw, offsets)
    doc, length = words.doc(), words.ends - words.starts
    hashed = span_hashes(lowered(raw), words.starts, words.ends)
    count = np.maximum(words.count, 1)
    per = lambda values: np.bincount(doc, values, minlength=n) / count
    distinct, most = _distinct(doc, hashed, n)
    same = np.zeros(len(doc), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    last = raw[words.ends - 1] if len(doc) else raw[:0]
    second = raw[np.maximum(words.ends - 2, words.starts)] if len(doc) else raw[:0]
    symbol = (last < 128) & (BYTE_CLASS[last] < len(SYMBOLS)) if len(doc) else same
    first = raw[words.starts] if len(doc) else raw[:0]
    upper = (first >= 65) & (first <= 90)
    shout = upper & (second >= 65) & (second <= 90)
    lines = Words(raw, offsets, np.arange(256) == 10)
    line_doc = lines.doc()
    line_kinds, _ = _distinct(line_doc, span_hashes(raw, lines.starts, lines.ends), n)
    line_count = np.maximum(lines.count, 1)
    columns = [
        np.log1p(size), np.log1p(words.count), np.log1p(lines.count), per(length.astype(float)), per((length**2).astype(float)),
        distinct / count, most / count, per(same), per(symbol & (last == second)), per(symbol), per(upper), per(shout),
        per(length == 1), per(length > 12), line_kinds / line_count, words.count / line_count, (distinct / np.sqrt(count)),
    ]
    out = np.column_stack([*columns, by_byte / np.maximum(size, 1)[:, None]])
    out[size == 0] = 0
    return out


STATISTICS = 17 + len(SYMBOLS) + len(CLASSES)


def _table(column: pa.Array) -> np.ndarray:
    raw, offsets = text_buffers(column)
    parts = [statistics(part, at) for _, _, part, at in chunks(raw, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, STATISTICS))


class Trees:
    """Boosted trees of one depth as arrays: feature and threshold by (tree, inner node), value by (tree, leaf)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value
        self.depth = int(np.log2(value.shape[1])) if value.size else 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        tree, row = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        if not self.value.size:
            return out
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return out + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss. One class or no rows gives a constant score (one half without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return Trees(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    features, inner = x.shape[1], 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value, margin = np.zeros((trees, 2**depth)), np.full(len(y), base)
    flat = binned + np.arange(features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p) + 1e-9
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (features * bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, features), width * features * bins).reshape(width, features, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, features), width * features * bins).reshape(width, features, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            cut = np.array([edges[i][j] if ok and j < len(edges[i]) else np.inf for i, j, ok in zip(f, b, good)])
            feature[t, width - 1 : 2 * width - 1], threshold[t, width - 1 : 2 * width - 1] = f, cut
            node = 2 * node + (x[np.arange(len(y)), f[node]] > cut[node])
        leaf = -rate * np.bincount(node, grad, 2**depth) / (np.bincount(node, hess, 2**depth) + ridge)
        value[t] = leaf
        margin += leaf[node]
    return Trees(base, feature, threshold, value)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the statistics of a bounded labelled sample; only its statistics reach the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _table(batch.column(0))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1)], names=["x", "y"])

    got = labelled_texts(documents, labels, label, modulus, rows).mapInArrow(measured, "x array<double>, y int").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), STATISTICS)
    order = np.lexsort(np.column_stack([x, got["y"]]).T) if len(x) else slice(0)
    return fit_trees(x[order], got["y"].to_numpy(float)[order])


def score_quality(documents: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """documents' rows with score (0 to 1) and predicted (1 from the threshold on).

    Only the text counts: null is empty, an empty text has statistics of zero, a very long one is read whole. Repeated rows each
    get their score, an empty table gives no rows. Other columns stay, but for ones named like a result, whatever the case.
    """
    columns = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    source, names = without_dots(documents, columns)
    shared = documents.sparkSession.sparkContext.broadcast((model.base, model.feature, model.threshold, model.value))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*shared.value)
        for batch in batches:
            x = _table(batch.column(columns.index("text")))
            score = np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
            new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(scored, f"{kinds}, score double, predicted int").toDF(*columns, "score", "predicted")
