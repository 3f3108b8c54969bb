"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes and word tables of the texts. The trees are fitted in
numpy on at most TRAIN_ROWS labelled documents (a fixed bound, so the driver holds at most
TRAIN_ROWS x len(STATISTICS) numbers): values are binned by quantiles once, and each node's split
comes from histograms of gradients. The fitted ensemble is flattened to arrays of feature,
threshold, children and value, and all documents are scored by numpy steps down all trees at
once, in one pass without a shuffle.

Defined results: null and empty texts have zero statistics and are scored like any other;
without usable labels every score is 0.5, with labels of one class it is that class's smoothed
share; a null doc_id is kept; repeated rows get equal scores; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.labelled import labelled_sample, remainder
from offerscope.llm.words import Words, lean, word_tables

TRAIN_ROWS = 20_000
FOLD, HELD_OUT = 4, 2
THRESHOLD = 0.7
STATISTICS = (
    "log_words", "mean_word_chars", "sd_word_bytes", "symbols_per_word", "bars_per_word", "upper_share", "digit_share", "high_byte_share", "stops_per_word", "commas_per_word",
    "exclamations_per_word", "other_marks_per_word", "lines_per_word", "repeated_line_share", "repeated_window_share", "same_as_before_share", "distinct_word_share", "short_word_share", "long_word_share", "first_upper_share",
)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "symbol": b"#*$%&<>", "space": (9, 11, 12, 13, 32), "line": b"\n"}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_CLASS[0x80:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2


def _twice(key: np.ndarray) -> np.ndarray:
    """Marks the entries whose key occurs again."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(w: Words) -> np.ndarray:
    """One row of STATISTICS for each document of a word table."""
    n = w.hi - w.lo
    size = np.diff(w.offsets)
    kind = np.bincount(np.repeat(np.arange(n), size) * _N + _CLASS[w.data], minlength=n * _N).reshape(n, _N)
    at = {k: kind[:, i].astype(float) for i, k in enumerate(_CLASSES)}
    words = np.diff(w.first()).astype(float)
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / some
    var = np.maximum(np.bincount(w.doc, length**2, n) / some - mean**2, 0)
    salt = w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g, ok = w.grams(8)
    where = np.flatnonzero(ok)
    twice = where[_twice(g[where] ^ salt[where])]
    edge = np.bincount(twice, minlength=len(w.hash) + 9) - np.bincount(twice + 8, minlength=len(w.hash) + 9)
    covered = np.cumsum(edge)[: len(w.hash)] > 0
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    own = np.sort(w.hash ^ salt)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    order = np.argsort(w.hash ^ salt)
    distinct = np.bincount(w.doc[order], new, n)
    # lines: the hash of a line is that of its bytes
    breaks = np.flatnonzero(w.data == 10)
    doc_of = np.searchsorted(w.offsets, breaks, "right") - 1
    begin = np.unique(np.concatenate([w.offsets[:-1][size > 0], breaks[breaks + 1 < w.offsets[doc_of + 1]] + 1]))
    stop = np.append(begin[1:], len(w.data))
    owner = np.searchsorted(w.offsets, begin, "right") - 1
    value = _line_hash(w, begin, stop)
    long = stop - begin > 8
    repeated = np.bincount(owner[long][_twice(value[long] ^ (owner[long].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))], minlength=n)
    lines = np.maximum(np.bincount(owner, minlength=n), 1)
    letters = np.maximum(at["upper"] + at["lower"], 1)
    bytes_ = np.maximum(size, 1)
    first = w.data[w.start]
    share = lambda flag: np.bincount(w.doc, flag, n) / some
    return np.stack(
        [
            np.log1p(words), mean, np.sqrt(var), at["symbol"] / some, at["bar"] / some, at["upper"] / letters, at["digit"] / bytes_, kind[:, -1] / bytes_, at["stop"] / some, at["comma"] / some,
            at["bang"] / some, kind[:, -2] / some, lines / some, repeated / lines, share(covered), share(again), distinct / some, share(length <= 2), share(length >= 15), share((first >= 65) & (first <= 90)),
        ],
        axis=1,
    )


def _line_hash(w: Words, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    from offerscope.llm.words import _INVERSE, _powers, mix

    return mix((w.total[stop] - w.total[begin]) * _powers(_INVERSE, len(w.total))[begin])


@dataclass
class Trees:
    """An ensemble as flat arrays; a leaf's children are itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Logistic boosting; `least` is the least sum of hessians in a child."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = ([] for _ in range(6))

    def node(v: float) -> int:
        i = len(value)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        f = x.shape[1]
        flat = code + np.arange(f) * bins
        z = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(node(0.0))
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                following = []
                for i, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    value[i] = -rate * g / (h + penalty)
                    best = None
                    if d < depth and h >= 2 * least:
                        own = flat[rows].ravel()
                        hg = np.bincount(own, np.repeat(grad[rows], f), f * bins).reshape(f, bins).cumsum(1)
                        hh = np.bincount(own, np.repeat(hess[rows], f), f * bins).reshape(f, bins).cumsum(1)
                        gain = hg**2 / (hh + penalty) + (g - hg) ** 2 / (h - hh + penalty) - g**2 / (h + penalty)
                        gain[(hh < least) | (h - hh < least)] = -1
                        best = np.unravel_index(np.argmax(gain), gain.shape)
                    if best is None or gain[best] <= 1e-6 or best[1] >= len(cuts[best[0]]):
                        z[rows] += value[i]
                        continue
                    feature[i], threshold[i] = int(best[0]), float(cuts[best[0]][best[1]])
                    left[i], right[i] = node(0.0), node(0.0)
                    low = code[rows, best[0]] <= best[1]
                    following += [(left[i], rows[low]), (right[i], rows[~low])]
                level = following
    if not roots:
        roots.append(node(0.0))
    return Trees(base, np.array(roots), *(np.array(a) for a in (feature, threshold, left, right, value)), depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in word_tables(batch.column(1)):
            x = statistics(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, len(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_tables(batch.column(2)):
                score = model.value.score(statistics(w))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(w.lo, len(score)) for i in range(2)] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", fold: int = FOLD, held_out: int = HELD_OUT) -> Trees:
    rows = labelled_sample(docs, labels, target, fold, held_out, TRAIN_ROWS).select("label", F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(lean(_features), "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), FOLD) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_scorer(model)), "doc_id long, held_out boolean, score double, predicted int")
