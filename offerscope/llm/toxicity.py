"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier on hashed word features is trained in numpy from confirmed toxic documents
(P) and unlabelled text (U). With class prior q, the risk is q E_P[l(z)] + max(0, E_U[l(-z)] - q E_P[l(-z)]),
with logistic loss l: the second term is the risk on negatives, estimated from U less the positives in it,
which must not be negative; where it is, the step goes against its gradient (Kiryo et al. 2017).

Features are the presence of words (runs of letters, digits and non-ASCII bytes, ASCII capitals lowered) and of
their 5- and 8-byte beginnings, hashed to 2^18 places. The places are counted in P and U with
one aggregation, the FEATURES with the largest weighted log ratio are used. Bounds: at most POSITIVES and
UNLABELLED sampled documents, so the training data that reach the driver are at most
(POSITIVES + UNLABELLED) x FEATURES rows of 13 bytes (133 MB), of which a document fills few. FEATURES and the
penalty were chosen by cross-validation within the rows outside the held-out fold. All documents are
scored in one pass without a shuffle.

Defined results: null and empty texts have no features and score by the intercept; without
confirmed positives or without unlabelled text every score is the prior (0 if unknown); a null
doc_id is kept; repeated rows get equal scores; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.labelled import one_text, remainder
from offerscope.llm.shared import written
from offerscope.llm.words import Words, lean, word_tables

POSITIVES, UNLABELLED = 4_000, 16_000
FEATURES = 512
PLACES = 18
FOLD, HELD_OUT = 3, 1
THRESHOLD = 0.7
PREFIXES = (5, 8)
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def places(w: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, place), each once; only wanted places (a mask) if given."""
    docs, found = [], []
    for salt, h in enumerate([w.hash, *map(w.prefixes, PREFIXES)]):
        place = ((h * np.uint64(2 * salt + 1)) >> np.uint64(64 - PLACES)).astype(np.int64)
        keep = slice(None) if wanted is None else wanted[place]
        docs.append(w.doc[keep]), found.append(place[keep])
    key = np.unique((np.concatenate(docs) << PLACES) + np.concatenate(found))
    return key >> PLACES, key & ((1 << PLACES) - 1)


@dataclass
class Linear:
    bias: float
    weights: np.ndarray  # by place

    def score(self, w: Words) -> np.ndarray:
        doc, place = places(w, self.weights != 0)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(doc, self.weights[place], w.hi - w.lo))))


def fit_nnpu(row: np.ndarray, col: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 600, rate: float = 0.05, penalty: float = 1e-4) -> tuple[float, np.ndarray]:
    """(bias, weights) of the non-negative risk, by Adam on the whole sample; (row, col) are the features present."""
    n = len(positive)
    p, u = positive, ~positive
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[col], n)
        s = 1 / (1 + np.exp(-z))
        minus = np.logaddexp(0, z)  # loss of a document as a negative
        negative_risk = minus[u].mean() - prior * minus[p].mean()
        g = np.zeros(n)
        if negative_risk >= 0:
            g[p] = prior * ((s[p] - 1) - s[p]) / p.sum()
            g[u] = s[u] / u.sum()
        else:
            g[p] = prior * s[p] / p.sum()
            g[u] = -s[u] / u.sum()
        grad = np.append(np.bincount(col, g[row], n_features) + penalty * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[-1]), w[:-1]


def _emit_places(wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None if wanted is None else wanted.value
        for batch in batches:
            for w in word_tables(batch.column(2), lower=True, space=_MARKS):
                doc, place = places(w, mask)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.lo + doc)), batch.column(1).take(pa.array(w.lo + doc)), pa.array(place.astype(np.int32))], names=["doc_id", "positive", "place"])

    return run


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_tables(batch.column(2), lower=True, space=_MARKS):
                score = model.value.score(w)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(w.lo, len(score)) for i in range(2)] + [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Linear:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").filter(remainder(F.col("doc_id"), FOLD) != HELD_OUT)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label")).filter("doc_id is not null and label is not null").filter(remainder(F.col("doc_id"), FOLD) != HELD_OUT)
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).alias("positive"))
    share = known.agg(F.avg(F.col("positive").cast("double")).alias("share")).first().share
    prior = min(max(share or 0.0, 1e-3), 0.9)
    confirmed = known.filter("positive").select("doc_id", F.lit(True).alias("positive")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    others = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    rows = one_text(docs.join(F.broadcast(confirmed.unionByName(others)), "doc_id"), "positive").select("doc_id", "positive", "text")
    rows = written(rows, "sample")  # at most POSITIVES + UNLABELLED rows
    counts = rows.mapInArrow(lean(_emit_places(None)), "doc_id long, positive boolean, place int").groupBy("place").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).filter("p + u >= 5").toArrow()  # at most 2^PLACES rows
    sizes = {r.positive: r["count"] for r in rows.groupBy("positive").count().collect()}
    place, cp, cu = (np.array(counts.column(c).to_pylist(), np.int64) for c in ("place", "p", "u"))
    empty = np.zeros(1 << PLACES)
    if not sizes.get(True) or not sizes.get(False) or not len(place):
        return Linear(float(np.log(prior / (1 - prior))) if share else -50.0, empty)
    a, b = (cp + 0.5) / (sizes[True] + 1), (cu + 0.5) / (sizes[False] + 1)
    best = place[np.lexsort((place, -(a * np.log(a / b))))[:FEATURES]]
    best = best[(a * np.log(a / b))[np.searchsorted(place, best, sorter=np.argsort(place))] > -1] if len(best) else best
    mask = np.zeros(1 << PLACES, bool)
    mask[best] = True
    found = rows.mapInArrow(lean(_emit_places(spark.sparkContext.broadcast(mask))), "doc_id long, positive boolean, place int").toArrow()
    every = rows.select("doc_id", "positive").distinct().toArrow()  # documents without any of the places count as well
    key = lambda t: np.array(t.column("doc_id").to_pylist(), np.int64) * 2 + np.array(t.column("positive").to_pylist(), np.int64)
    ids = np.unique(key(every))
    column = np.full(1 << PLACES, -1)
    column[np.sort(best)] = np.arange(len(best))
    pair = np.unique(np.searchsorted(ids, key(found)) * len(best) + column[np.array(found.column("place").to_pylist(), np.int64)])
    bias, w = fit_nnpu(pair // len(best), pair % len(best), (ids & 1).astype(bool), len(best), prior)
    empty[np.sort(best)] = w
    return Linear(bias, empty)


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id").cast("long"), FOLD) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_scorer(model)), "doc_id long, held_out boolean, score double, predicted int")
