from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from offerscope.llm import quality_gbdt, toxicity
from offerscope.llm.quality_gbdt import fit


def held(doc_id, fold, out):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % fold == out


def corpus(spark, n=900):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(500)]
    bad = ["vile", "nasty", "horrid"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(w + "###" * junk for w in words)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), labels


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = (y == 1).sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / p / (len(y) - p)


@pytest.mark.parametrize(("module", "target", "fold", "out"), [(quality_gbdt, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_held_out_rows_are_told_apart_and_their_labels_unused(spark, module, target, fold, out):
    docs, labels = corpus(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    rows = module.classify(docs, frame(labels)).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, fold, out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {i: (q if target == "quality" else t) for i, q, t in labels}
    own = [r for r in rows if r.held_out]
    assert auc(np.array([truth[r.doc_id] for r in own]), np.array([r.score for r in own])) > 0.97
    flipped = [(i, 1 - q, 1 - t) if held(i, fold, out) else (i, q, t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in module.classify(docs, frame(flipped)).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in rows) < 1e-9


@pytest.mark.parametrize("module", [quality_gbdt, toxicity])
def test_edges(spark, edge, edge_rows, empty, module):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    some = frame([(r[0], (r[0] or 0) % 2, (r[0] or 1) % 3 == 0 or 0) for r in edge_rows] + [(1, None, None), (10**9, 1, 1)])
    for labels in (some, some.limit(0), some.filter("quality = 1 and toxic = 0"), some.filter("toxic = 1")):
        rows = module.classify(edge, labels).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(empty, labels).count() == 0


def test_trees_learn_a_rule_that_one_split_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = fit(x, y)
    new = rng.random((2000, 5))
    assert (((new[:, 0] > 0.5) ^ (new[:, 3] > 0.3)) == (model.score(new) > 0.5)).mean() > 0.97
    walk = []
    for row in new[:50]:  # one node at a time
        z = model.base
        for i in model.roots:
            while model.left[i] != i:
                i = model.left[i] if row[model.feature[i]] <= model.threshold[i] else model.right[i]
            z += model.value[i]
        walk.append(z)
    assert np.allclose(walk, model.margin(new[:50]))


def test_risk_estimator_beats_taking_unlabelled_text_for_negative():
    rng = np.random.default_rng(1)
    n, prior = 4000, 0.3
    truth = rng.random(n) < prior
    known = np.zeros(n, bool)
    known[np.flatnonzero(truth)[::4]] = True
    present = np.stack([np.where(truth, rng.random(n) < 0.8, rng.random(n) < 0.1), rng.random(n) < 0.5], 1)
    row, col = np.nonzero(np.concatenate([present[known], present]))
    positive = np.concatenate([np.ones(known.sum(), bool), np.zeros(n, bool)])
    bias, w = toxicity.fit_nnpu(row, col, positive, 2, prior)
    score = 1 / (1 + np.exp(-(bias + present @ w)))
    assert abs(score.mean() - prior) < 0.05 and score[present[:, 0]].mean() > 0.7 > score[~present[:, 0]].mean()
