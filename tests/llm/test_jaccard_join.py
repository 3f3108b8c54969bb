from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from offerscope.llm import jaccard_join as op


def shingles(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(shingles(t)), root(i) if i is not None else None) for i, t in rows)


def got(df):
    return Counter(tuple(r) for r in op.jaccard_components(df).collect())


def test_equals_brute_force(edge, edge_rows, empty):
    assert got(edge) == brute([(r[0], r[1]) for r in edge_rows])
    assert got(empty) == Counter()


@pytest.mark.parametrize(("least", "bucket", "block"), [(2, 32, 400_000), (6, 1, 300), (2, 1, 200), (10**9, 2, 500)])
def test_any_split_into_frequent_and_rare_gives_the_same(spark, monkeypatch, least, bucket, block):
    rng = random.Random(least)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([7, 8, 12, 40, 130, 260]))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 2) :]
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(op, "LEAST_COUNT", least)
    monkeypatch.setattr(op, "BUCKET", bucket)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "LEADERS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert 12 <= len({c for _, _, c in expected}) < len(rows)
    assert got(df) == expected


@pytest.mark.parametrize(("percent", "least"), [(80, 2), (80, 10**9), (75, 2)])
def test_short_texts_link_at_the_threshold(spark, monkeypatch, least, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(30):
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(12)]
        lo = rng.choice([6, 7, 8, 9])
        rows += [(len(rows) + i, " ".join(words[:n])) for i, n in enumerate((lo, lo + 1, lo + 1 + g % 2))]
    monkeypatch.setattr(op, "LEAST_COUNT", least)
    up = {i: i for i, _ in rows}
    sets = [shingles(t, 5) for _, t in rows]
    for b in range(len(rows)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up = {i: up[a] if r == up[b] else r for i, r in up.items()} if up[a] < up[b] else {i: up[b] if r == up[a] else r for i, r in up.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op.jaccard_components(df, 5, percent).collect()} == up
    assert len(set(up.values())) < len(rows)
    if percent == 80 and least == 2:
        assert {r.doc_id for r in op.keep_one(df, 5, percent).collect()} == set(up.values())
