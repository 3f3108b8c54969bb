from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from offerscope.llm import crc_resampling
from offerscope.llm.normalised import joined
from offerscope.llm.words import word_tables

CAPITALS = {i: i + 32 for i in range(65, 91)}


def grams(text, low, high):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))
    return len(w), [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, low=1, high=1, buckets=10000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank, n_words) by plain loops."""
    kept = [(r[0], *grams(r[1], low, high)) for r in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, _, fs in kept for f in fs), Counter(bucket(f) for x in target for f in grams(x, low, high)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, fs in kept:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 4)])
def test_gram_crcs_are_those_of_the_bytes(low, high):
    rng = random.Random(low)
    texts = ["".join(rng.choices("abcXYZ 09é東.-\n", k=rng.randint(0, 400))) for _ in range(40)] + [None, "", "one", "x" * 9000, "a b", "..."]
    got = [[] for _ in texts]
    for w in word_tables(pa.array(texts, pa.string()), lower=True, space=crc_resampling.BREAKS):
        j = joined(w)
        for d, c in zip(*crc_resampling.gram_crcs(j.data, j.begin, j.end, j.doc, low, high), strict=True):
            got[w.lo + d].append(int(c))
    assert got == [[zlib.crc32(f.encode()) for f in grams(t, low, high)[1]] for t in texts]


def test_prefixes_and_shifts():
    data = np.frombuffer(random.Random(2).randbytes(1000), np.uint8)
    at = np.array([0, 1, 63, 64, 65, 500, 1000])
    raw = crc_resampling.prefix_crcs(data, at)
    zeros = crc_resampling.shifted(np.full(len(at), 0xFFFFFFFF, np.uint32), at) ^ np.uint32(0xFFFFFFFF)
    assert [int(a ^ b) for a, b in zip(raw, zeros, strict=True)] == [zlib.crc32(data[:n].tobytes()) for n in at]


@pytest.mark.parametrize("low,high,percent", [(1, 1, 10), (1, 2, 50), (2, 2, 100)])
def test_equals_brute_force(spark, edge, edge_rows, low, high, percent, monkeypatch):
    monkeypatch.setattr(crc_resampling, "RANGE_ROWS", 5)
    items = [(1, "w1 w2 the the of"), (2, None), (3, "W3 w4, w5")]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = crc_resampling.resample(edge, target, low, high, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted(str(list(r)) for r in got.collect()) == brute(edge_rows, [x for _, x in items], low, high, percent=percent)


def test_empty_tables(spark, edge, empty, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert crc_resampling.resample(empty, none).collect() == []
    assert sorted(str(list(r)) for r in crc_resampling.resample(edge, none).collect()) == brute(edge_rows, [])
    with pytest.raises(ValueError):
        crc_resampling.features(edge, 2, 1)


def test_equals_brute_force_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(str(list(r)) for r in crc_resampling.resample(docs, bench).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
