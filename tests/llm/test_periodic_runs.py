from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from offerscope.llm import periodic_runs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, power=4, least=6):
    """All runs by comparing every word with the one q later, q ascending."""
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def left_over(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def rewound(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def texts_with_runs(rng, n):
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                w += rng.choices("abcdef", k=rng.randint(0, 12))
            else:
                block = rng.choices("abc", k=rng.randint(1, 9))
                for _ in range(rng.randint(0, 2)):  # blocks of blocks
                    block = block * rng.randint(1, 5) + rng.choices("ab", k=rng.randint(0, 2))
                w += block * rng.randint(1, 6)
        out.append(w)
    return out


@pytest.mark.parametrize("power,least", [(4, 6), (2, 5), (3, 7), (5, 12)])
def test_runs_equal_brute_force(power, least):
    rng = random.Random(power)
    docs = [w for w in texts_with_runs(rng, 150)]
    flat = np.array([ord(x) for w in docs for x in w], np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
    first = np.searchsorted(doc, np.arange(len(docs)))
    got = [[] for _ in docs]
    for s, n, q in zip(*periodic_runs.runs(flat, doc, len(docs), power, least), strict=True):
        got[doc[s]].append((int(s - first[doc[s]]), int(n), int(q)))
    assert [sorted(g) for g in got] == [brute(w, power, least) for w in docs]


def test_extensions_equal_brute_force():
    rng = random.Random(9)
    docs = texts_with_runs(rng, 40) + [["a"] * 3000, list("ab") * 900 + ["c"] + list("ab") * 900, rng.choices("ab", k=2000)]
    docs = [w for w in docs if len(w) > 1]
    flat = np.array([ord(x) for w in docs for x in w], np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
    end = np.searchsorted(doc, np.arange(len(docs)), "right")
    levels = periodic_runs.grammar(flat, doc, len(docs))
    assert len(levels) > 8 and len(levels[-1].symbol) < len(flat) // 10
    d = np.array([rng.randrange(len(docs)) for _ in range(3000)])
    a = np.array([rng.randrange(end[x] - len(docs[x]), end[x] - 1) for x in d])
    b = np.array([rng.randrange(i + 1, end[x] + 1) for i, x in zip(a, d, strict=True)])

    def plain(i, j, stop):
        k = 0
        while j + k < stop and flat[i + k] == flat[j + k]:
            k += 1
        return k

    assert periodic_runs.extensions(levels, a, b).tolist() == [plain(i, j, end[x]) for i, j, x in zip(a, b, d, strict=True)]


def test_steps_of_an_extension_stay_few(monkeypatch):
    """The grammar of a long text is low, so extensions take few steps."""
    n = 200_000
    flat = np.array(random.Random(4).choices(range(50), k=1000) * (n // 1000), np.uint64)
    levels = periodic_runs.grammar(flat, np.zeros(n, np.int64), 1)
    assert len(levels) < 90
    a = np.arange(0, n - 1000, 1000)
    assert periodic_runs.extensions(levels, a, a + 1000).tolist() == (n - 1000 - a).tolist()


def check(rows, found):
    got = sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in found.collect())
    want = []
    for i, t in rows:
        w = words(t)
        runs = brute(w)
        want.append(str((i, len(w), sorted(runs, key=lambda r: (r[0], r[2])), left_over(w, runs))))
    assert got == sorted(want)


def test_edge_rows(spark, edge, edge_rows, empty):
    check([(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 100_000], periodic_runs.find_runs(edge.filter("text is null or length(text) < 100000")))
    assert periodic_runs.find_runs(empty).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(edge, 1)


def test_random_documents(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(texts_with_runs(random.Random(12), 200))]
    check(rows, periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    got = {r.doc_id: r for r in periodic_runs.digests(periodic_runs.find_runs(periodic_runs.rewound(docs))).collect()}
    some = 0
    for d in docs.collect():
        w = rewound(d.doc_id, words(d.text))
        found = sorted(brute(w), key=lambda r: (r[0], r[2]))
        r = got[d.doc_id]
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (top[1] * 1000 // top[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left_over(w, found).encode()).hexdigest()
        some += bool(found)
    assert some > 5
