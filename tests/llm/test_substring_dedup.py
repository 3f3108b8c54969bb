from __future__ import annotations

import hashlib
import re

import pytest

from offerscope.llm import substring_dedup as op


def brute(rows):
    first, words = {}, []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        words.append((i, w))
        for k in range(len(w) - 12):
            if i is not None:
                x = tuple(w[k : k + 13])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in op.remove_repeats(df).collect()), key=str)


def test_equals_brute_force(edge, edge_rows, empty):
    expected = brute([(r[0], r[1]) for r in edge_rows])
    assert sum(r[2] for r in expected) > 1000
    assert got(edge) == expected
    assert got(empty) == []


@pytest.mark.parametrize("homes", [1, 2000])
def test_salted_homes_and_hot_anchors_give_the_same(edge, edge_rows, monkeypatch, homes):
    monkeypatch.setattr(op, "HOME_BYTES", homes)
    monkeypatch.setattr(op, "SHARD_BYTES", homes)
    hashes = [(r.h, 7) for r in edge.filter("text is not null").select("doc_id", "text").filter("doc_id is not null").mapInArrow(op._emit_anchors, "doc_id long, h long").groupBy("h").count().filter("count > 2").limit(20).collect()]
    assert hashes
    monkeypatch.setattr(op, "_hot", lambda texts: hashes)
    assert got(edge) == brute([(r[0], r[1]) for r in edge_rows])


def test_rows_that_repeat_an_id_with_another_text(spark):
    words = [f"w{i}" for i in range(60)]
    base, own = " ".join(words), " ".join(f"own{i}" for i in range(60))
    rows = [(1, base), (2, "before it all " + base), (2, "short"), (2, base + " tail"), (3, own), (3, own), (4, own[:200])] + [(i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(5, 11)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute(rows)
