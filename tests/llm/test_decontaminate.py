from __future__ import annotations

import random
import re

from offerscope.llm import decontaminate
from offerscope.llm.decontaminate import contained_items


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, percent=80):
    out = set()
    for i, t in docs:
        own = words(t)
        s = {k: shingles(own, k) for k in range(1, 6)}
        for j, u in items:
            v = words(u)
            k = min(5, len(v))
            if i is not None and j is not None and k:
                q = shingles(v, k)
                if 100 * len(q & s[k]) >= percent * len(q):
                    out.add((i, j, len(q), len(q & s[k])))
    return out


def test_equals_exact_containment(spark, edge, edge_rows, empty, monkeypatch):
    items = [(1, "one two three four"), (2, None), (3, ""), (None, edge_rows[5][1])]
    items += [(10 + k, " ".join(edge_rows[n][1].split()[a:b])) for k, (n, a, b) in enumerate([(5, 0, 20), (5, 10, 60), (9, 5000, 5040), (9, 100, 4000), (13, 0, 30), (20, 0, 9)])]
    near = edge_rows[5][1].split()[:40]
    near[20] = "changed"
    items.append((50, " ".join(near)))
    items.append((50, " ".join(near)))
    items += [(60 + k, t) for k, t in enumerate(["A b c", "one", " ".join(edge_rows[9][1].split()[700:704]), "never said here", edge_rows[9][1]])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    expected = brute([(r[0], r[1]) for r in edge_rows], items)
    assert len(expected) > 8
    assert {j for _, j, n, _ in expected if j >= 60} == {60, 61, 62, 64}
    for rows in (decontaminate.INDEX_ROWS, 0):
        monkeypatch.setattr(decontaminate, "INDEX_ROWS", rows)
        assert {tuple(r)[:4] for r in contained_items(edge, bench).collect()} == expected
        assert {r.doc_id for r in decontaminate.drop_contaminated(edge, bench).collect()} == {r[0] for r in edge_rows} - {i for i, *_ in expected}
        assert decontaminate.drop_contaminated(edge, bench).schema == edge.schema
    assert contained_items(empty, bench).count() == 0
    assert contained_items(edge, bench.limit(0)).count() == 0


def test_partitions_have_bounds_of_their_own(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 9, 40, 400, 5000])))) for i in range(150)]
    index = spark.createDataFrame(items, "item_id long, item string").mapInArrow(decontaminate._item_index(80), decontaminate._INDEX).toPandas()
    bounds = index.groupby("part").bound.first()
    assert bounds.nunique() >= 4 and index[index.n_item > 300].bound.max() < index.bound.max() / 2
    for _, own in index.groupby("item"):
        assert own[own.sketch].h.max() <= own.bound.iloc[0] and own.sketch.sum() == len(own) - -(-80 * len(own) // 100) + 1
