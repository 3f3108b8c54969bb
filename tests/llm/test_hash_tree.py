from __future__ import annotations

import zlib
from collections import Counter

from offerscope.llm.hash_tree import Tree, place


def test_law_slots_and_measures(edge, edge_rows, empty):
    rows = place(edge, Tree(40)).collect()
    assert len(rows) == len(edge_rows)
    text = {r[0]: r[1] or "" for r in edge_rows if r[0] is not None}
    for r in rows:
        assert r.grown_shard in (r.shard, 40)
        if r.doc_id is not None:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert place(empty, Tree(40)).count() == 0


def test_growth_moves_only_into_the_new_leaf_and_weights_count(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    for n in (1, 7, 40, 41):
        rows = place(docs, Tree(n)).collect()
        assert all(r.grown_shard in (r.shard, n) for r in rows)
        moved = sum(r.grown_shard == n for r in rows)
        assert abs(moved - 20000 / (n + 1)) < 5 * (20000 / (n + 1)) ** 0.5
    heavy = Counter(r.shard for r in place(docs, Tree(10, weights=(3.0,))).collect())
    assert abs(heavy[0] - 5000) < 300 and all(abs(heavy[i] - 20000 / 12) < 250 for i in range(1, 10))


def test_changed_weight_moves_rows_only_on_the_path_of_the_changed_leaf(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'' AS text")
    a = {r.doc_id: r.shard for r in place(docs, Tree(32)).collect()}
    b = {r.doc_id: r.shard for r in place(docs, Tree(32, weights=(1, 1, 1, 4.0))).collect()}
    moved = Counter()
    for i in a:
        if a[i] // 10 != b[i] // 10:
            moved["region"] += 1
            assert b[i] // 10 == 0
        elif a[i] // 5 != b[i] // 5:
            moved["rack"] += 1
            assert b[i] // 5 == 0
        elif a[i] != b[i]:
            moved["leaf"] += 1
            assert b[i] == 3
    assert min(moved["region"], moved["rack"], moved["leaf"]) > 20
    assert abs(Counter(b.values())[3] - 5000 * 4 / 35) < 110


def test_levels_shape_the_placement(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'' AS text")
    a, b = ({r.doc_id: r.shard for r in place(docs, t).collect()} for t in (Tree(40), Tree(40, 40, 1)))
    assert sum(a[i] != b[i] for i in a) > 1500


def test_repeated_ids_are_numbered_without_gaps(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 5 WHEN id < 2000 THEN NULL ELSE id END AS doc_id", "CASE WHEN id < 500 THEN 'same' ELSE CAST(id AS string) END AS text")
    by = {}
    for r in place(docs, Tree(40)).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == 3000 and all(sorted(s) == list(range(len(s))) for s in by.values())
