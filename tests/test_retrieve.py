from __future__ import annotations

import numpy as np

from offerscope.operators import curate, retrieve

SF = "/root/testdata/sf0.01"


def sides(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector"), e.selectExpr("vec_id AS chunk_id", "embedding AS vector")


def test_cosine_topk_equals_brute_force_in_one_block_or_many(spark):
    q, c = sides(spark)
    asked, held = q.collect(), c.collect()
    v = np.array([r.vector for r in held], float)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    ids = np.array([r.chunk_id for r in held])
    expected = {}
    for r in asked:
        x = np.array(r.vector, float)
        s = np.round(v @ (x / np.sqrt(x @ x)), 6)
        expected[r.query_id] = ids[np.lexsort((ids, -s))[:10]].tolist()
    for block in (2_000, 6):
        got = {}
        for r in retrieve.cosine_topk(q, c, 10, block).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == expected


def test_ann_topk_recall_with_few_pairs(spark):
    q, c = sides(spark)
    exact = {(r.query_id, r.chunk_id) for r in retrieve.cosine_topk(q, c, 10).collect()}
    found = {(r.query_id, r.chunk_id) for r in retrieve.ann_topk(q, c, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    few = retrieve.ann_topk(q, c.filter("chunk_id < 5"), 10)  # fewer chunks than asked for: answered exactly
    assert few.groupBy("query_id").count().select("count").distinct().first()[0] == 5


def test_ann_topk_is_the_same_in_blocks_and_gives_no_pair_as_a_row(spark, capsys):
    q, c = sides(spark)
    whole, parts = retrieve.ann_topk(q, c, 10), retrieve.ann_topk(q, c, 10, block=6)
    whole.explain()
    assert "Join" not in capsys.readouterr().out
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(whole) == rows(parts)


def test_ann_topk_looks_into_all_cells_where_its_own_hold_too_few(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(200, 8)) * 0.1 + np.eye(8)[0], rng.normal(size=(3, 8)) * 0.01 + np.eye(8)[1], [[np.inf] * 8, [0.0] * 8]])
    c = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "chunk_id long, vector array<double>")
    q = c.filter("chunk_id >= 200").withColumnRenamed("chunk_id", "query_id")
    found, exact = (sorted((r.query_id, r.place, r.chunk_id) for r in df.collect()) for df in (retrieve.ann_topk(q, c, 10, cells=8, probes=1, copies=1), retrieve.cosine_topk(q, c, 10)))
    assert found == exact and len(exact) == 30


def test_near_dup_clusters_find_near_copies_and_leave_boilerplate_apart(spark):
    words = [f"w{i}" for i in range(200)]
    boiler = " ".join(f"b{i}" for i in range(40))
    rows = [(i, " ".join(w if (k + i) % 97 else f"x{i}" for k, w in enumerate(words))) for i in range(12)]
    rows += [(100 + i, boiler + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(30)]
    got = {r.doc_id: r.cluster for r in curate.near_dup_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i] for i in range(12)}) <= 2 and len({got[100 + i] for i in range(30)}) == 30


def test_bands_are_made_once_in_slices_and_equal_sets_share_them(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [rng.integers(-(1 << 63), (1 << 63) - 1, n).tolist() for n in (5, 1, 300, 40)]
    near = sets[2][:295] + rng.integers(0, 1 << 62, 5).tolist()
    sets += [[], sets[2][::-1], near]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(len(sets))]), pa.array(sets, pa.list_(pa.int64()))], names=["u", "own"])
    whole, parts = (pa.Table.from_batches(curate._banded(10, 4, most=n)(iter([batch.slice(0, 3), batch.slice(3)]))).to_pydict() for n in (1 << 20, 64))
    assert whole == parts and whole["u"] == ["p0", "p1", "p2", "p3", "p5", "p6"] and whole["n"] == [5, 1, 300, 40, 300, 300]
    got = dict(zip(whole["u"], whole["bands"]))
    assert all(len(b) == 10 for b in got.values()) and got["p2"] == got["p5"]
    same = lambda a, b: sum(x == y for x, y in zip(got[a], got[b]))
    assert same("p2", "p6") >= 5 and same("p2", "p3") == same("p0", "p1") == 0
    docs = spark.createDataFrame([("a", "one two three four five six"), ("b", "one two three four five six"), ("c", "one two"), ("d", ""), ("e", None), ("f", "ONE two three\tfour five  six")], "doc_id string, text string")
    assert {r.doc_id: r.cluster for r in curate.near_dup_clusters(docs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "a"}


def test_date_mode_and_bounds(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["rate"], None, "Oran?", 2024), (["campaign_end"], None, "", None), ([], "campaign", "", None), (None, None, "Yeni KAMPANYALAR", 2020)], "f array<string>, p string, t string, y int")
    got = rows.select(retrieve.date_mode(F.col("f"), F.col("p"), F.col("t")).alias("m"), retrieve.route_bounds(F.col("y"), F.lit(None).cast("date"), F.to_date(F.lit("2020-03-01"))).alias("b")).collect()
    assert [r.m for r in got] == ["effective", "campaign", "campaign", "campaign"]
    assert [(str(r.b.since), str(r.b.until)) for r in got] == [("2024-01-01", "2020-03-01"), ("None", "2020-03-01"), ("None", "2020-03-01"), ("2020-01-01", "2020-03-01")]
