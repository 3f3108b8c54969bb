from __future__ import annotations

from offerscope.operators.evaluate import relabel_summary


def test_summary(spark):
    rows = [(1, "train", "a", "a", None), (2, "train", "a", "b", None), (3, "test", "a", None, None), (4, None, None, "b", None), (5, "test", "a", "b", "c"), (6, "test", "a", None, "a")]
    got = {(r.part, r.key): r.n for r in relabel_summary(spark.createDataFrame(rows, "doc_id long, split string, label string, rule string, manual string")).collect()}
    assert got == {
        ("total", ""): 6, ("status", "ACCEPT"): 1, ("status", "CORRECT"): 2, ("status", "REVIEW"): 1, ("status", "MANUAL"): 2, ("change", "a -> b"): 1, ("change", "null -> b"): 1, ("changed", ""): 3,
        ("split", "train"): 2, ("split", "test"): 2, ("split", "null"): 1, ("class", "train/a"): 1, ("class", "train/b"): 1, ("class", "test/c"): 1, ("class", "test/a"): 1, ("class", "null/b"): 1,
    }


def test_empty(spark):
    assert relabel_summary(spark.createDataFrame([], "doc_id long, split string, label string, rule string, manual string")).collect() == []
