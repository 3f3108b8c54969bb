"""Passages that begin or end with the digits of their own place keep them: the queries equal their SQL on such texts."""

from __future__ import annotations

import duckdb
import pytest

from offerscope.plans import ORACLES, QUERIES

TEXTS = ["0997523947200283 | chlich | one.\n1683436113538828 Ndly. +1 (504) 555-0292\n In 1999 it was licensed under mit 3", "Reouti anatha. 19.37.233.111", "Twelve letters!! 10112131415!! 10112131415 token!! 20213 2013!! 4040404044"]
CASES = ["f1_segments", "e7_attach_facts", "f11_cap_facts", "f20_evidence_window", "f25_validate_claimed_facts", "fact_rules", "fact_rules_with_evidence"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("given"))
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", CASES)
def test_equals_sql_where_passages_begin_with_digits(spark, given, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{given}/documents.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    expected = sorted(found.fetchall(), key=str)
    assert expected and sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, given).collect()), key=str) == expected
