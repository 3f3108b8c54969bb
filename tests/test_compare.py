"""Comparison of banks: numbers in facts, Turkish order, all sort modes, highlights."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerscope.operators import analytics as A


@pytest.fixture(scope="module")
def banks(spark):
    docs = spark.createDataFrame([(1, "Işık", 0.5), (2, "İlk", None), (3, "Şen", 0.9), (4, "Sen", 0.9), (5, "Zor", None), (6, "Çam", 0.1), (7, "Işık", 0.7)], "doc_id long, bank string, confidence double")
    facts = spark.createDataFrame(
        [(1, "VADE_SURESI", "3 yıl"), (7, "VADE_SURESI", "12 ay"), (1, "FINANSMAN_TUTARI", "1.500 TL"), (2, "VADE_SURESI", "36 ay"), (2, "DIGER", "x"), (2, "DIGER", "y"), (2, "DIGER", "y"), (3, "FINANSMAN_TUTARI", "1.499,90 TL"), (9, "DIGER", "of no page")],
        "doc_id long, fact_type string, fact_text string",
    )
    return A.compare_banks(docs, facts)


@pytest.mark.parametrize(
    "mode,order",
    [("bank", "Çam Işık İlk Sen Şen Zor"), ("coverage", "Işık İlk Şen Çam Sen Zor"), ("confidence", "Sen Şen Işık Çam İlk Zor"), ("maturity", "Işık İlk Çam Sen Şen Zor"), ("amount", "Işık Şen Çam İlk Sen Zor")],
)
def test_modes(banks, mode, order):
    assert " ".join(r.bank for r in A.sort_comparison(banks, mode).orderBy("place").collect()) == order


def test_highlights_and_unknown_mode(banks):
    assert [tuple(r) for r in A.comparison_highlights(banks).collect()] == [("coverage", "Işık", "3"), ("maturity", "Işık", "3 yıl"), ("amount", "Işık", "1.500 TL")]
    assert {r.highlight for r in A.comparison_highlights(banks.withColumn("months", F.lit(0.0))).collect()} == {"coverage", "amount"}
    with pytest.raises(ValueError):
        A.sort_comparison(banks, "other")


def test_stated_numbers(spark):
    texts = {"1.500.000 TL": 1500000.0, "%2,49": 2.49, "12": 12.0, "none": 0.0, "5x 7 TL": 7.0, "": 0.0, "3,5 ay": 3.5}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.stated_number(F.col("t")).alias("n"), A.stated_months(F.concat("t", F.lit(" YIL"))).alias("m")).collect()
    assert {r.t: r.n for r in rows} == texts and {r.t: r.m for r in rows}["12"] == 144.0
