"""Answers against their evidence: a golden for each issue, quantities and claims by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerscope.functions.text import fold_text
from offerscope.operators import claims as C

EVIDENCE = [
    ("S1", "o1", "Vakıf Katılım", "Konut finansmanı için vade 120 ay, kâr payı oranı %2,49 ve tutar 1.500.000 TL olarak açıklandı.", [(350.0, "TRY", None), (9.0, None, "TRY")]),
    ("S2", "o2", "Ziraat Katılım", "Taşıt finansmanında vade 48 aydır.", None),
    ("S3", "o1", "Vakıf Katılım", "Masraf 350 lira.", None),
]
GOLDEN = [
    ("Konut finansmanı vadesi 120 aydır [S1].", []),
    ("Konut tutarı 1500000 TL [S1]", []),
    ("Konut oranı yüzde 2,49 oldu. [S1]", []),  # the citation stands after the sentence
    ("Konut tutarı 350 TL [S1].", []),  # from the normalised value
    ("Konut tutarı 9 TL [S1].", []),  # a currency without unit
    ("Konut vadesi 120 [S1].", []),  # no unit: the number alone
    ("Konut finansmanı vadesi 120 gündür [S1].", [(1, "unsupported_numbers", "120:day")]),
    ("Konut vadesi 121 ay, oran %3 [S1].", [(1, "unsupported_numbers", "121:month,3:percent")]),
    ("Konut vadesi 120 aydır.", [(0, "missing_citations", ""), (1, "missing_citation", "")]),
    ("Konut vadesi 120 aydır [S7].", [(0, "unknown_citations", "S7")]),
    ("Konut vadesi 120 ay [S1][S2].", [(1, "cross_offer_context", "")]),
    ("Konut vadesi 120 ay, masraf 350 lira [S1][S3].", []),
    ("Ziraat Katılım konut vadesi 120 ay [S1].", [(1, "bank_context_mismatch", "")]),
    ("Tamamen başka bir konudan söz ediyoruz burada [S1].", [(1, "unsupported_text", "")]),
    ("[S1]", [(1, "empty", "")]),
    ("1. Konut vadesi 120 ay [S1].\n- Taşıt vadesi 48 ay [S2]\n\nBitti.", [(3, "missing_citation", "")]),
    (None, [(0, "missing_citations", "")]),
    ("", [(0, "missing_citations", "")]),
]


@pytest.fixture(scope="module")
def found(spark):
    answers = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "answer_id long, text string")
    evidence = spark.createDataFrame([(i, *e) for i in range(len(GOLDEN)) for e in EVIDENCE], f"answer_id long, source_id string, offer_id string, bank string, text string, facts {C.FACTS}")
    out = {}
    for r in C.validate(answers, evidence).collect():
        out.setdefault(r.answer_id, []).append((r.claim, r.issue, r.detail))
    return out


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(found, i):
    assert sorted(found.get(i, [])) == GOLDEN[i][1]


def test_quantities(spark):
    texts = {
        "%5 veya yüzde 7, 8%": {"5:percent", "7:percent", "8:percent"}, "1.234,50 TL ve 1.234 lira": {"1234.5:currency", "1234:currency"}, "12 aylık, 3 (ay)": {"12:month", "3:month"}, "100 ayva 7": {"100:", "7:"}, "x5 [S1] 2.5 yıl": {"2.5:year"},
        "10 000 TL": {"10000:currency"}, "1.000.000": {"1000000:"}, "-3 gün": {"-3:day"}, "0,50": {"0.5:"}, "": set(), "12345 adet": {"12345:count"}, "5₺": {"5:currency"},
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.quantities(fold_text("t")).alias("q")).collect()
    assert {r.t: set(r.q) for r in rows} == texts


def test_no_evidence_and_no_answers(spark):
    answers = spark.createDataFrame([(1, "Bir şey söyledi [S1].")], "answer_id long, text string")
    evidence = spark.createDataFrame([], "answer_id long, source_id string, offer_id string, bank string, text string")
    assert [tuple(r) for r in C.validate(answers, evidence).collect()] == [(1, 0, "unknown_citations", "S1")]
    assert C.validate(answers.limit(0), evidence).collect() == []
