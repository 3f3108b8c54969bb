from __future__ import annotations

import random

import duckdb
import pytest

from offerscope.operators.questions import select_evidence, validate_answers
from offerscope.plans import ORACLES, QUERIES

COLUMNS = "query_id long, place int, chunk_id long, bank string, product_match boolean, contradicts boolean, field_match boolean, confirmation int, intent string, asks_product boolean, asks_field boolean, asks_bank boolean, numeric boolean"


def plain(hits, limit, strict):
    """The choice for one query's hits, in order, by its description."""
    q = hits[0]
    product = [h for h in hits if h["product_match"] and not h["contradicts"]]
    field = [h for h in hits if h["field_match"]]
    joint = [h for h in product if h["field_match"]]
    sure = [h for h in field if h["confirmation"] > 0]
    title = [h for h in sure if h["confirmation"] == 2]
    wide = not q["asks_bank"] and q["intent"] in ("compare", "list")

    def spread(rows):
        if not wide:
            return rows
        best = {}
        for h in rows:
            if h["bank"] not in best or h["confirmation"] > best[h["bank"]]["confirmation"]:
                best[h["bank"]] = h
        first = [h for h in rows if any(h is b for b in best.values())]
        return first + [h for h in rows if h not in first]

    numeric = q["asks_product"] and q["asks_field"] and q["numeric"] and q["intent"] != "historical"
    if numeric and not strict:
        out = joint or sure
        return spread(out or (product if q["intent"] == "lookup" else []))[:limit] if out else (product if q["intent"] == "lookup" else [])[:limit]
    if numeric and sure:
        if wide:
            return spread(sure)[:limit]
        return (title if title and (q["intent"] != "compare" or len(title) > 1) else sure)[:limit]
    if numeric and field:
        return []
    if q["asks_product"] and q["asks_field"] and field and not numeric:
        return (joint + [h for h in field if h not in joint])[:limit]
    if q["asks_product"] and product:
        return product[:limit]
    return (field if q["asks_field"] and field else hits)[:limit]


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_plain_choice(spark, strict):
    rng = random.Random(3)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows, expected = [], []
    for q in range(150):
        share = rng.choice([0.0, 0.1, 0.5])
        asked = dict(intent=rng.choice(["lookup", "compare", "list", "calculate", "historical"]), **{k: rng.random() < 0.7 for k in ("asks_product", "asks_field", "asks_bank", "numeric")})
        hits = [dict(query_id=q, place=p, chunk_id=100 * q + p, bank=rng.choice("abc"), product_match=rng.random() < share + 0.2, contradicts=rng.random() < 0.2, field_match=rng.random() < share, confirmation=rng.choice([0, 0, 1, 2]), **asked) for p in range(1, rng.randint(2, 12))]
        rows += [tuple(h[n] for n in names) for h in hits]
        expected += [(q, i + 1, h["chunk_id"]) for i, h in enumerate(plain(hits, 4, strict))]
    got = [(r.query_id, r.place, r.chunk_id) for r in select_evidence(spark.createDataFrame(rows, COLUMNS), 4, strict).orderBy("query_id", "place").collect()]
    assert got == expected


def test_answers_name_the_bank_and_one_offer(spark):
    words = "monthly payment stays low"
    claims = [(1, 1, "S1", words, "a"), (1, 2, "S1", words, "b"), (1, 3, "S1", words, None), (1, 3, "S2", words, None), (1, 4, "S9", words, "a"), (1, 5, "S1", words + " 7", None)]
    evidence = [(1, "S1", words, "a", "o1"), (1, "S2", words, "a", "o2")]
    c = spark.createDataFrame(claims, "query_id int, claim_id int, source_id string, claim string, bank string")
    e = spark.createDataFrame(evidence, "query_id int, source_id string, text string, bank string, offer_id string")
    assert {(r.issue, r.n) for r in validate_answers(c, e).collect()} == {("none", 1), ("bank", 1), ("several_offers", 2), ("unknown_source", 1), ("number", 1)}
    assert {(r.issue, r.n) for r in validate_answers(c.drop("bank", "claim_id"), e).collect()} == {("none", 4), ("unknown_source", 1), ("number", 1)}


def test_claims_of_one_word_or_none_need_no_second(spark):
    claims = [(1, "S1", "thonnt of thonnt"), (2, "S1", "of the"), (3, "S1", "elsewhere"), (4, "S1", "thonnt elsewhere")]
    c = spark.createDataFrame(claims, "query_id int, source_id string, claim string")
    e = spark.createDataFrame([(i, "S1", "thonnt of thonnt") for i in range(1, 5)], "query_id int, source_id string, text string")
    assert {(r.issue, r.n) for r in validate_answers(c, e).collect()} == {("none", 2), ("support", 2)}


def test_answers_equal_sql_on_texts_of_one_word_and_other_line_ends(spark, tmp_path):
    texts = ["thonnt thonnt thonnt", "abcdefghijklmnopqrst", "monthly\rpayment stays", "monthly\npayment stays", "monthly\x85payment\u2028stayslow", None]
    spark.createDataFrame([(i + 3 * k, t) for k, t in enumerate(texts) for i in (100, 300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = set(con.execute(ORACLES["l11_validate_answers"]).fetchall())
    assert len(expected) == 2 and {(r.issue, r.n) for r in QUERIES["l11_validate_answers"](spark, str(tmp_path)).collect()} == expected
