from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerscope.llm import personal_data
from offerscope.llm.personal_data import BASE_KINDS, KINDS

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(text):
    d = [int(c) for c in text if c in "0123456789"][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def holds(kind, m):
    n = sum(c in "0123456789" for c in m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= n <= 19 and luhn(m), "phone": 8 <= n <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE_KINDS for m in re.finditer(PATTERNS[k], text or "") if holds(k, m[0])]


def noisy(rng, n):
    """Random strings of the characters that matter, so that runs, chains and failing matches meet."""
    parts = ["a", "b.c", "@", ".", "-", " ", "x@y.zz", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "7", "0007", "é", "😀", "_", "%", "\n", "12.34.56.78.90", "--", "  ", "+", "(", ")", "u+v@w-x.y_z@q.r"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return personal_data.train(docs)


def check_base(rows, found):
    got = {(r.doc_id, tuple(map(tuple, r.base))) for r in found.collect()}
    assert got == {(i, tuple(brute(t))) for i, t in rows}


def test_base_spans_equal_brute_force(spark, model):
    rows = list(enumerate(noisy(random.Random(5), 1500)))
    check_base(rows, personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model))


def test_edge_rows(spark, edge, edge_rows, empty, model):
    found = personal_data.find_personal(edge, model)
    assert found.count() == len(edge_rows)
    check_base([(r[0], r[1]) for r in edge_rows], found)
    assert personal_data.find_personal(empty).collect() == []
    nothing = personal_data.digests(personal_data.find_personal(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))).collect()
    assert {(r.doc_id, r.n_email, r.base_sha256, r.spans) for r in nothing} == {(i, 0, hashlib.sha256(b"").hexdigest(), "") for i in (1, None)}


def test_long_texts_and_many_matches(spark, model):
    rows = [(1, "x" * 10_000), (2, "7 " * 150_000), (3, "1.1.1.1 " * 30_000), (4, "a." * 4_000 + "@" + "b." * 3_000), (5, "é😀 q@r.st " * 20_000), (6, "+1 " * 100_000)]
    found = personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), model)
    check_base(rows, found)
    long = [(1, "x" * 3_000_000), (2, "a." * 500_000 + "@b.c")]  # the brute force would be quadratic here
    found = {r.doc_id: [tuple(s) for s in r.base] for r in personal_data.find_personal(spark.createDataFrame(long, "doc_id long, text string"), model).collect()}
    assert found == {1: [], 2: [("email", 0, 1_000_004)]}


def test_no_python_in_the_plan(docs, model):
    plan = personal_data.digests(personal_data.find_personal(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_margin_expression_is_the_ensemble(docs, model):
    rows = personal_data.generated(personal_data.planted(docs)).select(F.explode(personal_data.candidates()).alias("c")).select(F.col("c.x").alias("x"), F.expr(model.margin("c.x")).alias("m")).limit(500).collect()
    assert len(rows) == 500
    assert np.allclose(model.trees.margin(np.array([r.x for r in rows])), [r.m for r in rows])


def test_features_of_some_candidates(spark):
    rows = [(1, "tel. (472) 229-2486 and IBAN: DE89 3704 0044 0532 0130 00 end"), (2, "on 2024-05-17 pay 378282246310005 x")]
    got = personal_data.generated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode(personal_data.candidates()).alias("c")).select("doc_id", "c.*").collect()
    by = {(r.doc_id, KINDS[r.kind], r.start): dict(zip(personal_data.FEATURES, r.x, strict=True)) for r in got}
    phone = by[1, "phone_like", 5]
    assert (phone["digits"], phone["groups"], phone["brackets"], phone["cue_phone"], phone["luhn"]) == (10, 3, 1, 1, 0)
    assert by[1, "id_like", 30]["check97"] == 1 and by[1, "id_like", 30]["cue_account"] == 1
    assert by[2, "phone_like", 3]["date"] == 1
    card = by[2, "card_like", 18]
    assert (card["luhn"], card["digits"], card["length"]) == (1, 15, 15)


def test_planted_values_are_found(docs, model):
    """All rows of the planted table: nearly all positives with a cue, hardly any negatives."""
    rows = [r for r in personal_data.find_personal(personal_data.planted(docs).withColumn("k", F.struct("kind", "from", "to")), model, keep=("k", "text")).collect()]
    right = wrong = positives = 0
    for r in rows:
        mine = {(s.kind, s.start, s.end) for s in r.spans if s.kind not in BASE_KINDS}
        at = (r.k.kind, r.k["from"], r.k.to)
        positives += r.k.kind is not None
        right += at in mine
        wrong += len(mine - {at})
    assert set(model.least) >= {"email_like", "phone_like", "id_like"}
    assert right > 0.85 * positives and wrong < 0.02 * right


def test_written_addresses_and_phones_are_added(spark, model):
    text = "Please call (415) 229-2486 or write to anna.lee at example dot com, not to order 2024-05-17."
    spans = personal_data.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().spans
    assert {text[s.start : s.end] for s in spans} == {"(415) 229-2486", "anna.lee at example dot com"}


def test_added_spans_do_not_overlap(spark, model):
    rows = list(enumerate(noisy(random.Random(6), 600) + ["tel. 555-123-4567 555-123-4567 4111 1111 1111 1111 (212) 555-1234"] * 3))
    for r in personal_data.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        added = [s for s in r.spans if s.kind not in BASE_KINDS]
        base = [s for s in r.spans if s.kind in BASE_KINDS]
        assert not any(a.start < b.end and b.start < a.end for i, a in enumerate(added) for b in added[i + 1 :] + base)
        assert [(KINDS.index(s.kind), s.start) for s in r.spans] == sorted((KINDS.index(s.kind), s.start) for s in r.spans)


def test_calibrated_thresholds():
    margin, y = np.array([5.0, 4, 3, 2, 1] * 30), np.array([1.0, 1, 1, 0, 0] * 30)
    kind = np.full(150, KINDS.index("phone_like"))
    assert personal_data.calibrated(margin, y, kind) == {"phone_like": 3.0}
    assert personal_data.calibrated(margin, 1 - y, kind) == {}


def test_redaction(spark, model):
    rows = [(1, "mail x@y.zz or 10.0.0.1 now"), (2, None), (3, "nothing"), (4, "😀 +1 (017) 555-7713")]
    got = dict(personal_data.redact_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == {1: "mail [email] or [ip] now", 2: None, 3: "nothing", 4: "😀 [phone]"}


def test_same_model_again(docs, model):
    again = personal_data.train(docs.repartition(3))
    assert again.least == model.least and np.array_equal(again.trees.value, model.trees.value)


def test_query_on_the_given_tables(docs, model):
    got = {r.doc_id: r for r in personal_data.digests(personal_data.find_personal(docs)).collect()}
    for d in docs.collect():
        base, r = brute(d.text), got[d.doc_id]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[0] == k for s in base) for k in BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
