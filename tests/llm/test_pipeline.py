from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from offerscope.llm.quality_rules import BASE, POLICIES, CURRENT, ledger
from offerscope.llm.secret_scan import base_spans
from offerscope.llm.shared import written
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_jaccard_join import shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


@pytest.mark.parametrize(("usual", "most"), [("10000", 1000), ("0", 1000), ("70", 70)])
def test_stages_get_texts_in_small_batches(spark, usual, most):
    docs = spark.createDataFrame([(i, "a word", None, None, None) for i in range(2500)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for _, stage in corpus_pipeline.STAGES[::3]:  # those that do no work before their result is written
            spark.conf.set(setting, usual)
            stage(spark, docs, SF)
            sizes = docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) == most
    finally:
        spark.conf.set(setting, before)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_rules_keep_what_the_policy_keeps(stages):
    bad = {r.doc_id for r in ledger(stages[0]).collect() if r.failed_bits & (BASE | POLICIES[CURRENT])}
    assert 0 < len(bad) and rows(stages[1]) == [r for r in rows(stages[0]) if r[0] not in bad]


def test_one_of_each_group_stays(stages):
    docs = rows(stages[1])
    sets = {r[0]: shingles(r[1], 5) for r in docs}
    kept = {r[0] for r in rows(stages[2])}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    assert kept == {i for i in up if up[i] == i} and len(kept) < len(sets)


def test_contaminated_documents_go(stages):
    bench = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    leaks = {i for i, *_ in contained([r[:2] for r in rows(stages[2])], bench)}
    assert leaks and rows(stages[3]) == [r for r in rows(stages[2]) if r[0] not in leaks]


def test_secrets_are_masked_and_the_rest_is_as_before(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert [r[0] for r in before] == [r[0] for r in after]
    for b, a in zip(before, after, strict=True):
        assert not base_spans(a[1]) and a[4] == len(a[1]) and a[2:4] == b[2:4]
        if not base_spans(b[1]) and "is " not in b[1]:
            assert a[1] == b[1]


def test_packing_holds_every_id_once(stages):
    real = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in stages[5].collect():
        by[r.doc_id].append(r)
    assert len(by) == stages[4].count()
    for doc, text, *_ in rows(stages[4]):
        ids = np.array(real.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_edges(spark, edge, edge_rows, empty):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 1, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    ids = [r.doc_id for r in kept.filter("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) and kept.filter("doc_id is null").count() == 2


def test_further_columns_of_any_name_are_carried(spark, edge):
    docs = edge.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS row", "'k' AS key", "doc_id AS component", "named_struct('a', 1) AS first", "map('x', 2) AS kept_id", "array(doc_id) AS doc", "2.5D AS rep", "date'2020-01-01' AS `a b`", "doc_id AS item_id", "lang AS h", "3 AS place")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        plain = stage(spark, edge.select("doc_id", "text", "lang", "source", "n_chars"), SF)
        assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str((r.doc_id, r.text)) for r in plain.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (3, b.replace("b20", "other")), (4, "c " + b), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted([(1, a), (1, b), (3, rows[4][1]), (5, "")])


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()
