"""Intake of pages: actions, tables, and the same tables whatever is killed or repeated."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from offerscope.streaming.intake import PAGE, TABLES, Intake, intake_stream

T = datetime.datetime(2024, 5, 1)
FINANCE = "Finansman tutarı {n} TL olarak belirlendi. Kâr payı %{m} oranındadır, vade {k} ay."


def page(key, text, hour=0, bank="a", review=False, product="FINANSMAN"):
    return (key, bank, f"Title {key}", text, product, review, T + datetime.timedelta(hours=hour))


FIRST = [page(f"k{i:02}", FINANCE.format(n=1000 + i, m=i, k=i + 1)) for i in range(12)] + [page("copy", FINANCE.format(n=1000, m=0, k=1)), page("other", FINANCE.format(n=1000, m=0, k=1), bank="b"), page("odd", "Needs a look, this one", review=True), page("gone", " "), page(None, "no key")]
SECOND = [page("k00", FINANCE.format(n=1000, m=0, k=1), 5), page("k01", "An older text of this page", 4), page("k01", FINANCE.format(n=77, m=7, k=7), 6), page("new", FINANCE.format(n=1002, m=2, k=3), 5), page("k03", "Changed, and in review", 5, review=True), page("zz", "A fresh text for two pages"), page("yy", "A fresh text for two pages")]
THIRD = [page("k05", FINANCE.format(n=1001, m=1, k=2), 9), page("late", FINANCE.format(n=77, m=7, k=7), 9)]


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def tables(intake):
    return {t: sorted(str(r.asDict()) for r in intake.table(t).collect()) for t in TABLES} | {"actions": sorted(str(r.asDict()) for r in intake.actions().collect())}


def actions(intake, batch):
    return {r.record_key: r.action for r in intake.actions().filter(F.col("batch") == batch).collect()}


def test_actions_and_tables(spark, tmp_path):
    it = Intake(spark, str(tmp_path), "v1", buckets=4)
    for n, rows in enumerate((FIRST, SECOND, THIRD)):
        it.apply(frame(spark, rows), n)
    assert actions(it, 0) == {f"k{i:02}": "inserted" for i in range(12) if i} | {"k00": "duplicate_content_skipped", "copy": "inserted", "other": "inserted", "odd": "review_queued"}
    assert actions(it, 1) == {"k00": "duplicate_content_skipped", "k01": "updated", "new": "duplicate_content_skipped", "k03": "review_queued", "yy": "inserted", "zz": "duplicate_content_skipped"}
    assert actions(it, 2) == {"k05": "updated", "late": "duplicate_content_skipped"}
    docs = {r.record_key: r for r in it.table("documents").collect()}
    assert set(docs) == {f"k{i:02}" for i in range(1, 12)} | {"copy", "other", "yy"} and "77" in docs["k01"].text
    assert {(r.record_key, r.digest) for r in it.table("digests").collect()} == {(k, r.digest) for k, r in docs.items()}
    facts = {}
    for r in it.table("facts").collect():
        facts.setdefault(r.record_key, set()).add(r.fact_text)
    assert facts["k01"] == {"77 tl", "%7", "7 ay"} and facts["k05"] == {"1001 tl", "%1", "2 ay"} and "yy" not in facts
    assert {r.record_key for r in it.table("chunks").collect()} == set(docs)
    assert {(r.record_key, r.reason) for r in it.table("reviews").collect()} == {("odd", "classification_review"), ("k03", "classification_review")}


def test_updates_not_allowed_and_new_version(spark, tmp_path):
    it = Intake(spark, str(tmp_path), "v1", buckets=2, allow_updates=False)
    it.apply(frame(spark, FIRST[:3]), 0)
    it.apply(frame(spark, [page("k01", "Another text entirely"), FIRST[2]]), 1)
    assert actions(it, 1) == {"k01": "changed_document_review_queued", "k02": "unchanged_skipped"}
    again = Intake(spark, str(tmp_path), "v2", buckets=2, allow_updates=False)
    again.apply(frame(spark, FIRST[:3]), 2)
    assert set(actions(again, 2).values()) == {"updated"} and {r.version for r in again.table("documents").collect()} == {"v2"}
    assert [r.reason for r in again.table("reviews").collect()] == ["existing_document_changed"]


@pytest.mark.parametrize("table", ["facts"])
def test_killed_and_repeated_batches(spark, tmp_path, monkeypatch, table):
    plain = Intake(spark, str(tmp_path / "plain"), "v1", buckets=3)
    torn = Intake(spark, str(tmp_path / "torn"), "v1", buckets=3)
    for n, rows in enumerate((FIRST, SECOND)):
        plain.apply(frame(spark, rows), n)
    torn.apply(frame(spark, FIRST), 0)
    before, replace = tables(torn), Intake._replace

    def dies(self, name, *rest):
        replace(self, name, *rest)
        if name == table:
            raise RuntimeError("killed")

    monkeypatch.setattr(Intake, "_replace", dies)
    with pytest.raises(RuntimeError):
        torn.apply(frame(spark, SECOND), 1)
    assert tables(torn) == before  # nothing of the half batch is seen
    monkeypatch.setattr(Intake, "_replace", replace)
    torn.apply(frame(spark, SECOND), 1)
    assert tables(torn) == tables(plain)
    torn.apply(frame(spark, FIRST), 1)  # a committed number again
    assert tables(torn) == tables(plain)


def test_stream(spark, tmp_path):
    for rows in (FIRST, SECOND, THIRD):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = Intake(spark, str(tmp_path / "whole"), "v1", buckets=3)
    pages = lambda: spark.readStream.schema(PAGE).parquet(str(tmp_path / "in"))
    intake_stream(pages(), whole, str(tmp_path / "c")).awaitTermination(240)
    intake_stream(pages(), whole, str(tmp_path / "c")).awaitTermination(240)
    assert whole.manifest()[0] == 0
    once = Intake(spark, str(tmp_path / "once"), "v1", buckets=3)
    once.apply(frame(spark, FIRST + SECOND + THIRD), 0)
    assert tables(whole) == tables(once)


def test_empty_and_missing_columns(spark, tmp_path):
    it = Intake(spark, str(tmp_path), "v1")
    assert it.manifest()[0] == -1 and it.table("documents").collect() == []
    it.apply(frame(spark, []), 0)
    assert it.manifest()[0] == 0 and it.table("facts").collect() == []
    it.apply(spark.createDataFrame([("x", "Only a key and a text", 1)], "record_key string, text string, more int"), 1)
    assert [(r.record_key, r.bank, r.product) for r in it.table("documents").collect()] == [("x", None, None)] and actions(it, 1) == {"x": "inserted"}
    it.apply(spark.createDataFrame([("y", "Only a key  and a text")], "record_key string, text string"), 2)
    assert actions(it, 2) == {"y": "duplicate_content_skipped"}
