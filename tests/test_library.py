"""Goldens for what SQL cannot express, on small hand-made tables."""

from __future__ import annotations

import datetime
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerscope.functions import text as X
from offerscope.operators import chunk, curate, embed, evaluate, facts, questions, review, typed_rules
from offerscope.plans import QUERIES
from offerscope.plans.facts import RULES as FACT_RULES
from offerscope.sources import files, html
from offerscope.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(("raw", "mode", "value"), [("1.250,75", "last", 1250.75), ("1,250", "last", 1250), ("%2,05", "last", 2.05), ("2.05 %", "last", 2.05), ("1,250.75", "last", 1250.75), ("1,250.75", "dots", 1.25075), ("1,250", "comma", 1.25), ("1.250", "comma", 1250), ("1.5", "comma", 1.5), ("none", "last", None)])
def test_numbers(spark, raw, mode, value):
    assert one(spark, X.parse_number("c0", mode), raw) == value


def test_folding_and_urls(spark):
    assert one(spark, X.fold_text("c0"), " İSTANBUL  Iğdır\nŞÇÖ ") == "istanbul igdir sco"
    assert one(spark, X.canonical_url_archive("c0"), "http://WWW.a.com//x%20y//?q=1#f") == "https://a.com/x y"
    assert one(spark, X.canonical_url_offer("c0"), "HTTP://A.com:80/p/?utm_source=1&b=2&a=1#f") == "http://a.com/p?a=1&b=2"
    assert one(spark, X.canonical_url_offer("c0"), "http://a.com:8080/p?ref=1") == "http://a.com:8080/p"
    assert one(spark, X.dates_in_text("c0"), "31.02.2024, 5 Mart 2023 ve 2024-01-09") == [datetime.date(2023, 3, 5), datetime.date(2024, 1, 9)]


def test_blocks_sections_and_windows():
    assert curate._collapse("a\na\nb\nc\nb\nc\nd") == "a\nb\nc\nd"
    assert chunk.is_heading("KREDI KARTLARI") and chunk.is_heading("# Title") and chunk.is_heading("Rates:") and not chunk.is_heading("this is a plain sentence.")
    body = " ".join(["word"] * 30)
    assert [h for h, _ in chunk.sections(f"# A\n{body}\n# B\n{body}")] == ["A", "A > B"]
    words = [f"w{i}" for i in range(500)]
    words[200] = "end."
    parts = list(chunk.word_windows(words, 220, 40))
    assert len(parts[0]) == 201 and parts[1][0] == "w161" and parts[-1][-1] == "w499"


def test_near_duplicates_and_labels(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base + " more"), (4, " ".join(f"x{i}" for i in range(300))), (5, None)]
    got = {r.doc_id: r.cluster for r in curate.near_dup_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.label) for r in curate.least_labels(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_rules_and_decisions(spark):
    docs = spark.createDataFrame([(1, "Kampanya 2024 yili icinde gecerli. Limit 50000 TL olarak. Token 123456 degil.")], "doc_id long, text string")
    rules = [{"fact_type": "year", "pattern": r"\b(20\d\d)\b", "confidence": 0.9}, {"fact_type": "amount", "pattern": r"\b(\d{5,})\b", "confidence": 0.9, "excluded": "token", "radius": 10}]
    found = facts.cap_facts(facts.apply_rules(facts.segments(docs), rules))
    assert sorted((r.fact_type, r.fact_text) for r in found.collect()) == [("amount", "50000"), ("year", "2024")]
    cue = facts.nearest_cue(F.col("c0"), F.instr("c0", "5"), {"spend": "spend", "reward": "reward"})
    assert one(spark, cue, "spend a lot and get 5 reward") == "reward" and one(spark, cue, "for spend 5 you will later get a reward") == "spend"
    assert one(spark, facts.evidence_window(F.col("c0"), F.lit(15), F.lit(18)), "First part is. The one here! Next") == "The one here!"


def test_review_sheet_and_frozen_columns(spark):
    rows = spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending"), (3, "c", "approved"), (4, "d", "pending")], "key long, label string, status string")
    sheet = spark.createDataFrame([(1, "e", None), (2, "H", None), (3, "H", "z"), (4, "", "fixed")], "key long, answer string, new_label string")
    assert sorted(map(tuple, review.apply_review_sheet(rows, sheet).collect())) == [(1, "a", "approved"), (2, "b", "rejected"), (3, "c", "approved"), (4, "fixed", "approved")]


def test_session_state_is_inherited_until_the_topic_changes(spark):
    rows = [("s", 1, "A", None, False), ("s", 2, None, "rate", False), ("s", 3, None, None, True), ("s", 4, "B", None, False), ("t", 1, None, "x", False)]
    got = questions.fold_session(spark.createDataFrame(rows, "conv_id string, turn int, bank string, field string, change boolean"), ["bank", "field"], "change")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("s", 1, "A", None), ("s", 2, "A", "rate"), ("s", 3, None, None), ("s", 4, "B", None), ("t", 1, None, "x")], key=str)


def test_sources_and_sinks(spark, tmp_path):
    lines = ['{"kayit_id":"k1","kaynak_url":"http://a","ham_metin":"metin","guncel_mi":false}', '{"kayit_id":"","kaynak_url":"http://b","ham_metin":"baska","guncel_mi":false}', '{"kayit_id":"k3","kaynak_url":"http://c","ham_metin":"x"}', "not json"]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    got = sorted(r.kayit_id for r in files.read_pages(spark, str(tmp_path / "p.jsonl")).collect())
    assert got[1] == "k1" and got[0].startswith("archive-") and len(got) == 2
    rows = spark.range(20).selectExpr("id", "id AS v")
    files.write_versioned(rows, str(tmp_path / "t"), "id", 4)
    files.write_versioned(rows.filter("id = 3").withColumn("v", F.lit(-1).cast("long")), str(tmp_path / "u"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    sheet = spark.createDataFrame([(1, 0.2), (2, None), (3, 0.9)], "k long, c double")
    files.write_review_csv(sheet, str(tmp_path / "s"), "c", "k", ["ONAY"])
    assert {r.k for r in files.read_review_csv(spark, str(tmp_path / "s"), "ONAY").collect()} == {"1", "2", "3"}
    page = spark.createDataFrame([(1, "<title>T</title><nav>menu</nav><p>one</p><script>x()</script><p>two"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, html.html_to_text(page).collect())) == [(1, "T", "one\ntwo"), (2, "", "")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", datetime.datetime(2024, 1, 1)), ("a", "x", datetime.datetime(2024, 1, 1, 1)), ("a", "y", datetime.datetime(2024, 1, 1, 2))], "record_key string, text string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_table_stream(spark, str(tmp_path / "in"), rows.schema)
    q = jobs.review_counts_stream(stream.withColumnRenamed("text", "status")).writeStream.outputMode("complete").format("memory").queryName("review_counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.status, r.n) for r in spark.sql("SELECT * FROM review_counts").collect()} == {("x", 2), ("y", 1)}


def test_session_hits_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(q, p, int(rng.integers(30)), f"o{rng.integers(6)}", int(rng.integers(8))) for q in range(40) for p in range(1, 13)]
    schema = "query_id long, place long, chunk_id long, offer_id string, doc_id long"
    fresh, session = [r for r in rows if r[1] <= 5 and r[0] % 9], [r for r in rows if r[1] > 5 and r[0] % 7]
    expected = []
    for q in range(40):
        kept = [r[2:] for r in fresh if r[0] == q]
        own = len(kept)
        for r in (r[2:] for r in session if r[0] == q):
            if all(r[0] != k[0] for k in kept) and sum(r[1] == k[1] for k in kept) < 2 and sum(r[2] == k[2] for k in kept) < 2:
                kept.append(r)
        expected += [(q, i + 1, *k, i >= own) for i, k in enumerate(kept)]
    got = questions.merge_session_hits(spark.createDataFrame(fresh, schema), spark.createDataFrame(session, schema))
    assert sorted(map(tuple, got.collect())) == expected


def test_bio_rows(spark):
    text = "Vade 36 ay, oran %2,05 ve 36 ay."
    assert evaluate.bio_tags(text, [("36", "N"), ("36 ay", "T"), ("2,05", "R"), ("none", "X"), ("", "E")]) == (["Vade", "36", "ay", ",", "oran", "%", "2,05", "ve", "36", "ay", "."], ["O", "B-T", "I-T", "O", "O", "O", "B-R", "O", "O", "O", "O"])
    assert evaluate.bio_tags("ab cd", [("b c", "S")]) == (["ab", "cd"], ["B-S", "I-S"]) and evaluate.bio_tags(text, [("none", "X")]) is None
    rows = [(1, text, "36 ay", "T"), (1, text, "36 ay", "T"), (2, text, "none", "T"), (3, None, "x", "T"), (4, text, None, "T")]
    got = evaluate.silver_bio_rows(spark.createDataFrame(rows, "doc_id long, evidence string, fact_text string, label string")).collect()
    assert [(r.doc_id, r.tags.count("B-T")) for r in got] == [(1, 1)]


def test_claimed_facts(spark):
    docs = spark.createDataFrame([(1, "Vade: 36\n ay (sabit) olarak.  Masraf yok"), (2, None)], "doc_id long, text string")
    rows = [(1, "VADE_SURESI", "36 AY", "vade: 36 ay (SABIT)", 0.9), (1, "VADE_SURESI", "36", "Masraf yok", 0.9), (1, "VADE_SURESI", "yok", "Masraf  yok", 0.9), (1, "X", "a.b", "Vade. 36", 0.9), (1, "X", "36", "Vade", 0.1), (2, "X", "x", "x", 0.9), (3, "X", "x", "x", 0.9), (1, "X", "x", "  ", 0.9)]
    got = facts.validate_claimed_facts(spark.createDataFrame(rows, "doc_id long, fact_type string, fact_text string, evidence string, confidence double"), docs, 0.5)
    assert sorted((r.doc_id, r.evidence, r.reason or "") for r in got.collect()) == sorted(
        [(1, "Vade: 36\n ay (sabit)", ""), (1, "Masraf yok", "fact_not_in_evidence"), (1, "Masraf yok", "label_rule_failed"), (1, "Vade. 36", "evidence_not_in_source"), (1, "Vade", "low_confidence"), (2, "x", "evidence_not_in_source"), (3, "x", "evidence_not_in_source"), (1, "  ", "evidence_not_in_source")]
    )


def test_channels(spark):
    rows = [(1, "Mobil şubeden ve şubelerimizden başvurun"), (2, "Başvuru: şubeye hiç gitmeden mobil uygulamadan"), (3, "Mobil şube açık")]
    got = facts.channel_rules(spark.createDataFrame(rows, "doc_id long, segment string").withColumn("at", F.lit(0)))
    assert sorted((r.doc_id, r.fact_text) for r in got.collect()) == [(1, "subeden"), (2, "mobil uygulamadan")]


def test_embedding_of_chunks(spark):
    texts = ["a b a", "", None, "x " * 3000]
    got = {r.k: r.embedding for r in embed.embed_chunks(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), embed.hashing_embedder(16), 16, size=2).collect()}
    plain = embed.hashing_embedder(16)([t or "" for t in texts])
    for k, v in enumerate(plain):
        assert np.allclose(got[k], v / (np.linalg.norm(v) or 1), atol=1e-6)
    with pytest.raises(Exception, match="embeddings of shape"):
        embed.embed_chunks(spark.createDataFrame([(1, "a")], "k long, text string"), embed.hashing_embedder(8), 16).collect()


def test_labelled_dataset(spark, tmp_path):
    for folder in ("ara", "final/siniflandirma", "final/bilgi_cikarim"):
        (tmp_path / folder).mkdir(parents=True)
    mark = "\ufeff"
    (tmp_path / "ara/dokumanlar.jsonl").write_text(mark + '{"kayit_id":"k","ham_metin":"metin"}\n\n{"kayit_id":"l","dogrulandi":true}\n')
    (tmp_path / "ara/pasajlar.jsonl").write_text(mark + '{"pasaj_id":"p","kayit_id":"k","metin":"36 ay","spanlar":[{"baslangic":0,"bitis":2,"etiket":"N","metin":"36"},{"baslangic":3,"bitis":5,"etiket":"B","metin":"ay"}]}\n{"pasaj_id":"q","kayit_id":"k"}\n')
    for s in files.SPLITS:
        (tmp_path / f"final/siniflandirma/{s}.jsonl").write_text(f'{{"id":"{s}1","etiket_kod":"A"}}\n')
        (tmp_path / f"final/bilgi_cikarim/{s}.jsonl").write_text(f'{{"id":"{s}2","tokens":["a"],"ner_tags":["O"]}}\n')
    got = files.read_labelled(spark, str(tmp_path))
    assert sorted((r.kayit_id, r.dogrulandi) for r in got["documents"].collect()) == [("k", False), ("l", True)]
    assert sorted((r.pasaj_id, r.span_index, r.etiket) for r in got["spans"].collect()) == [("p", 0, "N"), ("p", 1, "B")]
    assert got["passages"].count() == 2 and sorted((r.split, r.id) for r in got["class_samples"].collect()) == [("test", "test1"), ("train", "train1"), ("val", "val1")]
    (tmp_path / "ara/dokumanlar.jsonl").write_text("no json\n")
    with pytest.raises(Exception):
        files.read_labelled(spark, str(tmp_path))["documents"].collect()


def test_session_state_stream_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"c{i % 6}", i // 6, f"said {i}", *(None if rng.random() < 0.5 else f"v{rng.integers(3)}" for _ in range(2)), bool(rng.random() < 0.2)) for i in range(90)]
    schema = "conv_id string, turn long, text string, bank string, field string, change boolean"
    for n in range(3):  # three files are three batches; the second holds repeats of the first
        spark.createDataFrame(rows[30 * max(0, n - (n == 1)) : 30 * (n + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.session_state_stream(stream, ["bank", "field"], "change", 40).writeStream.outputMode("append").format("memory").queryName("session_state").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM session_state").collect()
    table = questions.fold_session(spark.createDataFrame(rows, schema), ["bank", "field"], "change")
    assert sorted(((r.conv_id, r.turn, r.bank, r.field) for r in got), key=str) == sorted(map(tuple, table.collect()), key=str)
    assert all(r.version == r.turn + 1 and len(r.summary) <= 40 for r in got)
    assert {r.summary for r in got if r.conv_id == "c0" and r.turn == 14} == {"12: said 72\n13: said 78\n14: said 84"}


def test_typed_rules_by_relevance_and_distance(spark):
    far = "x" * 60
    rows = [
        (1, "FINANSMAN", "Vade 12 ay, ödemesiz dönem 3 ay", []), (2, "FINANSMAN", f"Vade {far} 12 ay", []), (3, "FINANSMAN", "Gerekli belgeler: kimlik ve tapu", ["konut"]), (4, "FINANSMAN", "Konut için gerekli belgeler: kimlik", ["konut"]),
        (5, "HESAP_YATIRIM", "Kâr paylaşım oranı 80 / 20", None), (6, None, "Emeklilere yönelik kampanya", []), (7, "FINANSMAN", None, []), (8, "KART", "Finansman tutarı 5 TL", []),
    ]
    df = spark.createDataFrame(rows, "doc_id long, product string, segment string, keywords array<string>").withColumn("at", F.lit(0))
    got = typed_rules.typed_rules(df)
    assert sorted((r.doc_id, r.fact_type, r.fact_text) for r in got.collect()) == [
        (1, "ODEMESIZ_DONEM", "12 ay"), (1, "ODEMESIZ_DONEM", "3 ay"), (4, "GEREKLI_BELGELER", "konut icin gerekli belgeler: kimlik"), (5, "KAR_PAYLASIM_ORANI", "80 / 20"), (6, "HEDEF_KITLE", "emeklilere"),
    ]
    assert tuple(got.filter("doc_id = 5").select(typed_rules.sharing_ratio(F.col("fact_text")).alias("r")).first().r) == (80, 20)


def brute_rules(text, rules):
    text, out = text.lower(), set()
    for i, r in enumerate(rules):
        for m in re.finditer(r["pattern"], text):
            around = text[max(m.start(1) - 60, 0) : m.end(1) + 60]
            if re.search(r.get("required") or "", around) and not (r.get("excluded") and re.search(r["excluded"], around)):
                out.add((r["fact_type"], m[1], i))
    return out


def test_rules_find_all_matches(spark):
    texts = {
        1: "from 1999 to 2004 and 1999 again, then 2031",
        2: "token 1234567 " + "x " * 40 + "but 7654321 and 55555 here",
        3: "99999 first " + "y " * 40 + "token 99999 and 88888",
        4: "licensed under a, b. also: licensed under c",
        5: "nothing of the kind",
    }
    docs = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "doc_id long, at int, segment string")
    rows = facts.apply_rules(docs, FACT_RULES).collect()
    found = {k: {(r.fact_type, r.fact_text, r.ordinal) for r in rows if r.doc_id == k} for k in texts}
    assert found == {k: brute_rules(v, FACT_RULES) for k, v in texts.items()}
    assert {x[1] for x in found[1]} == {"1999", "2004", "2031"} and {x[1] for x in found[2]} == {"7654321", "55555"} and {x[1] for x in found[3]} == {"99999"}


def test_rule_query_equals_brute_force(spark):
    segments = QUERIES["f1_segments"](spark, SF).collect()
    expected = sorted((r.doc_id, r.place, *f) for r in segments for f in brute_rules(r.segment, FACT_RULES))
    got = sorted((r.doc_id, r.place, r.fact_type, r.fact_text, r.ordinal) for r in QUERIES["fact_rules_with_evidence"](spark, SF).collect())
    assert got == expected and "number" in {x[2] for x in got}  # years do not occur in this table
