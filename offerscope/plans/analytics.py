"""Queries of section I on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.adapters import DOCS, FACTS, SNAPS
from offerscope.operators import analytics as op
from offerscope.registry import query

MATRIX = f"""{DOCS}, {FACTS},
ranked AS (SELECT doc_id, bank, product, confidence, row_number() OVER (PARTITION BY product, bank ORDER BY confidence DESC NULLS LAST, doc_id) AS bank_rank FROM docs),
chosen AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY bank_rank, bank, doc_id) AS place FROM ranked WHERE bank_rank <= 40 QUALIFY place <= 40),
m AS (SELECT c.*, f.fact_type, f.fact_text, f.value, f.n FROM chosen c LEFT JOIN facts f USING (doc_id)),
dd AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, lower(trim(fact_text)) ORDER BY n, value) = 1)"""


def _matrix(spark, d):
    return op.dedup_attributes(op.comparison_matrix(A.docs(spark, d), A.facts(spark, d), 40))


@query("comparison_matrix", f"WITH {MATRIX} SELECT doc_id, bank, product, confidence, bank_rank, place, fact_type, fact_text, value, n FROM dd")
def comparison_matrix(spark, d):
    return _matrix(spark, d)


@query("i1_available_facts", f"""WITH {FACTS}, e AS (SELECT * FROM facts WHERE n = 1), g AS (SELECT * FROM facts WHERE n > 1)
SELECT provenance, fact_type, count(*) AS n_facts, sum(value) AS total FROM (SELECT *, 'entity' AS provenance FROM e UNION ALL SELECT *, 'generated' FROM g) GROUP BY ALL""")
def i1(spark, d):
    f = A.facts(spark, d)
    return op.available_facts(f.filter("n = 1"), f.filter("n > 1")).groupBy("provenance", "fact_type").agg(F.count("*").alias("n_facts"), F.sum("value").alias("total"))


@query("i2_comparison_options", f"WITH {DOCS} SELECT product, count(*) AS pages, count(DISTINCT bank) AS banks FROM docs GROUP BY product")
def i2(spark, d):
    return A.docs(spark, d).groupBy("product").agg(F.count("*").alias("pages"), F.countDistinct("bank").alias("banks"))


@query("i4_attribute_map", f"WITH {MATRIX} SELECT doc_id, fact_type, string_agg(fact_text, ';' ORDER BY n, fact_text) AS texts FROM dd WHERE fact_type IS NOT NULL GROUP BY ALL")
def i4(spark, d):
    return op.attribute_map(_matrix(spark, d))


@query("i5_bank_columns", f"""WITH {DOCS}, {FACTS}, p AS (SELECT bank, count(*) AS pages, arg_max(doc_id, (coalesce(confidence, -1), -doc_id)) AS best_doc FROM docs GROUP BY bank),
o AS (SELECT bank, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT fact_type)), ',') AS fact_types FROM docs JOIN facts USING (doc_id) GROUP BY bank)
SELECT bank, pages, best_doc, coalesce(n_facts, 0) AS n_facts, coalesce(fact_types, '') AS fact_types FROM p LEFT JOIN o USING (bank)""")
def i5(spark, d):
    return op.bank_columns(A.docs(spark, d), A.facts(spark, d))


@query("i6_visible_fact_types", f"""WITH {DOCS}, {FACTS} SELECT fact_type, count(DISTINCT bank) AS banks, CASE fact_type WHEN 'R' THEN 0 ELSE 1 END AS profile FROM docs JOIN facts USING (doc_id) GROUP BY fact_type
ORDER BY profile, banks DESC, fact_type LIMIT 12""")
def i6(spark, d):
    return op.visible_fact_types(A.docs(spark, d), A.facts(spark, d), ["R"])


@query("i7_bank_highlights", f"""WITH {DOCS}, {FACTS}, o AS (SELECT bank, count(*) AS n_facts, max(value) AS top_value, arg_max(fact_text, (value, fact_text)) AS top_text FROM docs JOIN facts USING (doc_id) GROUP BY bank)
SELECT *, n_facts = max(n_facts) OVER () AS most_facts, top_value = max(top_value) OVER () AS largest FROM o""")
def i7(spark, d):
    return op.bank_highlights(A.docs(spark, d), A.facts(spark, d))


@query("i8_sort_comparison", f"""WITH {DOCS}, {FACTS}, o AS (SELECT bank, count(DISTINCT fact_type) AS cover, max(value) AS top FROM docs LEFT JOIN facts USING (doc_id) GROUP BY bank)
SELECT bank, cover, top, row_number() OVER (ORDER BY cover DESC, top DESC NULLS LAST, bank) AS place FROM o""")
def i8(spark, d):
    from pyspark.sql import Window

    rows = A.docs(spark, d).join(A.facts(spark, d), "doc_id", "left").groupBy("bank").agg(F.countDistinct("fact_type").alias("cover"), F.max("value").alias("top"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cover"), F.col("top").desc_nulls_last(), "bank")))  # one row for each bank


# Banks with Turkish names, and facts that state months, years and amounts, from the given order lines.
_NAMES = ("Işık Bankası", "İlk Katılım", "Şeker Finans", "Sağlam Katılım", "Çınar Bank", "Zirve", "Öz Katılım", "Ufuk", "Ilgaz", "İzmir Bank")
_STATED = f"""d AS (SELECT s_suppkey AS doc_id, list_extract([{', '.join(f"'{n}'" for n in _NAMES)}], s_suppkey % 10 + 1) AS bank, CASE WHEN s_suppkey % 4 > 0 THEN round(s_acctbal / 10000, 4) END AS confidence FROM supplier),
f AS (SELECT l_suppkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'VADE_SURESI' WHEN 'R' THEN 'FINANSMAN_TUTARI' ELSE 'DIGER' END AS fact_type, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN l_partkey % 9 || ' yıl' WHEN l_returnflag = 'A' THEN l_quantity::INT || ' ay' WHEN l_returnflag = 'R' THEN l_partkey || '.000,5 TL' ELSE 'kosul ' || l_linenumber END AS fact_text FROM lineitem),
u AS (SELECT DISTINCT bank, fact_type, fact_text, replace(replace(regexp_extract(fact_text, '[0-9][0-9.]*(,[0-9]+)?'), '.', ''), ',', '.')::DOUBLE * CASE WHEN fact_text LIKE '%yıl%' THEN 12 ELSE 1 END AS v FROM f JOIN d USING (doc_id)),
b AS (SELECT bank, max(n) AS n_facts, max(confidence) AS confidence, max(m) AS months, max(mt) AS months_text, max(a) AS amount, max(at_) AS amount_text FROM (SELECT bank, 0 AS n, coalesce(max(confidence), 0) AS confidence, 0.0::DOUBLE AS m, NULL AS mt, 0.0::DOUBLE AS a, NULL AS at_ FROM d GROUP BY bank
  UNION ALL SELECT bank, count(*), 0, coalesce(max(v) FILTER (fact_type = 'VADE_SURESI'), 0), min_by(fact_text, (-v, fact_text)) FILTER (fact_type = 'VADE_SURESI'), coalesce(max(v) FILTER (fact_type = 'FINANSMAN_TUTARI'), 0), min_by(fact_text, (-v, fact_text)) FILTER (fact_type = 'FINANSMAN_TUTARI') FROM u GROUP BY bank) GROUP BY bank)"""


def _compared(spark, d):
    s, l = A.table(spark, d, "supplier"), A.table(spark, d, "lineitem")  # noqa: E741
    docs = s.select(F.col("s_suppkey").alias("doc_id"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 10).cast("int")).alias("bank"), F.when(F.col("s_suppkey") % 4 > 0, F.round(F.col("s_acctbal") / 10000, 4)).alias("confidence"))
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    text = F.when((flag == "A") & (n == 1), F.concat((F.col("l_partkey") % 9).cast("string"), F.lit(" yıl"))).when(flag == "A", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ay"))).when(flag == "R", F.concat(F.col("l_partkey").cast("string"), F.lit(".000,5 TL"))).otherwise(F.concat(F.lit("kosul "), n.cast("string")))
    facts = l.select(F.col("l_suppkey").alias("doc_id"), F.when(flag == "A", "VADE_SURESI").when(flag == "R", "FINANSMAN_TUTARI").otherwise("DIGER").alias("fact_type"), text.alias("fact_text"))
    return op.compare_banks(docs, facts)


@query("i8_sort_modes", f"""WITH {_STATED} SELECT 'coverage' AS mode, bank, row_number() OVER (ORDER BY n_facts DESC, bank COLLATE tr)::INT AS place FROM b UNION ALL SELECT 'bank', bank, row_number() OVER (ORDER BY bank COLLATE tr) FROM b UNION ALL SELECT 'confidence', bank, row_number() OVER (ORDER BY confidence DESC, bank COLLATE tr) FROM b
UNION ALL SELECT 'maturity', bank, row_number() OVER (ORDER BY months DESC, bank COLLATE tr) FROM b UNION ALL SELECT 'amount', bank, row_number() OVER (ORDER BY amount DESC, bank COLLATE tr) FROM b""")
def i8_modes(spark, d):
    banks = _compared(spark, d)
    out = [op.sort_comparison(banks, m).select(F.lit(m).alias("mode"), "bank", "place") for m in op.MODES]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("i7_comparison_highlights", f"""WITH {_STATED} (SELECT 'coverage' AS highlight, bank, n_facts::VARCHAR AS value FROM b ORDER BY n_facts DESC, bank COLLATE tr LIMIT 1) UNION ALL (SELECT 'maturity', bank, months_text FROM b WHERE months > 0 ORDER BY months DESC, bank COLLATE tr LIMIT 1) UNION ALL (SELECT 'amount', bank, amount_text FROM b WHERE amount > 0 ORDER BY amount DESC, bank COLLATE tr LIMIT 1)""")
def i7_highlights(spark, d):
    return op.comparison_highlights(_compared(spark, d))


_PERIOD = f"""{DOCS}, {FACTS}, b AS (SELECT bank, fact_type, fact_text, doc_id FROM docs JOIN facts USING (doc_id)),
now AS (SELECT bank, array_to_string(list_sort(list(DISTINCT fact_type || '=' || fact_text)), '|') AS s, count(*) AS n FROM b WHERE doc_id % 2 = 0 GROUP BY bank),
old AS (SELECT bank, array_to_string(list_sort(list(DISTINCT fact_type || '=' || fact_text)), '|') AS s, count(*) AS n FROM b WHERE doc_id % 2 = 1 GROUP BY bank)"""


@query("i9_period_change", f"WITH {_PERIOD} SELECT coalesce(now.bank, old.bank) AS bank, now.s IS DISTINCT FROM old.s AS changed, coalesce(now.n, 0) - coalesce(old.n, 0) AS fact_delta, coalesce(old.n, 0) AS baseline FROM now FULL JOIN old ON now.bank = old.bank")
def i9(spark, d):
    rows = A.docs(spark, d).select("doc_id", "bank").join(A.facts(spark, d), "doc_id")
    return op.period_change(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"))


@query("i10_period_bounds", f"WITH {SNAPS} SELECT (max(day) - INTERVAL 3 MONTH)::DATE AS from_day, max(day) AS to_day FROM snaps")
def i10(spark, d):
    return op.period_bounds(A.snapshots(spark, d), 3)


@query("i11_catalog", f"""WITH {DOCS}, {FACTS}, n AS (SELECT doc_id, count(*) AS n_facts FROM facts GROUP BY doc_id),
r AS (SELECT doc_id, bank, product, confidence, (title ILIKE '%the%')::INT * 4 + (text ILIKE '%the%')::INT * 2 + (bank ILIKE '%the%')::INT + coalesce(confidence, 0) AS relevance, coalesce(n_facts, 0) AS n_facts
FROM docs LEFT JOIN n USING (doc_id) WHERE (title ILIKE '%the%' OR text ILIKE '%the%' OR bank ILIKE '%the%') AND product = 'en' AND coalesce(n_facts, 0) > 0)
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY relevance DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 20""")
def i11(spark, d):
    return op.catalog(A.docs(spark, d), A.facts(spark, d), "the", product="en", has_facts=True, page=2)


@query("i11_catalog_by_title", f"""WITH {DOCS}, {FACTS}, n AS (SELECT doc_id, count(*) AS n_facts FROM facts GROUP BY doc_id), r AS (SELECT doc_id, bank, product, confidence, (title ILIKE '%a%')::INT * 4 + (text ILIKE '%a%')::INT * 2 + (bank ILIKE '%a%')::INT + coalesce(confidence, 0) AS relevance, coalesce(n_facts, 0) AS n_facts, lower(title) AS t
FROM docs LEFT JOIN n USING (doc_id) WHERE (title ILIKE '%a%' OR text ILIKE '%a%' OR bank ILIKE '%a%')) SELECT * EXCLUDE (t), (SELECT count(*) FROM r) AS total FROM r ORDER BY t ASC NULLS LAST, doc_id DESC LIMIT 20""")
def i11_title(spark, d):
    return op.catalog(A.docs(spark, d), A.facts(spark, d), "a", sort="title", descending=False)


@query("i12_document_detail", f"""WITH {FACTS}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_type, lower(trim(fact_text)) ORDER BY n, value) AS rn FROM facts)
SELECT d.doc_id, d.lang, x.fact_type, x.fact_text, x.n FROM documents d JOIN benchmark b ON d.doc_id = b.item_id LEFT JOIN (SELECT * FROM x WHERE rn = 1) x ON x.doc_id = d.doc_id""")
def i12(spark, d):
    ids = A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    rows = A.table(spark, d, "documents").select("doc_id", "lang").join(ids, "doc_id")
    return rows.join(op.dedup_attributes(A.facts(spark, d)), "doc_id", "left").select("doc_id", "lang", "fact_type", "fact_text", "n")


@query("i13_dashboard", f"""WITH {DOCS}, {FACTS}, {SNAPS}, h AS (SELECT DISTINCT doc_id, 1 AS has FROM facts), c AS (SELECT count(*) AS n, count(has) AS w FROM docs LEFT JOIN h USING (doc_id))
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT bank) FROM docs) AS banks, (SELECT count(*) FILTER (verified) FROM docs) AS verified, (SELECT round(avg(confidence), 4) FROM docs) AS avg_confidence,
(SELECT count(*) FROM facts) AS facts, c.w AS with_facts, c.n - c.w AS gap, round_even(100 * c.w / c.n, 1) AS percent, s.* FROM c, (SELECT count(*) AS snapshots, count(*) FILTER (searchable) AS searchable, min(day) AS first_day, max(day) AS last_day FROM snaps) s""")
def i13(spark, d):
    return op.dashboard(A.docs(spark, d), A.facts(spark, d), A.snapshots(spark, d))


@query("i14_eligible_coverage", f"""WITH {DOCS}, {FACTS}, h AS (SELECT DISTINCT doc_id, 1 AS has FROM facts), c AS (SELECT count(*) AS n, count(has) AS w FROM docs LEFT JOIN h USING (doc_id) WHERE product IN ('en', 'de') AND trim(text) <> '')
SELECT n AS documents, w AS with_facts, n - w AS gap, round_even(100 * w / n, 1) AS percent FROM c""")
def i14(spark, d):
    return op.coverage(A.docs(spark, d).filter("product in ('en', 'de') and trim(text) <> ''"), A.facts(spark, d))


_BUCKETS = "SELECT coalesce({k}::VARCHAR, 'unlabelled') AS key, count(*) AS n FROM {t} GROUP BY ALL"


@query("i15_buckets", f"WITH {DOCS}, g AS ({_BUCKETS.format(k='confidence::INT', t='docs')}) SELECT key, n, round_even(100 * n / sum(n) OVER (), 1) AS share FROM g")
def i15(spark, d):
    return op.buckets(A.docs(spark, d).withColumn("confidence", F.col("confidence").cast("int")), "confidence")


@query("i16_merge_buckets", f"WITH {SNAPS}, a AS ({_BUCKETS.format(k='lang', t='documents')}), b AS ({_BUCKETS.format(k='product', t='snaps')}), g AS (SELECT key, sum(n)::BIGINT AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY key) SELECT key, n, round(100 * n / sum(n) OVER (), 1) AS share FROM g")
def i16(spark, d):
    return op.merge_buckets(op.buckets(A.table(spark, d, "documents"), "lang"), op.buckets(A.snapshots(spark, d), "product"))


@query("i17_top_n_with_other", f"WITH g AS ({_BUCKETS.format(k='source', t='documents')}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS rn FROM g) SELECT CASE WHEN rn <= 6 THEN key ELSE 'other' END AS key, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def i17(spark, d):
    return op.top_n_with_other(op.buckets(A.table(spark, d, "documents"), "source"), 6)


@query("i18_latest_documents", f"WITH {SNAPS} SELECT snap_id, page, day FROM snaps ORDER BY day DESC NULLS LAST, snap_id DESC LIMIT 8")
def i18(spark, d):
    return A.snapshots(spark, d).select("snap_id", "page", "day").orderBy(F.col("day").desc_nulls_last(), F.desc("snap_id")).limit(8)


@query("i19_history_overview", f"WITH {SNAPS} SELECT count(*) AS snapshots, count(*) FILTER (searchable) AS searchable, count(DISTINCT page) AS pages, count(DISTINCT product) AS products, min(day) AS first_day, max(day) AS last_day FROM snaps")
def i19(spark, d):
    return A.snapshots(spark, d).agg(F.count("*").alias("snapshots"), F.count_if("searchable").alias("searchable"), F.countDistinct("page").alias("pages"), F.countDistinct("product").alias("products"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("i20_url_versions", f"WITH {SNAPS} SELECT page, snap_id, day, row_number() OVER (PARTITION BY page ORDER BY day, snap_id) AS version, count(*) OVER (PARTITION BY page) AS versions FROM snaps WHERE page IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def i20(spark, d):
    asked = A.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("page"))
    return op.version_groups(A.snapshots(spark, d).join(asked, "page", "left_semi"))


@query("i21_as_of_comparison", f"""WITH {SNAPS}, days AS (SELECT DISTINCT date_trunc('month', day)::DATE AS as_of FROM snaps), k AS (SELECT DISTINCT product FROM snaps)
SELECT k.product, days.as_of, (SELECT arg_max(snap_id, (s.day, s.snap_id)) FROM snaps s WHERE s.searchable AND s.product = k.product AND s.day <= days.as_of) AS snap_id FROM k, days""")
def i21(spark, d):
    s = A.snapshots(spark, d)
    return op.as_of(s, s.select(F.trunc("day", "month").alias("as_of")))


@query("i22_fact_verified", "SELECT event_type, count(*) FILTER (event_type = 'purchase' OR lower(props) LIKE '%human%' OR lower(props) LIKE '%manual%') AS n_verified, count(*) AS n FROM events GROUP BY event_type")
def i22(spark, d):
    e = A.events(spark, d)
    ok = op.fact_verified(F.col("props"), F.when(F.col("event_type") == "purchase", "approved"))
    return e.groupBy("event_type").agg(F.count_if(ok).alias("n_verified"), F.count("*").alias("n"))


@query("i23_coverage_audit", f"""WITH {DOCS}, {FACTS}, h AS (SELECT DISTINCT doc_id, true AS has FROM facts)
SELECT product, bank, count(*) AS pages, count(has) AS with_facts, count(*) FILTER (has IS NULL) AS gaps, count(*) FILTER (has IS NULL AND regexp_matches(text, '[0-9]')) AS recoverable,
round_even(100 * (count(has) + count(*) FILTER (has IS NULL AND regexp_matches(text, '[0-9]'))) / count(*), 1) AS projected FROM docs LEFT JOIN h USING (doc_id) GROUP BY product, bank""")
def i23(spark, d):
    return op.coverage_audit(A.docs(spark, d), A.facts(spark, d), F.col("text").rlike("[0-9]"))


@query("i24_backfill_coverage", f"""WITH {FACTS}, p AS (SELECT doc_id, fact_type, upper(fact_text) AS fact_text, value / 100 AS confidence FROM facts),
s AS (SELECT doc_id, fact_type, lower(trim(fact_text)) AS x FROM facts WHERE n % 3 = 1 UNION SELECT doc_id, fact_type, lower(trim(fact_text)) FROM facts WHERE n = 2)
SELECT doc_id, fact_type, fact_text, confidence FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = p.doc_id AND s.fact_type = p.fact_type AND s.x = lower(trim(p.fact_text)))
QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, lower(trim(fact_text)) ORDER BY confidence DESC, fact_text) = 1""")
def i24(spark, d):
    f = A.facts(spark, d)
    return op.backfill(f.filter("n % 3 = 1"), f.filter("n = 2"), f.select("doc_id", "fact_type", F.upper("fact_text").alias("fact_text"), (F.col("value") / 100).alias("confidence")))


@query("i25_extraction_audit", """SELECT l_orderkey AS doc_id, l_quantity AS value, count(DISTINCT l_returnflag) AS roles, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels, count(DISTINCT l_linestatus) > 1 AS valid_dual
FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""")
def i25(spark, d):
    li = A.table(spark, d, "lineitem")
    out = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("value")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("labels"), (F.size(F.collect_set("l_linestatus")) > 1).alias("valid_dual"))
    return out.filter(F.size("labels") > 1).select("doc_id", "value", F.size("labels").cast("long").alias("roles"), F.array_join("labels", ",").alias("labels"), "valid_dual")


@query("i26_database_audit", f"""WITH {SNAPS} SELECT product, count(*) FILTER (searchable) AS searchable, count(*) FILTER (NOT searchable) AS pending,
count(*) FILTER (searchable AND snap_id NOT IN (SELECT vec_id FROM embeddings)) AS without_embedding FROM snaps GROUP BY product""")
def i26(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("snap_id"), F.lit(True).alias("embedded"))
    return A.snapshots(spark, d).join(e, "snap_id", "left").groupBy("product").agg(F.count_if("searchable").alias("searchable"), F.count_if(~F.col("searchable")).alias("pending"), F.count_if(F.col("searchable") & F.col("embedded").isNull()).alias("without_embedding"))


@query("i27_prioritised_facts", f"""WITH {FACTS}, r AS (SELECT doc_id, fact_type, n, row_number() OVER (PARTITION BY doc_id ORDER BY (fact_type IN ('A', 'R')) DESC, fact_type, n) AS place FROM facts) SELECT * FROM r WHERE place <= 3""")
def i27(spark, d):
    wanted = A.table(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')").select(F.col("l_returnflag").alias("fact_type")).distinct()
    return op.prioritised_facts(A.facts(spark, d), wanted, 3)
