"""Queries of sections B (relational primitives), C (identity) and D (curation) on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.adapters import DOCS, FACTS, SNAPS
from offerscope.functions import text as X
from offerscope.operators import curate as op
from offerscope.registry import query

SQUEEZE = "trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
FOLD = SQUEEZE.format(c="replace(lower(strip_accents(translate({c}, 'ıİ', 'ii'))), 'ß', 'ss')")


# --- B
@query("b1_projection", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state, coalesce(nullif(trim(o_orderpriority), ''), 'none') AS priority FROM orders")
def b1(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("state"), F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("none")).alias("priority"))


@query("b2_b3_optional_filters", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_shipdate < TIMESTAMP '1996-01-01'")
def b2(spark, d):
    given = {"l_returnflag": ["A", "R"], "l_linestatus": None}
    rows = A.table(spark, d, "lineitem")
    for column, values in given.items():
        rows = rows if values is None else rows.filter(F.col(column).isin(values))
    return rows.filter("l_quantity >= 10 and l_shipdate < timestamp '1996-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("b4_ilike_any_column", "SELECT doc_id FROM documents WHERE text ILIKE '%rights%' OR lang ILIKE '%fr%' OR source ILIKE '%src1%'")
def b4(spark, d):
    return A.table(spark, d, "documents").filter("text ilike '%rights%' or lang ilike '%fr%' or source ilike '%src1%'").select("doc_id")


@query("b5_inner_join", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def b5(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    return A.table(spark, d, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("b6_left_join_condition_in_on", "SELECT c_custkey, count(o_orderkey) AS closed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def b6(spark, d):
    o = A.table(spark, d, "orders")
    return A.table(spark, d, "customer").join(o, (F.col("c_custkey") == o["o_custkey"]) & (o["o_orderstatus"] == "F"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("closed"))


@query("b7_semi_anti", "SELECT 'with' AS kind, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def b7(spark, d):
    c, o = A.table(spark, d, "customer").select("c_custkey"), A.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select(F.lit("with").alias("kind"), "c_custkey").unionByName(c.join(o, "c_custkey", "left_anti").select(F.lit("without").alias("kind"), "c_custkey"))


@query("b8_single_row_cross", "SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above FROM customer")
def b8(spark, d):
    c = A.table(spark, d, "customer")
    return c.crossJoin(F.broadcast(c.agg(F.avg("c_acctbal").alias("mean")))).select("c_custkey", (F.col("c_acctbal") > F.col("mean")).alias("above"))  # one row


@query("b9_b10_aggregates", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) FILTER (l_linestatus = 'F') AS closed FROM lineitem GROUP BY l_returnflag")
def b9(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.avg("l_quantity").alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_if(F.col("l_linestatus") == "F").alias("closed"))


@query("b11_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 ORDER BY n DESC, l_suppkey LIMIT 25")
def b11(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).filter("n > 20").orderBy(F.desc("n"), "l_suppkey").limit(25)


@query("b12_distinct_array", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def b12(spark, d):
    return A.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))


@query("b13_row_number", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def b13(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return A.table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("o_custkey", "o_orderkey")


@query("b14_rank_per_query", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS place FROM events QUALIFY place <= 10")
def b14(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return A.events(spark, d).withColumn("place", F.row_number().over(w)).filter("place <= 10").select("event_type", "event_id", "place")


@query("b15_union_distinct", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 10")
def b15(spark, d):
    return A.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id")).unionByName(A.table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("id"))).distinct()


@query("b16_union_all_tagged", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY kind")
def b16(spark, d):
    return A.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(A.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("b17_top_k_nulls_last", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 15")
def b17(spark, d):
    return A.events(spark, d).orderBy(F.col("value").desc_nulls_last(), F.desc("event_id")).limit(15).select("event_id", "value")


@query("b18_page_with_total", "SELECT p_partkey, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 30")
def b18(spark, d):
    p = A.table(spark, d, "part")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(30).limit(10).select("p_partkey").crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))


@query("b19_upsert", """WITH old AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment = 'BUILDING' AS locked FROM customer), new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY o_custkey)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.locked OR new.k IS NULL THEN old.v ELSE new.v END AS v FROM old FULL JOIN new ON old.k = new.k""")
def b19(spark, d):
    old = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("locked"))
    new = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("nv"))
    return old.join(new, "k", "full").select("k", F.when(F.col("locked") | F.col("nv").isNull(), F.col("v")).otherwise(F.col("nv")).alias("v"))


# --- C
@query("c0_identify", f"""WITH i AS (SELECT source, sha256({SQUEEZE.format(c="text")}) AS digest, length(text) AS chars, regexp_matches(text, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}²³]') AS odd FROM documents)
SELECT source, count(*) AS pages, count(DISTINCT digest) AS texts, sum(chars)::BIGINT AS chars, count(*) FILTER (odd) AS suspicious FROM i GROUP BY source""")
def c0(spark, d):
    i = op.identify(A.table(spark, d, "documents"))
    return i.groupBy("source").agg(F.count("*").alias("pages"), F.countDistinct("digest").alias("texts"), F.sum("chars").alias("chars"), F.count_if(X.has_suspicious_chars("text")).alias("suspicious"))


@query("c1_c2_fold_text", f"SELECT doc_id, {FOLD.format(c='text')} AS folded FROM documents")
def c1(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.fold_text("text").alias("folded"))


@query("c3_normalize_alnum", f"SELECT doc_id, trim(regexp_replace({FOLD.format(c='text')}, '[^a-z0-9%]+', ' ', 'g')) AS plain FROM documents")
def c3(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.normalize_alnum("text").alias("plain"))


@query("c4_content_digest", f"SELECT doc_id, sha256({SQUEEZE.format(c='text')}) AS digest FROM documents")
def c4(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.content_digest("text").alias("digest"))


@query("c5_stable_digest", f"SELECT o_orderkey, sha256(lower(o_orderpriority) || chr(31) || lower(o_orderstatus) || chr(31) || o_custkey) AS digest FROM orders")
def c5(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", X.stable_digest("o_orderpriority", "o_orderstatus", "o_custkey").alias("digest"))


_URL = "regexp_replace(regexp_replace(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/+', '/', 'g'), '/$', '')"


@query("c6_canonical_url_archive", f"SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') || {_URL} AS canonical FROM pages")
def c6(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.canonical_url_archive("url").alias("canonical"))


@query("c7_canonical_url_offer", """WITH q AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS p,
list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT lower(x) LIKE 'utm\\_%' ESCAPE '\\' AND NOT lower(split_part(x, '=', 1)) IN ('fbclid','gclid','gad_source','mc_cid','mc_eid','msclkid','ref','yclid'))) AS q FROM pages)
SELECT page_id, s || '://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM q""")
def c7(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.canonical_url_offer("url").alias("canonical"))


@query("c8_c9_parse_numbers", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS tr, round(l_extendedprice, 2) AS strict FROM lineitem""")
def c8(spark, d):
    said = F.translate(F.format_number(F.round("l_extendedprice", 2), 2), ",.", ".,")  # 1.250,75
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.parse_number(said).alias("tr"), X.parse_number(said, "comma").alias("strict"))


@query("c10_dates_in_text", "SELECT o_orderkey, [o_orderdate::DATE] AS dates FROM orders")
def c10(spark, d):
    o = A.table(spark, d, "orders")
    day = F.col("o_orderdate")
    months = F.array(*map(F.lit, X.MONTHS))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "d.M.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.initcap(F.element_at(months, F.month(day))), F.year(day).cast("string")))
    return o.select("o_orderkey", X.dates_in_text(F.concat(F.lit("son tarih "), said, F.lit(" olarak"))).alias("dates"))


@query("c12_record_key", f"SELECT page_id, 'live-bank-' || substr(sha256('https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') || {_URL}), 1, 24) AS record_key FROM pages")
def c12(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.record_key(F.lit("Bank"), "url").alias("record_key"))


# --- D
_ID = f"i AS (SELECT *, sha256({SQUEEZE.format(c='text')}) AS digest FROM documents)"


def _ident(spark, d):
    return op.identify(A.table(spark, d, "documents"))


@query("d1_exact_dedup", f"WITH {_ID} SELECT min(doc_id) AS doc_id, digest FROM i GROUP BY digest")
def d1(spark, d):
    return op.exact_dedup(_ident(spark, d), ["doc_id"]).select("doc_id", "digest")


@query("d2_exclude_known", f"""WITH {_ID}, c AS (SELECT doc_id, digest, doc_id % 97 AS record_key, lang AS url FROM i WHERE doc_id % 2 = 1), l AS (SELECT digest, doc_id % 89 + 40 AS record_key, lang AS url FROM i WHERE doc_id % 2 = 0 AND lang <> 'de')
SELECT doc_id, url IN (SELECT url FROM l) AS is_version FROM c WHERE digest NOT IN (SELECT digest FROM l) AND record_key NOT IN (SELECT record_key FROM l)""")
def d2(spark, d):
    i = _ident(spark, d)
    c = i.filter("doc_id % 2 = 1").select("doc_id", "digest", (F.col("doc_id") % 97).alias("record_key"), F.col("lang").alias("url"))
    live = i.filter("doc_id % 2 = 0 and lang <> 'de'").select("digest", (F.col("doc_id") % 89 + 40).alias("record_key"), F.col("lang").alias("url"))
    return op.exclude_known(c, live).select("doc_id", "is_version")


@query("d3_incremental_gate", f"WITH {_ID} SELECT doc_id FROM i WHERE NOT (doc_id % 3 = 0) OR doc_id % 6 = 0 AND lang = 'fr'")
def d3(spark, d):
    i = _ident(spark, d).withColumn("record_key", F.col("doc_id"))
    state = i.filter("doc_id % 3 = 0 and not (doc_id % 6 = 0 and lang = 'fr')").select("record_key", "digest", F.lit("v2").alias("version")).unionByName(i.select("record_key", "digest", F.lit("v1").alias("version")))
    return op.incremental_gate(i, state, "v2").select("doc_id")


@query("d4_intake_action", f"""WITH {_ID}, k AS (SELECT *, lang || '/' || n_chars AS record_key FROM i), inc AS (SELECT record_key, source AS bank, digest, n_chars % 7 = 0 AS review, doc_id FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
cur AS (SELECT record_key, source AS bank, digest FROM k WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY doc_id) = 1)
SELECT inc.record_key, inc.bank, inc.digest, CASE WHEN c.digest = inc.digest THEN 'unchanged_skipped' WHEN c.digest IS NULL AND EXISTS (SELECT 1 FROM cur x WHERE x.bank = inc.bank AND x.digest = inc.digest) THEN 'duplicate_content_skipped'
WHEN inc.review THEN 'review_queued' WHEN c.digest IS NOT NULL THEN 'changed_document_review_queued' ELSE 'inserted' END AS action FROM inc LEFT JOIN cur c USING (record_key)""")
def d4(spark, d):
    i, known = _ident(spark, d), A.table(spark, d, "labels").select("doc_id").distinct()
    key = F.concat_ws("/", "lang", F.col("n_chars").cast("string")).alias("record_key")
    inc = i.join(known, "doc_id", "left_anti").select(key, F.col("source").alias("bank"), "digest", (F.col("n_chars") % 7 == 0).alias("review"))
    cur = i.join(known, "doc_id", "left_semi").groupBy(key).agg(F.min_by(F.struct(F.col("source").alias("bank"), "digest"), "doc_id").alias("first")).select("record_key", "first.*")
    return op.intake_action(inc, cur)


@query("d5_version_groups", f"WITH {SNAPS} SELECT page, snap_id, day, row_number() OVER (PARTITION BY page ORDER BY day, snap_id) AS version, count(*) OVER (PARTITION BY page) AS versions FROM snaps")
def d5(spark, d):
    from offerscope.operators.analytics import version_groups

    return version_groups(A.snapshots(spark, d))


@query("d6_near_dup_clusters")
def d6(spark, d):
    from offerscope.plans.scratch import with_checkpoint_dir

    with_checkpoint_dir(spark)
    return op.near_dup_clusters(A.table(spark, d, "documents"))


_LINES = "l AS (SELECT DISTINCT source AS bank, doc_id, trim(x, ' ') AS line FROM documents, unnest(string_split(text, chr(10))) AS u(x)), p AS (SELECT source AS bank, count(*) AS pages FROM documents GROUP BY 1), t AS (SELECT bank, line, count(*) AS n, any_value(pages) AS pages FROM l JOIN p USING (bank) WHERE line <> '' AND length(line) <= 200 GROUP BY bank, line HAVING count(*) > 0.05 * any_value(pages))"


@query("d7_template_lines", f"WITH {_LINES} SELECT * FROM t")
def d7(spark, d):
    return op.template_lines(A.table(spark, d, "documents"), share=0.05)


@query("d7_drop_template_lines", f"""WITH {_LINES}, g AS (SELECT bank, list(line) AS ls FROM t GROUP BY bank)
SELECT doc_id, CASE WHEN ls IS NULL THEN text ELSE array_to_string([x FOR x IN string_split(text, chr(10)) IF NOT list_contains(ls, trim(x, ' '))], chr(10)) END AS text FROM documents LEFT JOIN g ON bank = source""")
def d7b(spark, d):
    return op.drop_template_lines(A.table(spark, d, "documents"), share=0.05)


@query("d8_passage_dedup", "WITH p AS (SELECT doc_id, pos - 1 AS pos, passage FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS passage, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(passage, ' ') <> '') SELECT arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos))::INT AS place, passage, count(*) AS copies FROM p GROUP BY passage")
def d8(spark, d):
    return op.passage_dedup(A.table(spark, d, "documents"))


@query("d9_select_snapshots", f"""WITH {SNAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY day, snap_id) - 1 AS rn, count(*) OVER (PARTITION BY page) AS total FROM snaps)
SELECT snap_id, page FROM r WHERE CASE WHEN least(3, total) = 1 THEN rn = total - 1 ELSE list_contains([round_even(i * (total - 1) / (least(3, total) - 1), 0) FOR i IN range(0, least(3, total))], rn) END""")
def d9(spark, d):
    return op.select_snapshots(A.snapshots(spark, d), 3).select("snap_id", "page")


@query("d10_overlap_audit", f"WITH {_ID}, a AS (SELECT source AS bank, digest FROM i WHERE doc_id % 2 = 0), l AS (SELECT DISTINCT digest FROM i WHERE doc_id % 2 = 1) SELECT bank, count(*) AS rows, count(DISTINCT digest) AS unique_texts, count(*) FILTER (digest IN (SELECT digest FROM l)) AS live_texts FROM a GROUP BY bank")
def d10(spark, d):
    i = _ident(spark, d).withColumnRenamed("source", "bank")
    return op.overlap_audit(i.filter("doc_id % 2 = 0"), i.filter("doc_id % 2 = 1"))


@query("d11_collapse_repeated_blocks")
def d11(spark, d):
    return op.collapse_repeated_blocks(A.table(spark, d, "documents"))
