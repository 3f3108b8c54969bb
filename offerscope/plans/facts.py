"""Queries of sections F (facts), L (questions, answers) and ST2 on the given tables, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.operators import facts as op
from offerscope.operators import roles
from offerscope.operators import typed_rules as T
from offerscope.plans.corpus import FOLD
from offerscope.registry import query

SEG = "p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;]) ', '\\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?;]) ', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos FROM documents), q AS (SELECT doc_id, pos - 1 AS pos, trim(s, ' ') AS s FROM p WHERE length(trim(s, ' ')) BETWEEN 12 AND 420), " + f"seg AS (SELECT doc_id, arg_min(s, pos) AS segment, min(pos)::INT AS place FROM q GROUP BY doc_id, {FOLD.format(c='s')})"
RULES = [
    {"fact_type": "year", "pattern": r"\b((?:19|20)[0-9]{2})\b", "confidence": 0.97},
    {"fact_type": "number", "pattern": r"\b([0-9]{5,})\b", "confidence": 0.9, "excluded": "token"},
    {"fact_type": "license", "pattern": r"(licensed under[a-z ,]+)", "confidence": 0.95, "required": "license"},
]


def _segments(spark, d):
    return op.segments(A.table(spark, d, "documents"))


@query("f1_segments", f"WITH {SEG} SELECT doc_id, place, segment FROM seg")
def f1(spark, d):
    return _segments(spark, d).withColumnRenamed("at", "place")


_FOUND = f"""{SEG}, t AS (SELECT doc_id, place, segment, lower(segment) AS s FROM seg), g AS (SELECT *, string_split_regex(s, '\\b[0-9]{{5,}}\\b') AS gaps, regexp_extract_all(s, '\\b[0-9]{{5,}}\\b') AS m FROM t),
n AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM g), a AS (SELECT *, m[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + 1)::BIGINT AS p FROM n),
found AS (SELECT doc_id, place, segment, 'year' AS fact_type, unnest(list_distinct(regexp_extract_all(s, '\\b((19|20)[0-9]{{2}})\\b', 1))) AS fact_text, 0.97::DOUBLE AS confidence, 0 AS ordinal FROM t
UNION ALL SELECT DISTINCT doc_id, place, segment, 'number', v, 0.9::DOUBLE, 1 FROM a WHERE NOT contains(substr(s, greatest(p - 60, 1), p + length(v) + 60 - greatest(p - 60, 1)), 'token')
UNION ALL SELECT doc_id, place, segment, 'license', unnest(list_distinct(regexp_extract_all(s, '(licensed under[a-z ,]+)', 1))), 0.95::DOUBLE, 2 FROM t)"""


def _found(spark, d):
    return op.apply_rules(_segments(spark, d), RULES)


@query("fact_rules", f"WITH {_FOUND} SELECT doc_id, place, fact_type, fact_text, confidence FROM found")
def f2(spark, d):
    return _found(spark, d).select("doc_id", F.col("at").alias("place"), "fact_type", "fact_text", "confidence")


@query("fact_rules_with_evidence", f"WITH {_FOUND} SELECT doc_id, place, fact_type, fact_text, segment AS evidence, confidence, ordinal FROM found")
def f3(spark, d):
    return _found(spark, d).withColumnRenamed("at", "place")


@query("f11_cap_facts", f"WITH {_FOUND}, b AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, fact_text ORDER BY place, ordinal) = 1), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type ORDER BY place, ordinal, fact_text) <= 3) SELECT doc_id, fact_type, fact_text, place FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, ordinal, fact_text) <= 18")
def f11(spark, d):
    return op.cap_facts(_found(spark, d)).select("doc_id", "fact_type", "fact_text", F.col("at").alias("place"))


@query("f12_page_keywords", "SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(" + FOLD.format(c="split_part(text, chr(10), 1)") + ", '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN ('with', 'that')))) AS keywords FROM documents")
def f12(spark, d):
    return op.page_keywords(A.table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title")), ("with", "that"))


@query("nearest_cue")
def f14(spark, d):
    """Of each fact in its segment, which cue is nearest."""
    rows = _found(spark, d).withColumn("t", F.lower("evidence")).withColumn("place", F.instr(F.col("t"), F.col("fact_text")))
    return rows.select("doc_id", "at", "fact_type", "fact_text", op.nearest_cue(F.col("t"), F.col("place"), {"of": r"\bof\b", "and": r"\band\b", "is": r"\bis\b", "by": r"\bby\b"}).alias("role"))


_MONEY = """SELECT l_orderkey, l_linenumber, unnest([n::VARCHAR || ' tl', m::VARCHAR || ' tl']) AS amount, unnest(CASE l_returnflag WHEN 'A' THEN ['spend_threshold', 'reward'] WHEN 'N' THEN ['spend_threshold', 'discount'] ELSE [NULL, NULL] END) AS role
FROM (SELECT *, l_partkey + 100 AS n, l_suppkey + 5 AS m FROM lineitem)"""


@query("f14_amount_role", _MONEY)
def f14_amounts(spark, d):
    """Amounts of a sentence for each order line: its numbers are the line's own."""
    n, m = (F.col("l_partkey") + 100).cast("string"), (F.col("l_suppkey") + 5).cast("string")
    says = (
        F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit(" TL ve üzeri harcamanıza "), m, F.lit(" TL bonus kazanın.")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("En az "), n, F.lit(" TL tutarında alışverişinizde "), m, F.lit(" TL indirim sizi bekliyor.")))
        .otherwise(F.concat(F.lit("Hesap bakiyesi "), n, F.lit(" TL, kalan borç "), m, F.lit(" TL olarak görünür.")))
    )
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", says.alias("evidence"))
    return roles.amount_roles(rows).select("l_orderkey", "l_linenumber", "amount", "role")


@query("f15_percent_role", "SELECT l_orderkey, l_linenumber, '%' || (l_quantity::INT) AS percent, CASE l_returnflag WHEN 'A' THEN 'finance' WHEN 'N' THEN 'discount' END AS role FROM lineitem")
def f15(spark, d):
    n = F.col("l_quantity").cast("int").cast("string")
    says = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Kâr payı oranı %"), n, F.lit(" ile başlar, indirim kuponu ise başka bir sayfada anlatılır."))).when(F.col("l_returnflag") == "N", F.concat(F.lit("Finansman kullananlara %"), n, F.lit(" indirim."))).otherwise(F.concat(F.lit("Katılım %"), n, F.lit(" düzeyinde kaldı.")))
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", says.alias("evidence"))
    return roles.percent_roles(rows).select("l_orderkey", "l_linenumber", "percent", "role")


@query("f18_surface_check", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_linestatus = 'F' WHEN 'N' THEN l_quantity BETWEEN 1 AND 120 ELSE l_linestatus = 'F' END AS ok FROM lineitem")
def f18(spark, d):
    n = F.col("l_quantity").cast("int").cast("string")
    value = F.when(F.col("l_returnflag") == "N", n).when(F.col("l_linestatus") == "F", F.concat(n, F.when(F.col("l_returnflag") == "A", " TL").otherwise(" ay"))).otherwise(n)
    kind = F.when(F.col("l_returnflag") == "A", "money").when(F.col("l_returnflag") == "N", "count").otherwise("duration")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.surface_check(kind, value).alias("ok"))


@query("f19_normalise_value", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS value, CASE l_returnflag WHEN 'A' THEN 'TL' ELSE 'percent' END AS unit FROM lineitem")
def f19(spark, d):
    said = F.translate(F.format_number(F.round("l_extendedprice", 2), 2), ",.", ".,")
    kind = F.when(F.col("l_returnflag") == "A", "money").otherwise("percent")
    v = op.normalise_value(kind, F.when(kind == "money", F.concat(said, F.lit(" TL"))).otherwise(F.concat(F.lit("%"), said)))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v["value"].alias("value"), v["unit"].alias("unit"))


@query("f20_evidence_window", f"""WITH {_FOUND}, o AS (SELECT DISTINCT doc_id, fact_type, fact_text FROM found), w AS (SELECT doc_id, fact_type, fact_text, text, instr(lower(text), fact_text) - 1 AS a FROM o JOIN documents USING (doc_id)), x AS (SELECT *, a + length(fact_text) AS b FROM w WHERE a >= 0)
SELECT doc_id, fact_type, fact_text, trim(regexp_extract(substr(text, greatest(a - 180, 0) + 1, least(a, 180)), '([^.!?\\n]*)$', 1) || substr(text, a + 1, b - a) || CASE WHEN regexp_matches(substr(text, b + 1, 180), '[.!?\\n]') THEN regexp_extract(substr(text, b + 1, 180), '^([^.!?\\n]*[.!?]?)', 1) ELSE substr(text, b + 1, 180) END, ' ') AS evidence FROM x""")
def f20(spark, d):
    """The window around each fact's first place in its document."""
    facts = _found(spark, d).select("doc_id", "fact_type", "fact_text").distinct()
    rows = facts.join(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("a", F.instr(F.lower("text"), F.col("fact_text")) - 1).filter("a >= 0")
    return rows.select("doc_id", "fact_type", "fact_text", op.evidence_window(F.col("text"), F.col("a"), F.col("a") + F.length("fact_text")).alias("evidence"))


_DECIDED = """c AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, l_quantity::INT || ' ' || l_linestatus AS fact_text, CASE WHEN l_linenumber % 5 = 0 THEN 'none' ELSE 'x ' || l_quantity::INT || ' ' || l_linestatus END AS evidence, l_linenumber % 3 > 0 AS rule_ok, l_quantity / 50 AS confidence, l_linenumber AS ordinal FROM lineitem),
decided AS (SELECT *, CASE WHEN evidence = 'none' THEN 'not_in_evidence' WHEN rule_ok AND confidence >= CASE label WHEN 'A' THEN 0.8 ELSE 0.95 END THEN 'accepted' WHEN rule_ok AND confidence >= 0.5 THEN 'low_confidence' ELSE 'rule' END AS reason FROM c)"""


def _cand(spark, d):
    text = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), "l_linestatus")
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), text.alias("fact_text"), F.when(F.col("l_linenumber") % 5 == 0, "none").otherwise(F.concat(F.lit("x "), text)).alias("evidence"), (F.col("l_linenumber") % 3 > 0).alias("rule_ok"), (F.col("l_quantity") / 50).alias("confidence"), F.col("l_linenumber").alias("ordinal"))


@query("f21_decide", f"WITH {_DECIDED} SELECT doc_id, label, fact_text, CASE reason WHEN 'accepted' THEN 'accepted' WHEN 'low_confidence' THEN 'review' ELSE 'rejected' END AS decision, reason FROM decided")
def f21(spark, d):
    return op.decide(_cand(spark, d), {"A": 0.8}, ("A", "R"))


@query("f22_allowed_labels", "SELECT o_orderpriority AS product, count(*) FILTER (l_returnflag = 'A' OR o_orderpriority LIKE '1%') AS kept, count(*) FILTER (NOT (l_returnflag = 'A' OR o_orderpriority LIKE '1%')) AS dropped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def f22(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("product"))
    spans = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label")).join(o, "l_orderkey")
    allowed = spans.select("product", "label").distinct().filter("label = 'A' or product like '1%'")
    return op.allowed_labels(spans, allowed)


@query("f23_dedup_candidates", f"WITH {_DECIDED} SELECT doc_id, label, fact_text, ordinal FROM decided QUALIFY row_number() OVER (PARTITION BY doc_id, label, lower(fact_text) ORDER BY CASE reason WHEN 'accepted' THEN 0 WHEN 'low_confidence' THEN 1 ELSE 2 END, confidence DESC, ordinal) = 1")
def f23(spark, d):
    rows = _cand(spark, d)
    reason = F.when(F.col("evidence") == "none", "rejected").when(F.col("rule_ok") & (F.col("confidence") >= F.when(F.col("label") == "A", 0.8).otherwise(0.95)), "accepted").when(F.col("rule_ok") & (F.col("confidence") >= 0.5), "review").otherwise("rejected")
    return op.dedup_candidates(rows.withColumn("decision", reason)).select("doc_id", "label", "fact_text", "ordinal")


@query("f25_validate_claimed_facts", f"""WITH {SEG} SELECT doc_id, CASE WHEN (doc_id + place) % 5 = 0 THEN 'low_confidence' WHEN (doc_id + place) % 3 = 0 THEN 'evidence_not_in_source' WHEN (doc_id + place) % 7 = 0 THEN 'fact_not_in_evidence'
WHEN (doc_id + place) % 2 = 1 AND NOT regexp_matches(lower(segment), 'odeme|taksit') THEN 'label_rule_failed' END AS reason FROM seg""")
def f25(spark, d):
    """A claim for each segment of each document."""
    n, passage = F.col("doc_id") + F.col("at"), F.col("segment")
    claims = _segments(spark, d).select(
        "doc_id", F.when(n % 2 == 1, "ODEME_PLANI").otherwise("OTHER").alias("fact_type"), F.when(n % 7 == 0, "not there at all").otherwise(F.substring(passage, 1, 5)).alias("fact_text"),
        F.when(n % 3 == 0, "a passage that no document has (1)").otherwise(F.regexp_replace(passage, " ", "  ")).alias("evidence"), F.when(n % 5 == 0, 0.2).otherwise(0.9).alias("confidence"),
    )
    return op.validate_claimed_facts(claims, A.table(spark, d, "documents").filter("text is not null"), 0.5).select("doc_id", "reason")


@query("f27_merge_bio_tokens", """WITH t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS word, CASE o_orderstatus WHEN 'O' THEN 'B-x' WHEN 'F' THEN 'I-x' ELSE 'O' END AS label, o_orderkey % 100 / 100 AS score FROM orders),
k AS (SELECT *, CASE WHEN label = 'O' THEN NULL ELSE substr(label, 3) END AS kind FROM t), b AS (SELECT *, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY word)),
s AS (SELECT *, sum((kind IS NOT NULL AND (label = 'B-x' OR before IS NULL))::INT) OVER (PARTITION BY doc_id ORDER BY word) AS span FROM b) SELECT doc_id, kind, min(word) AS start, max(word) AS "end", round(avg(score), 6) AS score FROM s WHERE kind IS NOT NULL GROUP BY doc_id, span, kind HAVING round(avg(score), 6) >= 0.3""")
def f27(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "O", "B-x").when(F.col("o_orderstatus") == "F", "I-x").otherwise("O")
    return op.merge_bio_tokens(A.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(w).alias("word"), label.alias("label"), (F.col("o_orderkey") % 100 / 100).alias("score")), 0.3)


@query("f28_f29_campaign_bounds", """WITH f AS (SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'deadline' ELSE 'period' END AS kind, l_shipdate::DATE AS s, (l_shipdate::DATE + (l_quantity::INT - 3)) AS e FROM lineitem)
SELECT doc_id, min(s) FILTER (kind = 'period' AND s <= e) AS start, max(e) FILTER (kind = 'deadline' OR s <= e) AS "end", bool_or(kind = 'period' AND s > e) AS ambiguous, count(DISTINCT s || '/' || e) FILTER (kind = 'period' AND s <= e) > 1 AS multiple FROM f GROUP BY 1""")
def f28(spark, d):
    day = F.col("l_shipdate").cast("date")
    return op.campaign_bounds(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "deadline").otherwise("period").alias("kind"), day.alias("start"), F.date_add(day, F.col("l_quantity").cast("int") - 3).alias("end")))


@query("f30_merge_fact_sources", "WITH f AS (SELECT l_orderkey AS doc_id, l_returnflag AS fact_type, l_linestatus AS fact_text, l_linenumber AS n FROM lineitem), s AS (SELECT * FROM f WHERE n = 1) SELECT doc_id, fact_type, fact_text, 'stored' AS origin FROM s UNION ALL SELECT doc_id, fact_type, lower(fact_text), 'derived' FROM f WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = f.doc_id AND s.fact_type = f.fact_type AND s.fact_text = f.fact_text)")
def f30(spark, d):
    f = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("fact_type"), F.col("l_linestatus").alias("fact_text"), F.col("l_linenumber").alias("n"))
    return op.merge_fact_sources(f.filter("n = 1").drop("n"), f.filter("n > 1").drop("n").withColumn("fact_text", F.lower("fact_text")))


@query("f31_fact_key", "SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '|' || l_returnflag || '|' || l_linestatus) AS fact_key FROM lineitem")
def f31(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.fact_key(F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linestatus")).alias("fact_key"))


def _turkish(spark, d):
    """A sentence for each order, by its status."""
    says = (
        F.when(F.col("o_orderstatus") == "O", "Mobil Şubeden başvurun, şubeye gitmeden tamamlayın.").when(F.col("o_orderstatus") == "F", "Başvuru için şubelerimiz ve internet şubesi açıktır.").otherwise("KKDF ve BSMV'den muaf, işlem ücretsiz.")
    )
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("at"), says.alias("segment"))


@query("f4_channel_rules", "SELECT o_orderkey AS doc_id, unnest(CASE o_orderstatus WHEN 'O' THEN ['subeden'] WHEN 'F' THEN ['internet subesi', 'subelerimiz'] ELSE [] END) AS fact_text FROM orders")
def f4(spark, d):
    return op.channel_rules(_turkish(spark, d)).select("doc_id", "fact_text")


@query("f5_fee_tax_rules", "SELECT o_orderkey AS doc_id, unnest(['kkdf', 'bsmv', 'ucretsiz']) AS fact_text, unnest([0.98, 0.98, 0.95])::DOUBLE AS confidence FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def f5(spark, d):
    return op.fee_tax_rules(_turkish(spark, d)).select("doc_id", "fact_text", "confidence")


_TYPED = """SELECT o_orderkey AS doc_id, unnest(CASE left(o_orderpriority, 1) WHEN '1' THEN ['FINANSMAN_TUTARI', 'KAR_PAYI_ORANI', 'VADE_SURESI'] WHEN '2' THEN ['MINIMUM_BAKIYE', 'KAR_PAYLASIM_ORANI', 'MEVDUAT_GUVENCESI'] WHEN '3' THEN ['ISLEM_ALT_LIMITI']
WHEN '4' THEN ['SIGORTA_UCRETI', 'TEMINAT', 'SIGORTA_KOSULU'] ELSE ['ODEMESIZ_DONEM', 'ODEME_PLANI', 'ODEME_PLANI', 'HEDEF_KITLE'] END) AS fact_type,
unnest(CASE left(o_orderpriority, 1) WHEN '1' THEN [n || ' tl', '%' || m, k || ' ay'] WHEN '2' THEN [n || ' tl', '80/20', 'tmsf'] WHEN '3' THEN [n || ' tl']
WHEN '4' THEN [n || ' tl', 'sigorta primi ' || n || ' tl dahil, vefat teminat kapsaminda.', 'sigorta primi ' || n || ' tl dahil, vefat teminat kapsaminda.'] ELSE [k || ' ay', 'esit taksitli', 'odeme plani', 'esnaflara'] END) AS fact_text
FROM (SELECT *, o_orderkey AS n, o_custkey % 9 + 1 AS m, o_orderkey % 36 + 1 AS k FROM orders)"""


@query("f6_f10_typed_rules", _TYPED)
def f6(spark, d):
    kind = F.substring("o_orderpriority", 1, 1)
    n, m, k = (c.cast("string") for c in (F.col("o_orderkey"), F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 36 + 1))
    says = (
        F.when(kind == "1", F.concat(F.lit("Finansman tutarı "), n, F.lit(" TL, kâr payı %"), m, F.lit(", vade "), k, F.lit(" ay.")))
        .when(kind == "2", F.concat(F.lit("Minimum bakiye "), n, F.lit(" TL, kâr paylaşım oranı 80/20, TMSF güvencesi.")))
        .when(kind == "3", F.concat(F.lit("EFT işlem alt limiti "), n, F.lit(" TL.")))
        .when(kind == "4", F.concat(F.lit("Sigorta primi "), n, F.lit(" TL dahil, vefat teminat kapsamında.")))
        .otherwise(F.concat(F.lit("Ödemesiz dönem "), k, F.lit(" ay, eşit taksitli ödeme planı; esnaflara yönelik.")))
    )
    product = F.when(kind == "2", "HESAP_YATIRIM").when(kind == "3", "ODEME_TRANSFER").when(kind == "4", "SIGORTA_TEKAFUL").otherwise("FINANSMAN")
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("at"), product.alias("product"), says.alias("segment"), F.array().cast("array<string>").alias("keywords"))
    return T.typed_rules(rows).select("doc_id", "fact_type", "fact_text")


@query("f6_f10_typed_rules_documents")
def f6_documents(spark, d):
    return T.typed_rules(_segments(spark, d).withColumn("product", F.lit("FINANSMAN")).withColumn("keywords", F.array().cast("array<string>")))
