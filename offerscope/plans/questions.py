"""Queries of sections L and ST2 on the given tables, with their SQL."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.operators import questions as op
from offerscope.plans.corpus import FOLD
from offerscope.registry import query

_T = FOLD.format(c="text")


@query("l1_extract_entities", f"SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches({_T}, '\\band(''[a-z]+)?\\b') THEN 'and' END, CASE WHEN regexp_matches({_T}, '\\bder(''[a-z]+)?\\b') OR regexp_matches({_T}, '\\bdie(''[a-z]+)?\\b') THEN 'article' END, CASE WHEN regexp_matches({_T}, '\\bque(''[a-z]+)?\\b') THEN 'que' END], lambda x: x IS NOT NULL) AS names FROM conversations")
def l1(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", op.extract_entities(F.col("text"), {"and": ("and",), "article": ("der", "die"), "que": ("que",)}).alias("names"))


@query("l2_extract_years", "WITH y AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\b((19|20)\\d\\d)\\b', 1), lambda x: x::INT) AS ys FROM documents) SELECT doc_id, list_min(ys) AS from_year, list_max(ys) AS to_year FROM y WHERE len(ys) > 0")
def l2(spark, d):
    y = op.extract_years(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", y.alias("y")).filter("y is not null").select("doc_id", "y.from_year", "y.to_year")


@query("l2_extract_period", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN year(o_orderdate) END::INT AS year, CASE o_orderkey % 6 WHEN 0 THEN make_date(year(o_orderdate), 1, 1) WHEN 1 THEN make_date(year(o_orderdate), 11, 1) WHEN 2 THEN make_date(year(o_orderdate), 2, 1) WHEN 3 THEN o_orderdate::DATE END AS since,
CASE o_orderkey % 6 WHEN 0 THEN make_date(year(o_orderdate) + 2, 12, 31) WHEN 1 THEN make_date(year(o_orderdate) + 1, 1, 31) WHEN 2 THEN make_date(year(o_orderdate), 4, 30) WHEN 3 THEN o_orderdate::DATE + 40 END AS until FROM orders""")
def l2_period(spark, d):
    """A question for each order that names its date as years, months or days."""
    k, y = F.col("o_orderkey") % 6, F.year("o_orderdate")
    year, later, next_year, day = y.cast("string"), (y + 2).cast("string"), (y + 1).cast("string"), F.col("o_orderdate").cast("date")
    says = (
        F.when(k == 0, F.concat(year, F.lit(" - "), later, F.lit(" arası oranlar"))).when(k == 1, F.concat(F.lit("Kasım "), year, F.lit(" ile Ocak "), next_year)).when(k == 2, F.concat(F.lit("Şubat-Nisan "), year, F.lit(" kampanyaları")))
        .when(k == 3, F.concat(F.date_format(F.date_add(day, 40), "dd.MM.yyyy"), F.lit(" ve "), F.date_format(day, "yyyy/MM/dd"))).when(k == 4, F.concat(year, F.lit(" yılında oran"))).otherwise("güncel oran nedir")
    )
    p = op.extract_period(says)
    return A.table(spark, d, "orders").select("o_orderkey", p["year"].alias("year"), p["since"].alias("since"), p["until"].alias("until"))


@query("l3_intent", f"SELECT conv_id, turn, CASE WHEN regexp_matches({_T}, 'hesapla|calculate') THEN 'calculate' WHEN regexp_matches({_T}, 'karsilastir|compare|versus|fark') THEN 'compare' WHEN regexp_matches({_T}, 'gecmis|eski|history|previous') THEN 'historical' WHEN regexp_matches({_T}, 'liste|hangi|all|list') THEN 'list' ELSE 'lookup' END AS intent FROM conversations")
def l3(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", op.intent(F.col("text")).alias("intent"))


@query("l4_standalone_query", "SELECT o_custkey AS k, 'banks=' || string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) || '; year=' || max(year(o_orderdate)) || '; products=' || string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS q FROM orders GROUP BY 1")
def l4(spark, d):
    o = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("b"), F.collect_set("o_orderpriority").alias("p"), F.max(F.year("o_orderdate")).alias("y"))
    return o.select("k", op.standalone_query(F.col("b"), F.col("p"), F.array().cast("array<string>"), F.col("y")).alias("q"))


_TURNS = "t AS (SELECT user_id, event_id, event_type = 'signup' AS change, CASE WHEN event_type = 'view' THEN 'v' || event_id % 5 END AS bank, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS product FROM events), g AS (SELECT *, sum(change::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS topic FROM t), state AS (SELECT user_id, event_id, last_value(bank IGNORE NULLS) OVER w AS bank, last_value(product IGNORE NULLS) OVER w AS product FROM g WINDOW w AS (PARTITION BY user_id, topic ORDER BY event_id))"


def _state(spark, d):
    e = A.events(spark, d)
    rows = e.select("user_id", "event_id", (F.col("event_type") == "signup").alias("change"), F.when(F.col("event_type") == "view", F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string"))).alias("bank"), F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).alias("product"))
    return op.fold_session(rows, ["bank", "product"], "change", "user_id", "event_id")


@query("l5_fold_session", f"WITH {_TURNS} SELECT * FROM state")
def l5(spark, d):
    return _state(spark, d)


@query("l6_cleared_fields", f"WITH {_TURNS}, p AS (SELECT *, lag(bank) OVER v AS b, lag(product) OVER v AS q FROM state WINDOW v AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, array_to_string(list_filter([CASE WHEN b IS NOT NULL AND b IS DISTINCT FROM bank THEN 'bank' END, CASE WHEN q IS NOT NULL AND q IS DISTINCT FROM product THEN 'product' END], lambda x: x IS NOT NULL), ',') AS cleared FROM p")
def l6(spark, d):
    return op.cleared_fields(_state(spark, d), ["bank", "product"], "user_id", "event_id")


_EV = "ev AS (SELECT l_suppkey AS query_id, l_orderkey AS doc_id, l_returnflag || l_linestatus AS bank, CASE WHEN l_quantity < 48 THEN l_quantity END AS value, l_linenumber / 10 AS rrf FROM lineitem)"


def _evidence(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("doc_id")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("bank"), F.max(F.when(F.col("l_quantity") < 48, F.col("l_quantity"))).alias("value"), F.max(F.col("l_linenumber") / 10).alias("rrf"))


_EV = "ev AS (SELECT l_suppkey AS query_id, l_orderkey AS doc_id, min(l_returnflag || l_linestatus) AS bank, max(CASE WHEN l_quantity < 48 THEN l_quantity END) AS value, max(l_linenumber / 10) AS rrf FROM lineitem GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC NULLS LAST, rrf DESC, bank, doc_id) AS place FROM ev)"


@query("l8_l10_order_evidence", f"WITH {_EV} SELECT query_id, doc_id, place, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY place) AS source_id FROM ord WHERE place <= 8")
def l8(spark, d):
    return op.source_ids(op.order_evidence(_evidence(spark, d), True).filter("place <= 8").select("query_id", "doc_id", "place"))


_HITS = """hits AS (SELECT query_id, doc_id, place, bank, doc_id % 2 = 0 AS product_match, doc_id % 9 = 0 AS contradicts, doc_id % 3 = 0 AS field_match, doc_id % 5 % 3 AS confirmation, ['lookup', 'compare', 'list', 'calculate', 'historical'][query_id % 5 + 1] AS intent,
query_id % 4 > 0 AS asks_product, query_id % 3 > 0 AS asks_field, query_id % 7 = 0 AS asks_bank, query_id % 2 = 1 AS "numeric" FROM ord WHERE place <= 40),
fl AS (SELECT *, product_match AND NOT contradicts AS p, product_match AND NOT contradicts AND field_match AS j, field_match AND confirmation > 0 AS c FROM hits),
an AS (SELECT *, bool_or(p) OVER q AS ap, bool_or(field_match) OVER q AS af, bool_or(j) OVER q AS aj, bool_or(c) OVER q AS ac, asks_product AND asks_field AND "numeric" AND intent <> 'historical' AS num FROM fl WINDOW q AS (PARTITION BY query_id)),
pk AS (SELECT *, CASE WHEN num THEN CASE WHEN aj THEN 'joint' WHEN ac THEN 'confirmed' WHEN intent = 'lookup' AND ap THEN 'product' ELSE 'none' END WHEN asks_product AND asks_field AND af THEN 'joint_first' WHEN asks_product AND ap THEN 'product' WHEN asks_field AND af THEN 'field' ELSE 'all' END AS pick FROM an),
kept AS (SELECT *, num AND NOT asks_bank AND intent IN ('compare', 'list') AND pick IN ('joint', 'confirmed') AS wide FROM pk WHERE CASE pick WHEN 'joint' THEN j WHEN 'confirmed' THEN c WHEN 'product' THEN p WHEN 'field' THEN field_match WHEN 'joint_first' THEN field_match ELSE pick = 'all' END),
led AS (SELECT *, CASE WHEN wide AND row_number() OVER (PARTITION BY query_id, bank ORDER BY confirmation DESC, place) = 1 THEN 0 WHEN pick = 'joint_first' AND j THEN 0 ELSE 1 END AS lead FROM kept)"""


@query("l7_select_evidence", f"WITH {_EV}, {_HITS} SELECT query_id, chunk_id, bank, pick, r AS place FROM (SELECT query_id, doc_id AS chunk_id, bank, pick, row_number() OVER (PARTITION BY query_id ORDER BY lead, place) AS r FROM led) WHERE r <= 8")
def l7(spark, d):
    n, q = F.col("doc_id"), F.col("query_id")
    hits = op.order_evidence(_evidence(spark, d), True).filter("place <= 40").select(
        "query_id", F.col("doc_id").alias("chunk_id"), "place", "bank", (n % 2 == 0).alias("product_match"), (n % 9 == 0).alias("contradicts"), (n % 3 == 0).alias("field_match"), (n % 5 % 3).alias("confirmation"),
        F.element_at(F.array(*map(F.lit, ("lookup", "compare", "list", "calculate", "historical"))), (q % 5 + 1).cast("int")).alias("intent"), (q % 4 > 0).alias("asks_product"), (q % 3 > 0).alias("asks_field"), (q % 7 == 0).alias("asks_bank"), (q % 2 == 1).alias("numeric"),
    )
    return op.select_evidence(hits, 8)


@query("l9_numeric_answer_rows", f"WITH {_EV}, o AS (SELECT query_id, bank, max(value) AS value, arg_max(doc_id, (value, doc_id)) AS doc_id, count(*) OVER (PARTITION BY query_id) AS banks FROM ev WHERE value IS NOT NULL GROUP BY query_id, bank) SELECT query_id, bank, value, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, bank) AS place FROM o WHERE banks >= 2 QUALIFY place <= 3")
def l9(spark, d):
    return op.numeric_answer_rows(_evidence(spark, d).filter("value is not null"), 3)


@query("l11_validate_answers", "SELECT CASE WHEN e.doc_id IS NULL THEN 'unknown_source' ELSE 'none' END AS issue, count(*) AS n FROM documents c LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) e USING (doc_id) WHERE regexp_matches(c.text, '[a-z]{6}.*[a-z]{6}.*[a-z]{6}') GROUP BY 1")
def l11(spark, d):
    docs = A.table(spark, d, "documents")
    claims = docs.filter(F.col("text").rlike(r"[a-z]{6}[^\n]*[a-z]{6}[^\n]*[a-z]{6}")).select(F.col("doc_id").alias("query_id"), F.lit("S1").alias("source_id"), F.col("text").alias("claim"))
    return op.validate_answers(claims, docs.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("query_id"), F.lit("S1").alias("source_id"), "text"))


@query("l13_recent_context", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, length(substr(text, 1, 300)) AS n FROM conversations), u AS (SELECT conv_id, turn, age, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM a WHERE age <= 6) SELECT * FROM u WHERE used <= 1000")
def l13(spark, d):
    return op.recent_context(A.table(spark, d, "conversations"), 6, 1000, 300)


@query("l12_merge_session_hits")
def l12(spark, d):
    ranked = op.order_evidence(_evidence(spark, d), True).select("query_id", F.col("place").cast("long").alias("place"), F.col("doc_id").alias("chunk_id"), F.col("bank").alias("offer_id"), (F.col("doc_id") % 50).alias("doc_id"))
    return op.merge_session_hits(ranked.filter("place <= 6"), ranked.filter("place between 5 and 16"))


@query("l14_cited_refs", "SELECT user_id AS conv_id, 'S' || event_id % 4 AS source_id, max(event_id) AS turn FROM events WHERE event_type <> 'error' AND event_id % 3 > 0 GROUP BY ALL")
def l14(spark, d):
    e = A.events(spark, d).withColumnRenamed("user_id", "conv_id").withColumnRenamed("event_id", "turn")
    turns = e.select("conv_id", "turn", F.concat(F.lit("so [S"), (F.col("turn") % 4).cast("string"), F.lit("] says, not [S9]")).alias("text"), (F.col("event_type") != "error").alias("verified"))
    return op.cited_refs(turns, e.filter("turn % 3 > 0").select("conv_id", "turn", F.concat(F.lit("S"), (F.col("turn") % 4).cast("string")).alias("source_id")))


@query("n1_embed_chunks")
def n1(spark, d):
    from offerscope.operators.embed import embed_chunks, hashing_embedder

    return embed_chunks(A.table(spark, d, "documents").select("doc_id", "text"), hashing_embedder(64), 64).select("doc_id", "embedding")


@query("st2_session_ttl", "WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session")
def st2(spark, d):
    return op.session_islands(A.events(spark, d), 3600)


@query("a5_html_to_text")
def a5(spark, d):
    from offerscope.sources.html import html_to_text

    return html_to_text(A.table(spark, d, "pages"))
