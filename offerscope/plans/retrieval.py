"""Queries of sections E (chunks), G (classification) and H (retrieval) on the given tables, with their SQL."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.adapters import DOCS, SNAPS
from offerscope.operators import chunk as C
from offerscope.operators import classify as G
from offerscope.operators import retrieve as H
from offerscope.plans.corpus import FOLD
from offerscope.plans.facts import _FOUND, _found
from offerscope.operators import embed as E
from offerscope.operators import search as S
from offerscope.registry import query

WORDS = "list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def _title_docs(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")


# --- E
@query("e4_chunk_documents")
def e4(spark, d):
    return C.chunk_documents(A.table(spark, d, "documents"))


@query("e5_char_windows", "SELECT doc_id, i::INT AS chunk_index, substr(text, i * 900 + 1, 1000) AS chars FROM documents, unnest(range(0, greatest((length(text) - 101) // 900 + 1, 1))) AS u(i) WHERE length(text) > 0")
def e5(spark, d):
    return C.char_windows(A.table(spark, d, "documents"), 1000, 100)


# A window's end: the last break in its last 35 %, else its full length; the next begins after the first space of the overlap.
_LAST = "CASE WHEN instr(reverse(tail), {r}) > 0 THEN length(tail) - instr(reverse(tail), {r}) - {n} ELSE -1 END"
_BREAK = f"""greatest({_LAST.format(r='chr(10)', n=0)}, {_LAST.format(r="' .'", n=1)}, {_LAST.format(r="' ;'", n=1)})"""
_CUT = f"SELECT *, CASE WHEN b0 + 1000 >= length(t) THEN length(t) WHEN brk >= 0 THEN b0 + 651 + brk ELSE b0 + 1000 END AS b1 FROM (SELECT *, {_BREAK} AS brk FROM (SELECT *, substr(t, b0 + 651, 350) AS tail FROM w))"
_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("e5_text_windows", f"""WITH RECURSIVE d AS (SELECT doc_id, trim(text, {_EDGE}) AS t FROM documents), w(doc_id, t, i, b0) AS (SELECT doc_id, t, 1, 0::BIGINT FROM d WHERE length(t) > 0
UNION ALL SELECT doc_id, t, i + 1, CASE WHEN instr(lead_, ' ') > 0 THEN nxt + instr(lead_, ' ') ELSE nxt END FROM (SELECT *, substr(t, nxt + 1, b1 + 1 - nxt) AS lead_ FROM (SELECT *, greatest(b1 - 150, b0 + 1) AS nxt FROM ({_CUT}))) WHERE b1 < length(t)),
c AS (SELECT doc_id, i, trim(substr(t, b0 + 1, b1 - b0), {_EDGE}) AS chars FROM ({_CUT}) WHERE b0 < length(t))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, chars FROM c WHERE length(chars) > 0""")
def e5_text(spark, d):
    return C.text_windows(A.table(spark, d, "documents"), 1000, 150)


@query("e6_token_windows", f"""WITH w AS (SELECT doc_id, {WORDS.format(c='text')} AS w, list_slice({WORDS.format(c="split_part(text, chr(10), 1)")}, 1, 64) AS h FROM documents), r AS (SELECT *, greatest(384 - len(h), 65) AS room FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS chunk_index, array_to_string(list_concat(h, list_slice(w, 1 + i * (room - 64), i * (room - 64) + room)), ' ') AS content, len(list_slice(w, 1 + i * (room - 64), i * (room - 64) + room))::INT AS n_body
FROM r, unnest(range(0, (greatest(len(w) - 64, 1) - 1) // (room - 64) + 1)) AS u(i)""")
def e6(spark, d):
    return C.token_windows(_title_docs(spark, d))


_CH = "ch AS (SELECT doc_id, i::INT AS chunk_index, substr(text, i * 900 + 1, 1000) AS content FROM documents, unnest(range(0, greatest((length(text) - 101) // 900 + 1, 1))) AS u(i) WHERE length(text) > 0)"


def _chunks(spark, d):
    return C.char_windows(A.table(spark, d, "documents"), 1000, 100).withColumnRenamed("chars", "content")


@query("e7_attach_facts", f"""WITH {_CH}, {_FOUND}, f AS (SELECT DISTINCT doc_id, fact_type, segment AS evidence FROM found), x AS (SELECT ch.doc_id, chunk_index, fact_type, evidence, {FOLD.format(c='content')} AS c, {FOLD.format(c='evidence')} AS e FROM ch JOIN f USING (doc_id)),
y AS (SELECT *, instr(c, e) AS pos FROM x WHERE e <> '' AND contains(c, e)), z AS (SELECT *, least(pos - 1, length(c) - length(e) - pos + 1) AS margin FROM y)
SELECT doc_id, fact_type, evidence, chunk_index, margin FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, evidence ORDER BY margin DESC, chunk_index) = 1""")
def e7(spark, d):
    return C.attach_facts(_chunks(spark, d), _found(spark, d).select("doc_id", "fact_type", "evidence").distinct())


@query("e8_chunk_ids", f"WITH {_CH} SELECT doc_id, chunk_index, sha256('current' || chr(31) || doc_id || chr(31) || chunk_index || chr(31) || sha256(content)) AS chunk_id FROM ch")
def e8(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_index", C.chunk_id(F.lit("current"), F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


@query("e9_offer_boundary", "SELECT l_orderkey AS doc_id, sha256(array_to_string(list_sort(list(DISTINCT l_returnflag || '=' || l_linestatus || ' ' || l_quantity::INT)), chr(31))) AS boundary FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def e9(spark, d):
    return C.offer_boundary(A.facts(spark, d), ("A", "R"))


_OFFER = f"o AS (SELECT doc_id, {FOLD.format(c='source')} || chr(31) || {FOLD.format(c='lang')} || chr(31) || 'https://shop.example/p/' || doc_id || '?a=1&b=2' || chr(31) || {FOLD.format(c='split_part(text, chr(10), 1)')} || chr(31) || coalesce(boundary, '') || chr(31) || coalesce(start::VARCHAR, '') || chr(31) || coalesce(\"end\"::VARCHAR, '') AS parts"


@query("e8_offer_id", f"""WITH b AS (SELECT l_orderkey AS doc_id, sha256(array_to_string(list_sort(list(DISTINCT l_returnflag || '=' || l_linestatus || ' ' || l_quantity::INT)), chr(31))) AS boundary FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
p AS (SELECT l_orderkey AS doc_id, min(l_shipdate::DATE) AS start, max(l_shipdate::DATE) AS "end" FROM lineitem GROUP BY 1), {_OFFER} FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN p USING (doc_id)) SELECT doc_id, sha256(parts) AS offer_id FROM o""")
def e8_offer(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("title"))
    lines = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("start"), F.max(F.col("l_shipdate").cast("date")).alias("end"))
    rows = docs.join(C.offer_boundary(A.facts(spark, d), ("A", "R")), "doc_id", "left").join(lines, "doc_id", "left")
    url = F.concat(F.lit("HTTPS://Shop.example:443/p//"), F.col("doc_id").cast("string"), F.lit("/?b=2&utm_source=x&a=1#top"))
    return rows.select("doc_id", C.offer_id(F.col("source"), F.col("lang"), url, F.col("title"), F.col("boundary"), F.col("start"), F.col("end")).alias("offer_id"))


@query("e10_embedding_context", f"WITH {DOCS}, {_CH} SELECT doc_id, chunk_index, 'Title: ' || title || chr(10) || 'Bank: ' || bank || chr(10) || 'Product: ' || product || chr(10) || 'Section: -' || chr(10) || 'Content:' || chr(10) || content AS context FROM ch JOIN docs USING (doc_id)")
def e10(spark, d):
    rows = _chunks(spark, d).join(A.docs(spark, d).select("doc_id", "title", "bank", "product"), "doc_id")
    return rows.select("doc_id", "chunk_index", C.embedding_context(F.col("title"), F.col("bank"), F.col("product"), F.lit(None).cast("string"), F.col("content")).alias("context"))


_TERMS = "list_filter(string_split(trim(regexp_replace(" + FOLD.format(c="{c}") + ", '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
POSTINGS = f"""terms AS (SELECT doc_id, unnest({_TERMS.format(c="split_part(text, chr(10), 1)")}) AS term, 'A' AS weight FROM documents UNION ALL SELECT doc_id, unnest({_TERMS.format(c='source')}), 'B' FROM documents UNION ALL SELECT doc_id, unnest({_TERMS.format(c='text')}), 'C' FROM documents),
postings AS (SELECT doc_id, term, weight, count(*) AS tf FROM terms GROUP BY ALL)"""


def _postings(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source", "text")
    return C.weighted_postings(rows, {"title": "A", "source": "B", "text": "C"})


@query("e11_weighted_postings", f"WITH {POSTINGS} SELECT * FROM postings")
def e11(spark, d):
    return _postings(spark, d)


@query("e12_sync_chunks", "WITH e AS (SELECT l_orderkey AS doc_id, l_partkey AS chunk_id FROM lineitem), n AS (SELECT doc_id, chunk_id + 1 AS chunk_id FROM e WHERE doc_id % 5 = 0) SELECT 'row' AS kind, doc_id, chunk_id FROM e WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT 'row', doc_id, chunk_id FROM n UNION ALL SELECT 'stale', NULL, chunk_id FROM e WHERE doc_id IN (SELECT doc_id FROM n) AND chunk_id NOT IN (SELECT chunk_id FROM n)")
def e12(spark, d):
    old = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id"))
    rows, stale = C.sync_chunks(old.filter("doc_id % 5 = 0").select("doc_id", (F.col("chunk_id") + 1).alias("chunk_id")), old)
    return rows.select(F.lit("row").alias("kind"), "doc_id", "chunk_id").unionByName(stale.select(F.lit("stale").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "chunk_id"))


@query("e13_load_scope", f"WITH {SNAPS} SELECT 'current' AS scope, doc_id, NULL::DATE AS day FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'historical', snap_id, day FROM snaps WHERE searchable")
def e13(spark, d):
    live = A.table(spark, d, "documents").filter("trim(text) <> ''").select(F.lit("current").alias("scope"), "doc_id", F.lit(None).cast("date").alias("day"))
    return live.unionByName(A.snapshots(spark, d).filter("searchable").select(F.lit("historical").alias("scope"), F.col("snap_id").alias("doc_id"), "day"))


@query("e14_index_report", f"WITH {_CH} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM ch")
def e14(spark, d):
    return _chunks(spark, d).agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("e15_pending_embeddings", f"WITH {SNAPS} SELECT snap_id FROM snaps WHERE searchable AND snap_id NOT IN (SELECT vec_id FROM embeddings)")
def e15(spark, d):
    return C.pending_embeddings(A.snapshots(spark, d), A.table(spark, d, "embeddings").select(F.col("vec_id").alias("snap_id"))).select("snap_id")


# --- G
_RULES = [("rights reserved", "legal", "rights"), ("license", "legal", "license"), (r"[0-9]{4}", "numbers", "digits"), (r"\bthe\b", "english", "article")]
_RULED = f"WITH x AS (SELECT doc_id, {FOLD.format(c='text')} AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'rights reserved') OR contains(t, 'license') THEN 'legal' WHEN regexp_matches(t, '[0-9]{{4}}') THEN 'numbers' WHEN regexp_matches(t, '\\bthe\\b') THEN 'english' END AS label, CASE WHEN contains(t, 'rights reserved') THEN 'rights' WHEN contains(t, 'license') THEN 'license' WHEN regexp_matches(t, '[0-9]{{4}}') THEN 'digits' WHEN regexp_matches(t, '\\bthe\\b') THEN 'article' END AS reason FROM x"


@query("g1_ordered_rules", _RULED)
def g1(spark, d):
    from offerscope.functions.text import fold_text

    r = G.first_rule(F.col("t"), _RULES)
    return A.table(spark, d, "documents").select("doc_id", fold_text("text").alias("t")).select("doc_id", r["label"].alias("label"), r["reason"].alias("reason"))


@query("g2_url_rules", "SELECT page_id, CASE WHEN regexp_matches(p, '^/en(/|$)') THEN 'english' WHEN regexp_matches(p, '^/(de|fr|es)(/|$)') THEN 'foreign' END AS label FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def g2(spark, d):
    r = G.first_rule(F.try_parse_url("url", F.lit("PATH")), [("^/en(/|$)", "english", "path"), ("^/(de|fr|es)(/|$)", "foreign", "path")])
    return A.table(spark, d, "pages").select("page_id", r["label"].alias("label"))


def _scores(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x")).select("doc_id", F.concat(F.lit("l"), "i").alias("label"), F.round(F.abs("x").cast("double"), 3).alias("score"))


@query("g3_merge_label_aliases", """WITH s AS (SELECT vec_id AS doc_id, CASE WHEN i = 3 THEN 'l1' ELSE 'l' || i END AS label, round(abs(embedding[i + 1]::DOUBLE), 3) AS score FROM embeddings, unnest(range(0, 4)) AS u(i)), m AS (SELECT doc_id, label, round(sum(score), 4) AS score FROM s GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM m""")
def g3(spark, d):
    return G.merge_label_aliases(_scores(spark, d), {"l3": "l1"})


_RESOLVE = """r AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 5 = 0 THEN 'c' || label END AS url, CASE WHEN vec_id % 7 = 0 THEN 'c' || (label + 1) % 10 END AS title, CASE WHEN vec_id % 3 = 0 THEN 'c' || (label + vec_id) % 10 END AS body, 'c' || label AS model, vec_id % 101 / 100 AS score FROM embeddings),
x AS (SELECT *, coalesce(url, title) AS firm, coalesce(url, title, body) AS meta, score >= 0.95 AS sure FROM r),
resolved AS (SELECT doc_id, CASE WHEN meta IS NULL THEN model WHEN firm IS NOT NULL THEN firm WHEN sure THEN model ELSE meta END AS label,
CASE WHEN meta IS NULL THEN CASE WHEN score >= 0.8 THEN 'ACCEPTED' ELSE 'REVIEW' END WHEN model = meta THEN 'ACCEPTED' WHEN firm IS NOT NULL AND NOT sure THEN 'ACCEPTED' WHEN firm IS NULL AND sure THEN 'ACCEPTED' ELSE 'REVIEW' END AS decision,
CASE WHEN meta IS NULL THEN 'model' WHEN model = meta THEN 'agreement' WHEN firm IS NOT NULL THEN 'metadata' ELSE 'model' END AS basis,
array_to_string(list_filter([CASE WHEN meta IS NULL THEN 'no_metadata' END, CASE WHEN meta IS NOT NULL AND model <> meta THEN 'conflict' END, CASE WHEN score < 0.8 THEN 'low_score' END], lambda z: z IS NOT NULL), ',') AS reasons FROM x)"""


def _resolved(spark, d):
    e = A.table(spark, d, "embeddings").withColumn("doc_id", F.col("vec_id"))
    label = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return G.resolve_label(
        e.select(
            "doc_id", F.when(F.col("vec_id") % 5 == 0, label(F.col("label"))).alias("url"), F.when(F.col("vec_id") % 7 == 0, label((F.col("label") + 1) % 10)).alias("title"), F.lit(None).cast("string").alias("url_advisory"),
            F.when(F.col("vec_id") % 3 == 0, label((F.col("label") + F.col("vec_id")) % 10)).alias("body_advisory"), label(F.col("label")).alias("model"), (F.col("vec_id") % 101 / 100).alias("score"),
        )
    )


@query("g4_resolve_label", f"WITH {_RESOLVE} SELECT * FROM resolved")
def g4(spark, d):
    return _resolved(spark, d)


@query("g5_g6_classification_status", f"""WITH {DOCS} SELECT doc_id, CASE WHEN verified THEN 'verified' WHEN product = 'es' THEN 'required' WHEN coalesce(confidence, 0) < 0.65 THEN 'required' WHEN product = 'fr' THEN 'review' WHEN confidence >= 0.8 THEN 'accepted' ELSE 'review' END AS status FROM docs""")
def g5(spark, d):
    decision = F.when(F.col("product") == "es", "FAILED").when(F.col("product") == "fr", "REVIEW").otherwise("ACCEPTED")
    return A.docs(spark, d).select("doc_id", G.classification_status(F.col("verified"), decision, F.lit(False), F.col("confidence")).alias("status"))


@query("g7_product_conflict", "SELECT doc_id, lang <> 'en' AND regexp_matches(text, '\\b(the|and|of)\\b') OR lang <> 'de' AND regexp_matches(text, '\\b(der|die|und)\\b') AS conflict FROM documents")
def g7(spark, d):
    signs = {"en": r"\b(the|and|of)\b", "de": r"\b(der|die|und)\b"}
    seen = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in signs.items())))
    return A.table(spark, d, "documents").select("doc_id", F.exists(seen, lambda k: k != F.col("lang")).alias("conflict"))


@query("g8_top3_scores", """WITH s AS (SELECT vec_id AS doc_id, 'l' || i AS label, round(abs(embedding[i + 1]::DOUBLE), 3) AS score FROM embeddings, unnest(range(0, 4)) AS u(i))
SELECT doc_id, string_agg(label || ':' || least(score, 1), ',' ORDER BY label) AS top FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 3) GROUP BY doc_id""")
def g8(spark, d):
    ranked = G.merge_label_aliases(_scores(spark, d), {}).filter("place <= 3")
    return ranked.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", F.least("score", F.lit(1.0)).cast("string")))), ",").alias("top"))


@query("g9_diagnose", f"""WITH {_RESOLVE}, o AS (SELECT doc_id, decision, basis, unnest(string_split(CASE WHEN reasons = '' THEN 'none' ELSE reasons END, ',')) AS reason FROM resolved), k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY decision, basis, reason ORDER BY doc_id) <= 5)
SELECT decision, basis, reason, (SELECT count(*) FROM o WHERE o.decision = k.decision AND o.basis = k.basis AND o.reason = k.reason) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS samples FROM k GROUP BY decision, basis, reason""")
def g9(spark, d):
    return G.diagnose(_resolved(spark, d))


@query("g10_g12_text_classifier")
def g10(spark, d):
    docs = A.table(spark, d, "documents")
    model = G.train_text_classifier(docs.sample(0.5, seed=3).limit(20_000), "lang")  # fitted on a bounded sample, applied to all
    return G.score_classifier(model, docs)


@query("g11_class_weights", "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), r AS (SELECT quality, n, sqrt(sum(n) OVER () / n) AS raw FROM n) SELECT quality, n, round(least(greatest(raw / avg(raw) OVER (), 0.35), 5), 6) AS weight FROM r")
def g11(spark, d):
    return G.class_weights(A.table(spark, d, "labels"), "quality")


# --- H
_SIDES = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), dense AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM embeddings, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) <= {k})"


def _vectors(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query("h1_cosine_topk", f"WITH {_SIDES.format(k=10)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM dense")
def h1(spark, d):
    return H.cosine_topk(*_vectors(spark, d), 10)


@query("h2_ann_topk")
def h2(spark, d):
    return H.ann_topk(*_vectors(spark, d), 10)


_ASKED = f"asked AS (SELECT item_id AS query_id, list_slice(list_filter(o, lambda w: length(w) >= 3), 1, 32) AS terms FROM (SELECT item_id, list_reduce(list_prepend([]::VARCHAR[], list_transform({_TERMS.format(c='text')}, lambda t: [t])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS o FROM benchmark))"


@query("h3_query_terms", f"WITH {_ASKED} SELECT query_id AS item_id, terms FROM asked")
def h3(spark, d):
    return _asked(spark, d).withColumnRenamed("query_id", "item_id")


_SCORE = "round(sum(round(CASE weight WHEN 'A' THEN 1 WHEN 'B' THEN 0.4 ELSE 0.2 END * (1 + ln(tf)), 6)::DECIMAL(18, 6))::DOUBLE * count(DISTINCT {t}) / any_value(n) + 1e-9::DOUBLE, 5) AS score"
_LEX = f"""{POSTINGS}, {_ASKED}, qt AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM asked),
lex AS (SELECT query_id, doc_id AS chunk_id, {_SCORE.format(t='term')} FROM postings JOIN qt USING (term) GROUP BY query_id, doc_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM lex QUALIFY place <= 20)"""


def _asked(spark, d):
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), H.query_terms(F.col("text")).alias("terms"))


def _lexical(spark, d, k=20):
    return H.lexical_topk(_asked(spark, d), _postings(spark, d).withColumnRenamed("doc_id", "chunk_id"), k, grouped=True)


@query("h4_prefix_topk", f"""WITH {POSTINGS}, {_ASKED}, qt AS (SELECT query_id, unnest(terms) AS prefix, len(terms) AS n FROM asked), hit AS (SELECT query_id, doc_id AS chunk_id, {_SCORE.format(t='prefix')} FROM postings JOIN qt ON substr(term, 1, 3) = substr(prefix, 1, 3) AND starts_with(term, prefix) GROUP BY query_id, doc_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM hit QUALIFY place <= 20""")
def h4(spark, d):
    return H.prefix_topk(_asked(spark, d), _postings(spark, d).withColumnRenamed("doc_id", "chunk_id"), 20, grouped=True)


@query("h5_lexical_topk", f"WITH {_LEX} SELECT * FROM lexical")
def h5(spark, d):
    return _lexical(spark, d)


@query("h6_h9_filters", f"WITH {DOCS} SELECT doc_id FROM docs WHERE product IN ('en', 'fr') AND bank <> 'src0' AND (verified OR coalesce(confidence >= 0.5, false) AND product <> 'fr')")
def h6(spark, d):
    rows = A.docs(spark, d).filter("product in ('en', 'fr') and bank <> 'src0'")
    return rows.filter(H.trust_filter(F.col("verified"), F.col("confidence"), F.when(F.col("product") == "fr", "failed").otherwise("accepted"), F.lit(False), 0.5)).select("doc_id")


@query("h7_campaign_overlap", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_returnflag <> 'A' THEN l_shipdate END IS NOT NULL OR CASE WHEN l_returnflag <> 'R' THEN l_shipdate + INTERVAL 30 DAY END IS NOT NULL) AND (l_returnflag = 'A' OR l_shipdate::DATE <= DATE '1996-12-31') AND (l_returnflag = 'R' OR (l_shipdate + INTERVAL 30 DAY)::DATE >= DATE '1996-01-01')")
def h7(spark, d):
    day = F.col("l_shipdate").cast("date")
    start, end = F.when(F.col("l_returnflag") != "A", day), F.when(F.col("l_returnflag") != "R", F.date_add(day, 30))
    return A.table(spark, d, "lineitem").filter(H.campaign_overlap(start, end, F.make_date(F.lit(1996), F.lit(1), F.lit(1)), F.make_date(F.lit(1996), F.lit(12), F.lit(31)))).select("l_orderkey", "l_linenumber")


@query("h8_route_bounds", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderstatus = 'P' OR o_custkey % 4 = 0 THEN 'campaign' ELSE 'effective' END AS mode, CASE WHEN o_orderkey % 2 = 0 THEN make_date(year(o_orderdate), 1, 1) WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS since, CASE WHEN o_orderkey % 2 = 0 THEN make_date(year(o_orderdate), 12, 31) END AS until FROM orders")
def h8(spark, d):
    o, even = A.table(spark, d, "orders"), F.col("o_orderkey") % 2 == 0
    fields = F.array(F.when(F.col("o_orderpriority").startswith("1"), "campaign_end").otherwise("rate"))
    says = F.when(F.col("o_custkey") % 4 == 0, "Hangi KAMPANYALAR var?").otherwise("Oran nedir?")
    mode = H.date_mode(fields, F.when(F.col("o_orderstatus") == "P", "campaign"), says)
    b = H.route_bounds(F.when(even, F.year("o_orderdate")), F.when(~even & (F.col("o_orderkey") % 3 == 0), F.col("o_orderdate").cast("date")), F.lit(None).cast("date"))
    return o.select("o_orderkey", mode.alias("mode"), b["since"].alias("since"), b["until"].alias("until"))


_RRF = f"""{_SIDES.format(k=20)}, dr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM dense), {_LEX},
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + a.place), 0) + coalesce(0.5::DOUBLE / (60 + b.place), 0), 9) AS rrf FROM dr a FULL JOIN lexical b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM fused)"""


def _fused(spark, d):
    return H.rrf_fuse(H.cosine_topk(*_vectors(spark, d), 20), _lexical(spark, d))


@query("h10_rrf_fuse", f"WITH {_RRF} SELECT * FROM hits")
def h10(spark, d):
    return _fused(spark, d)


@query("h11_h12_hybrid_search", f"WITH {_RRF}, b AS (SELECT query_id, chunk_id, chunk_id % 50 AS doc_id, rrf FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id % 50 ORDER BY rrf DESC, chunk_id) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS place FROM b QUALIFY place <= 10")
def h11(spark, d):
    return H.best_chunk_per_document(_fused(spark, d).drop("place").withColumn("doc_id", F.col("chunk_id") % 50), 10)


_RANKED = f"""{_RRF}, m AS (SELECT query_id, chunk_id, chunk_id % 50 AS doc_id, chunk_id % 40 AS offer_id, 'b' || chunk_id % 7 AS bank, rrf, chunk_id % 11 = 0 AS verified, chunk_id % 2 = 0 AS pm, chunk_id % 3 = 0 AS fm FROM hits),
t AS (SELECT *, CASE WHEN verified THEN 0 ELSE 1 END AS trust, CASE WHEN pm AND fm THEN 0 WHEN fm THEN 1 WHEN pm THEN 2 ELSE 3 END AS tier FROM m),
ranked AS (SELECT query_id, chunk_id, doc_id, offer_id, bank, tier, row_number() OVER (PARTITION BY query_id ORDER BY trust, tier, chunk_id % 4 DESC, rrf DESC, bank, doc_id, chunk_id) AS place FROM t)"""


def _ranked(spark, d):
    c = F.col("chunk_id")
    rows = _fused(spark, d).drop("place").select("*", (c % 50).alias("doc_id"), (c % 40).alias("offer_id"), F.concat(F.lit("b"), (c % 7).cast("string")).alias("bank"), (c % 11 == 0).alias("verified"), (c % 2 == 0).alias("product_match"), (c % 3 == 0).alias("field_match"), (c % 4).alias("coverage"))
    return H.relevance_rank(rows).select("query_id", "chunk_id", "doc_id", "offer_id", "bank", "tier", "place")


@query("h15_relevance_rank", f"WITH {_RANKED} SELECT * FROM ranked")
def h15(spark, d):
    return _ranked(spark, d)


_DEDUP = f"{_RANKED}, o1 AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, offer_id ORDER BY place) = 1), o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY place) = 1)"


@query("h16_dedup_hits", f"WITH {_DEDUP} SELECT * FROM o2")
def h16(spark, d):
    return H.dedup_hits(_ranked(spark, d))


@query("h17_diversify", f"WITH {_DEDUP}, v AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier, bank ORDER BY place) AS turn, min(place) OVER (PARTITION BY query_id, tier, bank) AS first FROM o2) SELECT query_id, chunk_id, doc_id, offer_id, bank, tier, place, row_number() OVER (PARTITION BY query_id ORDER BY tier, turn, first, place) AS final FROM v QUALIFY final <= 8")
def h17(spark, d):
    return H.diversify(H.dedup_hits(_ranked(spark, d)), 8)


@query("h18_numeric_value", "SELECT l_orderkey AS doc_id, max(CASE l_linestatus WHEN 'F' THEN l_quantity * 12 ELSE l_quantity / 30 END) AS best FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def h18(spark, d):
    kind = F.when(F.col("l_linestatus") == "F", "year").otherwise("day")
    return H.best_values(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("fact_type"), kind.alias("kind"), F.col("l_quantity").alias("value")), ("A", "N"))


@query("h19_hydrate", "SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, o_totalprice FROM orders WHERE o_custkey % 3 <> 0")
def h19(spark, d):
    o = A.table(spark, d, "orders")
    refs = o.select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_custkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).alias("doc_id"))
    return H.hydrate(refs, o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "o_totalprice"))


@query("h20_product_family", "SELECT CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('fr', 'es') THEN 'romance' ELSE lang END AS family, count(*) AS n FROM documents GROUP BY 1")
def h20(spark, d):
    return A.table(spark, d, "documents").groupBy(H.product_family(F.col("lang"), {"germanic": ("en", "de"), "romance": ("fr", "es")}).alias("family")).agg(F.count("*").alias("n"))


def _texts(spark, d):
    """Benchmark items as queries and documents as chunks, both with the vector of their own text."""
    embed = lambda rows: E.embed_chunks(rows, E.hashing_embedder(64), 64).withColumnRenamed("embedding", "vector")
    items, n = A.table(spark, d, "benchmark"), F.col("item_id")
    asked = embed(items).select(
        n.alias("query_id"), "vector", H.query_terms(F.col("text")).alias("terms"), F.when(n % 3 == 0, "compare").when(n % 3 == 1, "lookup").otherwise("historical").alias("intent"),
        F.when(n % 4 == 0, F.array(F.lit("src1"), F.lit("src2"))).alias("banks"), F.when(n % 2 == 0, F.array(F.lit("en"))).alias("products"), F.when(n % 5 > 0, F.array(F.lit("year"), F.lit("license"))).alias("fields"),
    )
    text = F.lower("text")
    kinds = F.array_compact(F.array(F.when(text.rlike(r"\b(19|20)[0-9]{2}\b"), "year"), F.when(text.contains("license"), "license"), F.when(text.rlike("[0-9]{5}"), "number")))
    rows = embed(A.table(spark, d, "documents")).join(A.table(spark, d, "labels"), "doc_id", "left")
    chunks = rows.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.sha2(F.substring_index("text", "\n", 1), 256).alias("offer_id"), F.col("source").alias("bank"), F.col("lang").alias("product"), kinds.alias("fields"), "vector",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("primary"), F.coalesce("quality", F.lit(1)).cast("double").alias("confidence"),
    )
    return asked, chunks, _postings(spark, d).withColumnRenamed("doc_id", "chunk_id")


@query("h13_historical_search")
def h13(spark, d):
    asked, chunks, postings = _texts(spark, d)
    old = chunks.select("*", F.col("primary").alias("searchable"), F.lit("accepted").alias("quality_status"), F.lit(None).cast("date").alias("day"), (F.size("fields") > 0).alias("has_facts"))
    return S.historical_search(asked, old, postings, 10, products=("en", "de"), least=0.5)


@query("h14_unified_search")
def h14(spark, d):
    return S.unified_search(*_texts(spark, d), 8).filter("final is not null")


@query("h14_search_diagnostics")
def h14_diagnostics(spark, d):
    asked, chunks, postings = _texts(spark, d)
    return S.search_diagnostics(asked, S.unified_search(asked, chunks, postings, 8))
