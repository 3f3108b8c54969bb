"""Queries of sections J (review), K (training, evaluation) and Q (constraints) on the given tables, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.adapters import FACTS
from offerscope.operators import evaluate as K
from offerscope.operators import review as J
from offerscope.registry import query


def _queue(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("doc_id"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("note"))


QUEUE = "queue AS (SELECT o_orderkey AS review_id, o_custkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created, o_orderpriority AS note FROM orders)"


@query("j1_queue_counts", f"WITH {QUEUE}, s AS (SELECT unnest(['pending', 'approved', 'rejected']) AS status) SELECT s.status, count(review_id) AS n FROM s LEFT JOIN queue USING (status) GROUP BY 1")
def j1(spark, d):
    return J.queue_counts(_queue(spark, d))


@query("j2_list_reviews", f"WITH {QUEUE} SELECT * FROM queue WHERE status = 'pending' ORDER BY created, review_id LIMIT 50")
def j2(spark, d):
    return J.list_reviews(_queue(spark, d), "pending", 50)


@query("j3_queue_documents", f"""WITH {QUEUE}, q AS (SELECT review_id AS record_key, 'd' || doc_id % 3 AS digest, note, status, CASE WHEN review_id % 2 = 0 THEN 'b' END AS base_digest FROM queue WHERE review_id % 3 > 0),
i AS (SELECT review_id AS record_key, 'd' || doc_id % 2 AS digest, 'new' AS note FROM queue WHERE review_id % 4 < 3), dd AS (SELECT review_id AS record_key, 'd' || doc_id % 5 AS digest FROM queue WHERE review_id % 5 = 0)
SELECT record_key, digest, CASE WHEN q.status IS NULL OR q.status = 'pending' AND i.note IS NOT NULL THEN i.note ELSE q.note END AS note, coalesce(q.status, 'pending') AS status, CASE WHEN q.status IS NULL THEN dd.digest ELSE q.base_digest END AS base_digest,
CASE WHEN q.status <> 'pending' AND i.note IS NOT NULL THEN 'already decided' END AS error FROM q FULL JOIN i USING (record_key, digest) LEFT JOIN dd USING (record_key)""".replace("LEFT JOIN dd USING (record_key)", "LEFT JOIN (SELECT record_key AS rk, digest FROM dd) dd ON dd.rk = record_key").replace("SELECT record_key, digest, CASE WHEN q.status IS NULL OR", "SELECT record_key, coalesce(q.digest, i.digest) AS digest, CASE WHEN q.status IS NULL OR"))
def j3(spark, d):
    q, key = _queue(spark, d), F.col("review_id").alias("record_key")
    digest = lambda m: F.concat(F.lit("d"), (F.col("doc_id") % m).cast("string")).alias("digest")
    old = q.filter("review_id % 3 > 0").select(key, digest(3), "note", "status", F.when(F.col("review_id") % 2 == 0, "b").alias("base_digest"))
    return J.queue_documents(q.filter("review_id % 4 < 3").select(key, digest(2), F.lit("new").alias("note")), q.filter("review_id % 5 = 0").select(key, digest(5)), old)


@query("j4_baseline_conflicts", f"""WITH {QUEUE}, r AS (SELECT review_id AS record_key, 'd' || doc_id % 3 AS digest, CASE WHEN review_id % 7 > 0 THEN review_id % 2 = 0 END AS base_exists, CASE WHEN review_id % 2 = 0 THEN 'd' || doc_id % 2 END AS base_digest FROM queue),
n AS (SELECT review_id AS record_key, 'd' || doc_id % 2 AS now FROM queue WHERE review_id % 3 = 0) SELECT record_key, digest, coalesce(now = digest, false) OR (base_exists IS NOT NULL AND base_exists = (now IS NOT NULL) AND base_digest IS NOT DISTINCT FROM now) AS ok FROM r LEFT JOIN n USING (record_key)""")
def j4(spark, d):
    q, key = _queue(spark, d), F.col("review_id").alias("record_key")
    digest = lambda m: F.concat(F.lit("d"), (F.col("doc_id") % m).cast("string"))
    reviews = q.select(key, digest(3).alias("digest"), F.when(F.col("review_id") % 7 > 0, F.col("review_id") % 2 == 0).alias("base_exists"), F.when(F.col("review_id") % 2 == 0, digest(2)).alias("base_digest"))
    return J.baseline_conflicts(reviews, q.filter("review_id % 3 = 0").select(key, digest(2).alias("digest")))


@query("j5_apply_fact_decisions", f"""WITH {QUEUE}, dec AS (SELECT event_id AS fact_id, max(CASE event_type WHEN 'purchase' THEN 'approve' ELSE 'reject' END) AS decision FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
r AS (SELECT review_id AS fact_id, queue.doc_id, status, decision FROM queue LEFT JOIN dec ON fact_id = review_id), f AS (SELECT o_orderkey AS fact_id, o_custkey AS doc_id, 'rule' AS method FROM orders WHERE o_orderkey % 10 = 0)
SELECT method, count(*) AS n FROM (SELECT method FROM f WHERE fact_id NOT IN (SELECT fact_id FROM r WHERE status = 'pending' AND decision = 'approve') UNION ALL SELECT 'human_review' FROM r WHERE status = 'pending' AND decision = 'approve') GROUP BY 1
UNION ALL SELECT 'queue_' || CASE WHEN status = 'pending' AND decision = 'approve' THEN 'approved' WHEN status = 'pending' AND decision = 'reject' THEN 'rejected' ELSE status END, count(*) FROM r GROUP BY 1""")
def j5(spark, d):
    q = _queue(spark, d).select(F.col("review_id").alias("fact_id"), "doc_id", "status", F.lit("t").alias("fact_type"))
    dec = A.events(spark, d).filter("event_type in ('purchase', 'error')").select(F.col("event_id").alias("fact_id"), F.when(F.col("event_type") == "purchase", "approve").otherwise("reject").alias("decision"))
    facts, after = J.apply_fact_decisions(q, dec, q.filter("fact_id % 10 = 0").withColumn("method", F.lit("rule")))
    return facts.groupBy("method").agg(F.count("*").alias("n")).unionByName(after.groupBy(F.concat(F.lit("queue_"), "status").alias("method")).agg(F.count("*").alias("n")))


@query("j6_write_candidates", """WITH l AS (SELECT l_orderkey AS doc_id, l_returnflag AS method, l_linenumber AS n, l_quantity::INT AS q, l_linestatus FROM lineitem), f AS (SELECT doc_id, method, 'k' || q % 5 AS fact_key FROM l WHERE n % 2 = 1),
u AS (SELECT doc_id, method, 'k' || q % 5 AS fact_key, CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'pending' END AS status FROM l WHERE n % 2 = 0), c AS (SELECT doc_id, method, 'k' || q % 7 AS fact_key, CASE WHEN q % 3 = 0 THEN 'accepted' WHEN q % 3 = 1 THEN 'review' ELSE 'rejected' END AS decision FROM l WHERE q > 25)
SELECT 'fact' AS kind, * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = f.doc_id AND c.method = f.method) UNION ALL SELECT 'fact', doc_id, method, fact_key FROM c WHERE decision = 'accepted'
UNION ALL SELECT status, doc_id, method, fact_key FROM u WHERE status <> 'pending' OR NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.method = u.method)
UNION ALL SELECT 'pending', doc_id, method, fact_key FROM c WHERE decision = 'review' AND NOT EXISTS (SELECT 1 FROM u WHERE u.status <> 'pending' AND u.doc_id = c.doc_id AND u.method = c.method AND u.fact_key = c.fact_key)""")
def j6(spark, d):
    l, q = A.table(spark, d, "lineitem"), F.col("l_quantity").cast("int")  # noqa: E741
    key = lambda m: F.concat(F.lit("k"), (q % m).cast("string")).alias("fact_key")
    own = F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("method")
    facts = l.filter("l_linenumber % 2 = 1").select(*own, key(5))
    queue = l.filter("l_linenumber % 2 = 0").select(*own, key(5), F.when(F.col("l_linestatus") == "F", "approved").otherwise("pending").alias("status"))
    candidates = l.filter(q > 25).select(*own, key(7), F.when(q % 3 == 0, "accepted").when(q % 3 == 1, "review").otherwise("rejected").alias("decision"))
    stored, after = J.write_candidates(facts, queue, candidates)
    return stored.select(F.lit("fact").alias("kind"), "*").unionByName(after.withColumnRenamed("status", "kind"))


@query("j7_upsert_snapshots", """WITH o AS (SELECT c_custkey AS k, c_mktsegment AS label, c_acctbal AS value, c_mktsegment = 'BUILDING' AS verified FROM customer), n AS (SELECT o_custkey AS k, max(o_orderpriority) AS label, max(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL OR coalesce(verified, false) THEN o.label ELSE n.label END AS label, CASE WHEN n.k IS NULL THEN o.value ELSE n.value END AS value, coalesce(verified, false) AS verified FROM o FULL JOIN n ON o.k = n.k""")
def j7(spark, d):
    old = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("value"), (F.col("c_mktsegment") == "BUILDING").alias("verified"))
    new = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("label"), F.max("o_totalprice").alias("value"))
    return J.upsert_frozen(old, new, "k", ["label", "value"], ["label"], "verified")


@query("j8_apply_review_sheet", f"""WITH {QUEUE}, s AS (SELECT event_id AS k, CASE event_type WHEN 'click' THEN 'E' WHEN 'error' THEN 'H' ELSE '' END AS a, CASE WHEN event_type = 'signup' THEN 'fixed' END AS nl FROM events)
SELECT review_id AS key, CASE WHEN status = 'pending' AND nl IS NOT NULL THEN nl ELSE note END AS label, CASE WHEN status = 'pending' AND (nl IS NOT NULL OR a = 'E') THEN 'approved' WHEN status = 'pending' AND a = 'H' THEN 'rejected' ELSE status END AS status FROM queue LEFT JOIN s ON k = review_id""")
def j8(spark, d):
    sheet = A.events(spark, d).select(F.col("event_id").alias("key"), F.when(F.col("event_type") == "click", " e").when(F.col("event_type") == "error", "h ").otherwise("").alias("answer"), F.when(F.col("event_type") == "signup", "fixed").otherwise(" ").alias("new_label"))
    return J.apply_review_sheet(_queue(spark, d).select(F.col("review_id").alias("key"), F.col("note").alias("label"), "status"), sheet)


@query("j9_import_upsert", "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linenumber > 1")
def j9(spark, d):
    old = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v"))
    touched = A.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    return J.import_upsert(old, old.join(touched, "k", "left_semi").filter("n > 1").withColumn("v", -F.col("v")), touched, ["k"])


@query("j10_replace_snapshot_facts", """WITH o AS (SELECT l_orderkey AS doc_id, 'v' || l_linenumber % 2 AS version, l_orderkey * 10 + l_linenumber AS fact_key, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS review, 'old' AS decision FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) = 1),
n AS (SELECT doc_id, version, fact_key + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 100000000 END AS fact_key, CASE WHEN fact_key % 2 = 0 THEN 'review' ELSE 'accepted' END AS decision FROM o WHERE version = 'v1'),
b AS (SELECT doc_id, version, fact_key, review, decision, 0 AS age FROM o WHERE review <> 'pending' UNION ALL SELECT doc_id, version, fact_key, review, decision, 2 FROM o WHERE review = 'pending' AND (doc_id, version) NOT IN (SELECT doc_id, version FROM n) UNION ALL SELECT doc_id, version, fact_key, CASE decision WHEN 'review' THEN 'pending' ELSE 'not_required' END, decision, 1 FROM n)
SELECT doc_id, version, fact_key, review, decision FROM b QUALIFY row_number() OVER (PARTITION BY fact_key ORDER BY age, doc_id, decision) = 1""")
def j10(spark, d):
    li = A.table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = li.groupBy(key.alias("fact_key")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")).alias("r"))
    review = F.when(F.col("r.l_returnflag") == "A", "approved").when(F.col("r.l_returnflag") == "R", "rejected").otherwise("pending")
    old = first.select(F.col("r.l_orderkey").alias("doc_id"), F.concat(F.lit("v"), (F.col("r.l_linenumber") % 2).cast("string")).alias("version"), "fact_key", review.alias("review"), F.lit("old").alias("decision"))
    new = old.filter("version = 'v1'").select("doc_id", "version", F.when(F.col("doc_id") % 2 == 0, F.col("fact_key")).otherwise(F.col("fact_key") + 100000000).alias("fact_key"), F.when(F.col("fact_key") % 2 == 0, "review").otherwise("accepted").alias("decision"))
    return J.replace_snapshot_facts(old, new)


# --- K
_U = "('0x' || substr(md5({c}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SPLIT = f"split AS (SELECT *, CASE WHEN {_U.format(c='source')} < 0.7 THEN 'train' WHEN {_U.format(c='source')} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM documents)"


def _split(spark, d):
    return K.leak_free_split(A.table(spark, d, "documents"), "source")


@query("k1_leak_free_split", f"WITH {SPLIT} SELECT doc_id, split FROM split")
def k1(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query("k2_leak_audit", f"WITH {SPLIT}, t AS (SELECT text, list_sort(list(DISTINCT split)) AS s FROM split GROUP BY text HAVING count(DISTINCT split) > 1), p AS (SELECT unnest(list_filter([[a, b] FOR a IN ['test', 'train'] FOR b IN ['train', 'validation']], lambda x: x[1] < x[2] AND list_contains(s, x[1]) AND list_contains(s, x[2]))) AS p FROM t) SELECT p[1] AS left_split, p[2] AS right_split, count(*) AS shared FROM p GROUP BY ALL".replace("[[a, b] FOR a IN ['test', 'train'] FOR b IN ['train', 'validation']]", "[['test', 'train'], ['test', 'validation'], ['train', 'validation']]"))
def k2(spark, d):
    return K.leak_audit(_split(spark, d), "text")


@query("k3_protect_groups", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 7)")
def k3(spark, d):
    docs = A.table(spark, d, "documents")
    return K.protect_groups(docs, docs.filter("doc_id % 50 = 7"), "source").select("doc_id")


@query("k5_silver_class_rows", "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def k5(spark, d):
    return A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id").filter("quality = 1 and toxic = 0").select("doc_id", "lang")


@query("k7_hard_negatives", "WITH s AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS sentence FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS sentence FROM documents WHERE doc_id % 2 = 0) SELECT sentence, sha256(sentence) AS digest FROM s WHERE length(sentence) BETWEEN 40 AND 420 AND regexp_matches(sentence, '[0-9]') AND sentence NOT IN (SELECT sentence FROM b) ORDER BY digest LIMIT (SELECT round_even(0.01 * count(*), 0)::BIGINT FROM b)")
def k7(spark, d):
    s = A.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("sentence"))
    return K.hard_negatives(s, s.filter("doc_id % 2 = 0").select("sentence").distinct(), 0.01)


@query("k8_merge_train", "WITH b AS (SELECT doc_id, lower(text) AS norm FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), e AS (SELECT lower(text) AS norm, min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT doc_id, 'base' AS origin FROM b UNION ALL SELECT doc_id, 'extra' FROM e WHERE norm NOT IN (SELECT norm FROM b)")
def k8(spark, d):
    docs, known = A.table(spark, d, "documents").select("doc_id", "text"), A.table(spark, d, "labels").select("doc_id")
    return K.merge_train(docs.join(known, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_anti"), F.lower("text")).select("doc_id", "origin")


@query("k9_relabel_audit", "SELECT status, final, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'MANUAL' WHEN NOT regexp_matches(text, '\\bthe\\b') THEN 'REVIEW' WHEN lang = 'en' THEN 'ACCEPT' ELSE 'CORRECT' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'checked' WHEN regexp_matches(text, '\\bthe\\b') THEN 'en' END AS final FROM documents) GROUP BY ALL")
def k9(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), F.when(F.col("text").rlike(r"\bthe\b"), "en").alias("rule"), F.when(F.col("doc_id") % 11 == 0, "checked").alias("manual"))
    return K.relabel_audit(rows).groupBy("status", "final").agg(F.count("*").alias("n"))


@query("k9_relabel_summary", """WITH a AS (SELECT ['train', 'validation', 'test'][doc_id % 3 + 1] AS split, lang AS label, CASE WHEN doc_id % 11 = 0 THEN 'MANUAL' WHEN NOT regexp_matches(text, '\\bthe\\b') THEN 'REVIEW' WHEN lang = 'en' THEN 'ACCEPT' ELSE 'CORRECT' END AS status,
CASE WHEN doc_id % 11 = 0 THEN 'checked' WHEN regexp_matches(text, '\\bthe\\b') THEN 'en' ELSE lang END AS final FROM documents)
SELECT 'total' AS part, '' AS key, count(*) AS n FROM a UNION ALL SELECT 'status', status, count(*) FROM a GROUP BY status UNION ALL SELECT 'change', label || ' -> ' || final, count(*) FROM a WHERE status = 'CORRECT' GROUP BY label, final
UNION ALL SELECT 'split', split, count(*) FROM a WHERE status <> 'REVIEW' GROUP BY split UNION ALL SELECT 'class', split || '/' || final, count(*) FROM a WHERE status <> 'REVIEW' GROUP BY split, final UNION ALL SELECT 'changed', '', count(*) FROM a WHERE label <> final HAVING count(*) > 0""")
def k9_summary(spark, d):
    split = F.get(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("doc_id") % 3).cast("int"))
    rows = A.table(spark, d, "documents").select("doc_id", split.alias("split"), F.col("lang").alias("label"), F.when(F.col("text").rlike(r"\bthe\b"), "en").alias("rule"), F.when(F.col("doc_id") % 11 == 0, "checked").alias("manual"))
    return K.relabel_summary(rows)


@query("k10_augment_rare", """WITH r AS (SELECT doc_id, lang || '/' || source AS label, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents), n AS (SELECT label, count(*) AS n FROM r GROUP BY 1 HAVING count(*) < 60),
m AS (SELECT doc_id, label, n, i::INT AS round, array_to_string(list_slice(w, i * 70 + 1, i * 70 + 140), ' ') AS text FROM r JOIN n USING (label), unnest(range(0, 8)) AS u(i) WHERE len(w) > i * 70)
SELECT doc_id, label, round, text FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY round, doc_id) <= 60 - n""")
def k10(spark, d):
    return K.augment_rare(A.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("label"), "text"), 60)


@query("k11_sample_reviews", f"SELECT doc_id FROM labels WHERE quality = 0 OR {_U.format(c='doc_id')} < 0.2")
def k11(spark, d):
    return K.sample_reviews(A.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"))).select("doc_id")


@query("k12_label_summary", f"WITH {SPLIT} SELECT lang, split, count(*) AS n, count(quality) AS labelled FROM split LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def k12(spark, d):
    return _split(spark, d).join(A.table(spark, d, "labels"), "doc_id", "left").groupBy("lang", "split").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


_RUN = """rel AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderkey % 4 AS grade FROM orders WHERE o_orderkey % 4 > 0), run AS (SELECT o_custkey AS case_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {way}, o_orderkey) AS rank FROM orders),
hit AS (SELECT run.case_id, rank AS p, grade FROM run JOIN rel ON run.case_id = rel.case_id AND run.id = rel.id WHERE rank <= 5), ideal AS (SELECT case_id, count(*) AS n, sum(CASE WHEN p <= 5 THEN (pow(2, grade) - 1) / log2(p + 1) ELSE 0 END) AS i FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS p FROM rel) GROUP BY 1),
got AS (SELECT case_id, count(*) AS f, min(p) AS b, sum((pow(2, grade) - 1) / log2(p + 1)) AS g FROM hit GROUP BY 1), metric AS (SELECT case_id, round(coalesce(f, 0) / n, 6) AS recall, round(coalesce(1 / b, 0), 6) AS rr, round(coalesce(g / i, 0), 6) AS ndcg FROM ideal LEFT JOIN got USING (case_id))"""


def _metrics(spark, d, ascending):
    from pyspark.sql import Window

    o = A.table(spark, d, "orders")
    rel = o.filter("o_orderkey % 4 > 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("grade"))
    w = Window.partitionBy("o_custkey").orderBy(F.asc("o_totalprice") if ascending else F.desc("o_totalprice"), "o_orderkey")
    run = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("rank"))
    return K.ranking_metrics(run, rel, 5)


@query("k13_ranking_metrics", f"WITH {_RUN.format(way='DESC')} SELECT * FROM metric")
def k13(spark, d):
    return _metrics(spark, d, False)


@query("k14_k15_paired_deltas", f"WITH a AS (WITH {_RUN.format(way='ASC')} SELECT * FROM metric), b AS (WITH {_RUN.format(way='DESC')} SELECT * FROM metric) SELECT true AS available, round((SELECT avg(rr) FROM b) - (SELECT avg(rr) FROM a), 6) AS delta")
def k14(spark, d):
    return K.paired_deltas(_metrics(spark, d, True), _metrics(spark, d, False))


_PAIR = f"a AS (WITH {_RUN.format(way='ASC')} SELECT * FROM metric), b AS (WITH {_RUN.format(way='DESC')} SELECT * FROM metric)"


@query("k18_compare_retrievers", f"WITH {_PAIR.replace(' <= 5', ' <= 10')}, n AS (SELECT count(*) AS cases FROM a) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT cases FROM n) AS cases, round((SELECT avg({m}) FROM a), 6) AS a, round((SELECT avg({m}) FROM b), 6) AS b, round((SELECT avg({m}) FROM b) - (SELECT avg({m}) FROM a), 6) AS delta" for m in K.METRICS))
def k18(spark, d):
    """Two orders of each customer's orders, by price."""
    cases, relevant, a, b = _runs(spark, d)
    return K.compare_retrievers(cases, relevant, a, b, 10)


@query("k18_run_issues", """WITH rel AS (SELECT o_custkey AS case_id, o_orderkey AS id FROM orders WHERE o_orderkey % 4 > 0), corpus AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 > 0), run AS (SELECT o_custkey AS case_id, o_orderkey AS id FROM orders WHERE o_custkey % 7 > 0)
SELECT DISTINCT NULL::VARCHAR AS run, case_id, 'not_in_corpus' AS issue FROM rel WHERE id NOT IN (SELECT id FROM corpus) UNION ALL SELECT DISTINCT 'a', case_id, 'missing_case' FROM rel WHERE case_id NOT IN (SELECT case_id FROM run) UNION ALL SELECT DISTINCT 'a', case_id, 'unknown_id' FROM run WHERE id NOT IN (SELECT id FROM corpus)
UNION ALL SELECT DISTINCT 'a', case_id, 'unknown_case' FROM run WHERE case_id NOT IN (SELECT case_id FROM rel)""")
def k18_issues(spark, d):
    cases, relevant, a, _ = _runs(spark, d)
    corpus = A.table(spark, d, "orders").filter("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("id"))
    return K.run_issues(cases, relevant, corpus, {"a": a.filter("case_id % 7 > 0")})


def _runs(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("grade"), "o_totalprice")
    relevant = o.filter("grade > 0").select("case_id", "id", "grade")
    by = lambda c: o.select("case_id", "id", F.row_number().over(Window.partitionBy("case_id").orderBy(c, "id")).alias("rank"))
    cases = relevant.select("case_id").distinct().withColumn("query", F.concat(F.lit("q"), F.col("case_id").cast("string")))
    return cases, relevant, by(F.asc("o_totalprice")), by(F.desc("o_totalprice"))


@query("k16_answer_scores", """WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_quantity) FILTER (l_linestatus = 'F')) AS want, list_sort(list(DISTINCT l_quantity) FILTER (l_returnflag <> 'N')) AS got, bool_or(l_returnflag = 'A') AS must, bool_or(l_returnflag = 'R') AS did FROM lineitem GROUP BY 1)
SELECT round(avg((want IS NOT DISTINCT FROM got)::INT), 6) AS numeric_accuracy, round(count(*) FILTER (must AND did) / count(*) FILTER (must), 6) AS rejection_rate FROM s""")
def k16_scores(spark, d):
    l = A.table(spark, d, "lineitem")  # noqa: E741
    s = l.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("want"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("got"), F.bool_or(F.col("l_returnflag") == "A").alias("must"), F.bool_or(F.col("l_returnflag") == "R").alias("did"))
    return K.answer_scores(s)


@query("k17_context_accuracy", """WITH t AS (SELECT o_custkey AS case_id, o_orderkey AS turn, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus, 'x'] ELSE [o_orderstatus] END AS wb, CASE WHEN o_orderkey % 6 = 0 THEN [o_orderstatus] WHEN o_orderkey % 3 = 0 THEN ['x', o_orderstatus] ELSE [o_orderstatus] END AS gb, o_orderpriority AS wp,
CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS gp, o_orderkey % 7 = 0 AS wc, o_orderkey % 14 = 0 AS gc FROM orders), m AS (SELECT list_sort(wb) = list_sort(gb) AS b, wp = gp AS p, wc = gc AS c FROM t)
SELECT round(avg(b::INT), 6) AS banks, round(avg(p::INT), 6) AS product, round(avg((b AND p)::INT), 6) AS all_fields, round(avg(c::INT), 6) AS clarification FROM m""")
def k17(spark, d):
    o, n = A.table(spark, d, "orders"), F.col("o_orderkey")
    own, x = F.col("o_orderstatus"), F.lit("x")
    rows = o.select(
        F.when(n % 3 == 0, F.array(own, x)).otherwise(F.array(own)).alias("want_banks"), F.when(n % 6 == 0, F.array(own)).when(n % 3 == 0, F.array(x, own)).otherwise(F.array(own)).alias("got_banks"),
        F.array("o_orderpriority").alias("want_product"), F.array(F.when(n % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))).alias("got_product"), (n % 7 == 0).alias("want_clarification"), (n % 14 == 0).alias("got_clarification"),
    )
    return K.context_accuracy(rows, ("banks", "product"))


@query("k16_citation_accuracy", "WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS act, list(DISTINCT CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS req FROM lineitem GROUP BY 1) SELECT k, list_has_all(act, list_filter(req, lambda x: x IS NOT NULL)) AND list_has_all(['A', 'R'], act) AS ok FROM s")
def k16(spark, d):
    s = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("act"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("req"))
    return s.select("k", K.citation_accuracy(F.col("req"), F.col("act"), F.array(F.lit("A"), F.lit("R"))).alias("ok"))


@query("k19_classification_report", """WITH p AS (SELECT lang AS gold, CASE WHEN regexp_matches(text, '\\bthe\\b') THEN 'en' WHEN regexp_matches(text, '\\bder\\b') THEN 'de' ELSE 'fr' END AS pred FROM documents), l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p),
r AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label) AS support, (SELECT count(*) FROM p WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM p WHERE pred = label) AS predicted FROM l), q AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS a, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS b FROM r)
SELECT label, support, round(a, 6) AS precision, round(b, 6) AS recall, round(f, 6) AS f1 FROM (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS f FROM q)
UNION ALL SELECT k, sum(support)::BIGINT, CASE k WHEN 'accuracy' THEN round(sum(tp) / sum(support), 6) WHEN 'macro' THEN round(avg(a), 6) ELSE round(sum(a * support) / sum(support), 6) END,
CASE k WHEN 'accuracy' THEN round(sum(tp) / sum(support), 6) WHEN 'macro' THEN round(avg(b), 6) ELSE round(sum(b * support) / sum(support), 6) END,
CASE k WHEN 'accuracy' THEN round(sum(tp) / sum(support), 6) WHEN 'macro' THEN round(avg(f), 6) ELSE round(sum(f * support) / sum(support), 6) END
FROM (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS f FROM q), (SELECT unnest(['accuracy', 'macro', 'weighted']) AS k) GROUP BY k""")
def k19(spark, d):
    t = F.col("text")
    return K.classification_report(A.table(spark, d, "documents").select(F.col("lang").alias("gold"), F.when(t.rlike(r"\bthe\b"), "en").when(t.rlike(r"\bder\b"), "de").otherwise("fr").alias("pred")))


@query("k20_span_f1", "WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'F'), p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag <> 'N'), t AS (SELECT count(*) AS t FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) SELECT round(t / (SELECT count(*) FROM p), 6) AS precision, round(t / (SELECT count(*) FROM g), 6) AS recall, round(2 * t / ((SELECT count(*) FROM p) + (SELECT count(*) FROM g)), 6) AS f1 FROM t")
def k20(spark, d):
    s = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.col("l_quantity").alias("end"), F.col("l_returnflag").alias("label"), "l_linestatus")
    return K.span_f1(s.filter("label <> 'N'"), s.filter("l_linestatus = 'F'"))


@query("k21_ab_gate", "WITH m AS (SELECT lang AS name, avg(n_chars) FILTER (doc_id % 2 = 0) AS b, avg(n_chars) FILTER (doc_id % 2 = 1) AS c FROM documents GROUP BY 1) SELECT bool_and(c - b >= -0.005) AS passed, round(min(c - b), 6) AS worst FROM m")
def k21(spark, d):
    m = A.table(spark, d, "documents").groupBy((F.col("doc_id") % 2).alias("side"), F.col("lang").alias("name")).agg(F.avg("n_chars").alias("value"))
    return K.ab_gate(m.filter("side = 0"), m.filter("side = 1"))


@query("k22_q6_check_constraints", "SELECT o_orderkey, 'price_range' AS rule FROM orders WHERE NOT (o_totalprice BETWEEN 1000 AND 400000) UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority LIKE '5%'")
def k22(spark, d):
    rules = {"price_range": F.col("o_totalprice").between(1000, 400000), "status": F.col("o_orderstatus").isin("O", "F"), "priority": ~F.col("o_orderpriority").startswith("5")}
    return K.check_constraints(A.table(spark, d, "orders"), rules, "o_orderkey")


@query("q7_check_keys_refs", "SELECT 'key' AS kind, l_orderkey AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'ref', o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def q7(spark, d):
    keys = K.check_keys(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("key").alias("kind"), F.col("l_orderkey").alias("id"))
    refs = K.check_refs(A.table(spark, d, "orders"), "o_custkey", A.table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")
    return keys.unionByName(refs.select(F.lit("ref").alias("kind"), F.col("o_custkey").alias("id")))


@query("q8_check_embeddings", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR label = 3")
def q8(spark, d):
    e = A.table(spark, d, "embeddings")
    return K.check_embeddings(e.withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))), "vec_id", "embedding", 64)


@query("j11_refresh_live", """WITH l AS (SELECT o_orderkey AS doc_id, o_orderpriority AS new_label, o_orderstatus = 'P' AS by_review FROM orders), s AS (SELECT doc_id, 'd' || doc_id % 3 AS digest, new_label FROM l WHERE NOT by_review AND doc_id % 4 > 0),
c AS (SELECT l_orderkey AS doc_id, count(*) FILTER (l_linestatus = 'F') AS accepted, count(*) FILTER (l_linestatus = 'O') AS review FROM lineitem JOIN s ON l_orderkey = s.doc_id WHERE new_label LIKE '1%' AND l_returnflag = 'A' OR new_label LIKE '2%' AND l_returnflag IN ('A', 'N') GROUP BY 1)
SELECT doc_id, digest, 'v2' AS version, coalesce(accepted, 0) AS accepted, coalesce(review, 0) AS review, 0::BIGINT AS rejected FROM s LEFT JOIN c USING (doc_id)
UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'old' ELSE 'd' || doc_id % 3 END, CASE WHEN doc_id % 4 = 2 THEN 'v1' ELSE 'v2' END, 7, 7, 7 FROM l WHERE doc_id % 4 < 3 AND doc_id NOT IN (SELECT doc_id FROM s)""")
def j11(spark, d):
    o = A.table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id").withColumn("digest", F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")))
    rest = F.col("doc_id") % 4
    state = o.filter(rest < 3).select("doc_id", F.when(rest == 1, "old").otherwise(F.col("digest")).alias("digest"), F.when(rest == 2, "v1").otherwise("v2").alias("version"), *(F.lit(7).cast("long").alias(c) for c in ("accepted", "review", "rejected")))
    docs = o.select("doc_id", "digest", F.lit("old").alias("label"), (F.col("o_custkey") % 2 == 0).alias("verified"))
    classified = o.select("doc_id", F.col("o_orderpriority").alias("new_label"), (F.col("o_orderstatus") == "P").alias("by_review"))
    pairs = F.when(F.col("new_label").startswith("1"), F.array(F.lit("A"))).when(F.col("new_label").startswith("2"), F.array(F.lit("A"), F.lit("N")))
    eligible = classified.select("new_label").distinct().select("new_label", F.explode(pairs).alias("entity"))
    decision = F.when(F.col("l_linestatus") == "F", "accepted").otherwise("review")
    candidates = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("entity"), decision.alias("decision"))
    return J.refresh_live(docs, state, classified, eligible, candidates, "v2")[2]


@query("k6_silver_bio_rows")
def k6(spark, d):
    from offerscope.plans.facts import _found

    return K.silver_bio_rows(_found(spark, d).select("doc_id", "evidence", "fact_text", F.col("fact_type").alias("label")))
