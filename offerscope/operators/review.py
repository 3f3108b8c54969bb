"""Review queues and merges without a table format: joins and unions that replace keyed rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "approved", "rejected")


def queue_counts(queue: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status; each status is always there."""
    names = queue.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = queue.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def list_reviews(queue: DataFrame, status: str, n: int) -> DataFrame:
    """The oldest n reviews of a status."""
    return queue.filter(F.col("status") == status).orderBy("created", "review_id").limit(n)


def queue_documents(incoming: DataFrame, docs: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue after incoming candidates (record_key, digest, note).

    A new row remembers whether a document with its key existed and that document's digest; a pending row gets the new
    note and keeps what it remembers; a decided row stays and says so in `error`.
    """
    base = docs.select("record_key", F.col("digest").alias("base_digest")).dropDuplicates(["record_key"])
    both = incoming.join(base, "record_key", "left").select("record_key", "digest", F.col("note").alias("new_note"), "base_digest", F.lit(True).alias("came"))
    rows = queue.select("record_key", "digest", "note", "status", F.col("base_digest").alias("old_base"), F.lit(True).alias("there")).join(both, ["record_key", "digest"], "full")
    pending = F.col("status") == "pending"
    return rows.select(
        "record_key", "digest",
        F.when(F.col("there").isNull() | (pending & F.col("came").isNotNull()), F.col("new_note")).otherwise(F.col("note")).alias("note"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(F.col("there").isNull(), F.col("base_digest")).otherwise(F.col("old_base")).alias("base_digest"),
        F.when(F.col("there").isNotNull() & F.col("came").isNotNull() & ~pending, "already decided").alias("error"),
    )


def baseline_conflicts(reviews: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_key, ok): the current digest is the candidate's, or existence and digest are as remembered; unknown existence is refused."""
    now = docs.select("record_key", F.col("digest").alias("now")).dropDuplicates(["record_key"])
    rows = reviews.join(now, "record_key", "left")
    same = F.col("base_exists").isNotNull() & (F.col("base_exists") == F.col("now").isNotNull()) & F.col("base_digest").eqNullSafe(F.col("now"))
    return rows.select("record_key", "digest", (F.coalesce(F.col("now") == F.col("digest"), F.lit(False)) | same).alias("ok"))


def apply_fact_decisions(queue: DataFrame, decisions: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, queue) after decisions (fact_id, decision) on pending rows; approved ones become facts with the method human_review."""
    one = decisions.filter(F.col("decision").isin("approve", "reject")).groupBy("fact_id").agg(F.max("decision").alias("decision"))
    rows = queue.join(one, "fact_id", "left")
    live = (F.col("status") == "pending") & F.col("decision").isNotNull()
    after = rows.withColumn("status", F.when(live & (F.col("decision") == "approve"), "approved").when(live, "rejected").otherwise(F.col("status")))
    approved = rows.filter(live & (F.col("decision") == "approve")).select("fact_id", "doc_id", "fact_type", F.lit("human_review").alias("method"))
    kept = facts.select("fact_id", "doc_id", "fact_type", "method").join(approved.select("fact_id"), "fact_id", "left_anti")
    return kept.unionByName(approved), after.drop("decision")


def write_candidates(facts: DataFrame, queue: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, queue): a document's accepted candidates replace its stored facts of the same method, its candidates for review replace the queue's
    pending rows of the method; resolved rows stay, and a candidate whose fact_key is resolved isn't queued again.

    facts and candidates have doc_id, method, fact_key and more; candidates also decision; queue also status.
    """
    touched = candidates.select("doc_id", "method").distinct()
    stored = facts.join(touched, ["doc_id", "method"], "left_anti").select(facts.columns).unionByName(candidates.filter("decision = 'accepted'").select(facts.columns))
    resolved = queue.filter("status <> 'pending'")
    waiting = queue.filter("status = 'pending'").join(touched, ["doc_id", "method"], "left_anti").select(queue.columns)
    fresh = candidates.filter("decision = 'review'").join(resolved.select("doc_id", "method", "fact_key").distinct(), ["doc_id", "method", "fact_key"], "left_anti")
    return stored, resolved.select(queue.columns).unionByName(waiting).unionByName(fresh.withColumn("status", F.lit("pending")).select(queue.columns))


def upsert_frozen(old: DataFrame, new: DataFrame, key: str, columns: list[str], frozen: list[str], verified: str) -> DataFrame:
    """Last write wins, except for the frozen columns of verified rows; one full join by key."""
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("came"))
    rows = old.select(key, *columns, verified).join(n, key, "full")

    def merged(c: str) -> Column:
        keep = F.col("came").isNull() | (F.coalesce(F.col(verified), F.lit(False)) if c in frozen else F.lit(False))
        return F.when(keep, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)

    return rows.select(key, *(merged(c) for c in columns), F.coalesce(verified, F.lit(False)).alias(verified))


def apply_review_sheet(rows: DataFrame, sheet: DataFrame) -> DataFrame:
    """Reviewer's answers (key, answer E or H, new_label): E approves, H rejects, a corrected label approves; no answer changes nothing."""
    s = sheet.select("key", F.upper(F.trim("answer")).alias("a"), F.nullif(F.trim("new_label"), F.lit("")).alias("nl")).dropDuplicates(["key"])
    out = rows.join(s, "key", "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & (F.col("nl").isNotNull() | (F.col("a") == "E")), "approved").when(pending & (F.col("a") == "H"), "rejected").otherwise(F.col("status"))
    return out.select("key", F.when(pending & F.col("nl").isNotNull(), F.col("nl")).otherwise(F.col("label")).alias("label"), status.alias("status"))


def replace_snapshot_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document and version: facts that wait or need no review go, decided ones stay; a new fact with the key of a decided one is dropped."""
    touched = new.select("doc_id", "version").distinct()
    decided = F.col("review").isin("approved", "rejected")
    kept = old.filter(decided).unionByName(old.filter(~decided).join(touched, ["doc_id", "version"], "left_anti").select(old.columns))
    fresh = new.withColumn("review", F.when(F.col("decision") == "review", "pending").otherwise("not_required"))
    both = kept.withColumn("age", F.when(decided, 0).otherwise(2)).unionByName(fresh.select(old.columns).withColumn("age", F.lit(1)))
    w = Window.partitionBy("fact_key").orderBy("age", "doc_id", "decision")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "age")


def import_upsert(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of touched keys are replaced by the new rows: spans of a passage, samples of a dataset version, or single rows by their own key.

    A touched key without new rows loses its old ones; null keys match nothing, so such rows stay.
    """
    return old.join(touched.select(keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def refresh_live(docs: DataFrame, state: DataFrame, classified: DataFrame, eligible: DataFrame, candidates: DataFrame, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, candidates to write, state) after a run over live documents.

    docs (doc_id, digest, label, verified), state (doc_id, digest, version, accepted, review, rejected), classified (doc_id, new_label, by_review),
    eligible (new_label, entity), candidates (doc_id, entity, decision and others). Documents with the same digest and version are skipped; those whose
    classification needs a review, or that have none, are left as they are; of a label without entities no candidates are taken,
    but the document is saved with zero facts. Verified documents keep their label.
    """
    unchanged = state.filter(F.col("version") == version).select("doc_id", "digest")
    due = docs.join(unchanged, ["doc_id", "digest"], "left_anti").join(classified.filter(~F.coalesce("by_review", F.lit(True))).select("doc_id", "new_label"), "doc_id")
    saved = due.select("doc_id", "digest", "new_label")
    allowed = saved.select("doc_id", "new_label").join(eligible.select("new_label", "entity").distinct(), "new_label").select("doc_id", "entity")
    taken = candidates.join(allowed, ["doc_id", "entity"], "left_semi")
    relabelled = docs.join(saved.select("doc_id", "new_label"), "doc_id", "left")
    after = relabelled.withColumn("label", F.when(F.col("verified") | F.col("new_label").isNull(), F.col("label")).otherwise(F.col("new_label"))).select(docs.columns)
    count = taken.groupBy("doc_id").agg(*(F.count_if(F.col("decision") == d).alias(n) for d, n in (("accepted", "accepted"), ("review", "review"), ("rejected", "rejected"))))
    fresh = saved.join(count, "doc_id", "left").select("doc_id", "digest", F.lit(version).alias("version"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "review", "rejected")))
    return after, taken, import_upsert(state.select(fresh.columns), fresh, saved, ["doc_id"])
