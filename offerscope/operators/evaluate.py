"""Training sets without leaks, and evaluation of retrieval and classification."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leak_free_split(rows: DataFrame, cluster: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds `split` by a hash of the cluster, so whole clusters move together and repartitioning changes nothing."""
    u = F.conv(F.substring(F.md5(F.col(cluster).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def leak_audit(rows: DataFrame, key: str) -> DataFrame:
    """(left, right, shared): keys found in two splits, by pair of splits."""
    seen = rows.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
    pairs = F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))
    return seen.select(F.explode(pairs).alias("p")).groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("shared"))


def protect_groups(candidates: DataFrame, protected: DataFrame, group: str) -> DataFrame:
    """Candidates whose group isn't in the protected rows."""
    return candidates.join(protected.select(group).distinct(), group, "left_anti")


def hard_negatives(sentences: DataFrame, positives: DataFrame, ratio: float) -> DataFrame:
    """Sentences with a digit that aren't positive, by digest; round(ratio * positives) of them.

    The digests' first four digits are counted (65,536 rows at most); those below the one in which the number is reached are
    taken whole, and only within that one are sentences put in order.
    """
    n = int(round(ratio * positives.count()))
    rows = sentences.filter(F.length("sentence").between(40, 420) & F.col("sentence").rlike("[0-9]")).join(positives.select("sentence").distinct(), "sentence", "left_anti")
    rows = rows.select("sentence").distinct().withColumn("digest", F.sha2("sentence", 256)).withColumn("head", F.substring("digest", 1, 4))
    before, last = 0, ""
    for r in rows.groupBy("head").count().orderBy("head").collect():
        if before + r["count"] > n:
            last = r["head"]
            break
        before += r["count"]
    else:
        return rows.drop("head")
    rest = rows.filter(F.col("head") == last).orderBy("digest").limit(n - before)
    return rows.filter(F.col("head") < last).unionByName(rest).drop("head")


def merge_train(base: DataFrame, extra: DataFrame, text: Column) -> DataFrame:
    """Base rows and the extra rows whose text isn't among them, one of equal extra texts."""
    b, e = base.withColumn("norm", text), extra.withColumn("norm", text)
    first = e.groupBy("norm").agg(F.min("doc_id").alias("doc_id"))
    new = e.join(first, ["norm", "doc_id"], "left_semi").join(b.select("norm").distinct(), "norm", "left_anti")
    return b.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("extra")))


def relabel_audit(rows: DataFrame) -> DataFrame:
    """(doc_id, status, final) by precedence manual, rule (columns label, rule, manual)."""
    status = F.when(F.col("manual").isNotNull(), "MANUAL").when(F.col("rule").isNull(), "REVIEW").when(F.col("rule") == F.col("label"), "ACCEPT").otherwise("CORRECT")
    return rows.select("doc_id", status.alias("status"), F.coalesce("manual", "rule").alias("final"))


def relabel_summary(rows: DataFrame) -> DataFrame:
    """(part, key, n) over rows (doc_id, split, label, rule, manual): all rows, by status, corrected labels as "old -> new", rows kept of each
    split (those not in review), kept labels of each split as "split/label", and rows whose label changed. One pass; a row gives at most six counts. Null labels are written as null.
    """
    status = F.when(F.col("manual").isNotNull(), "MANUAL").when(F.col("rule").isNull(), "REVIEW").when(F.col("rule") == F.col("label"), "ACCEPT").otherwise("CORRECT")
    final = F.when(status == "REVIEW", F.col("label")).otherwise(F.coalesce("manual", "rule"))
    said = lambda c: F.coalesce(c, F.lit("null"))
    part = lambda name, key, when=None: F.struct(F.lit(name).alias("part"), key.alias("key")) if when is None else F.when(when, F.struct(F.lit(name).alias("part"), key.alias("key")))
    kept = F.col("status") != "REVIEW"
    counts = F.array_compact(
        F.array(
            part("total", F.lit("")), part("status", F.col("status")), part("change", F.concat(said(F.col("label")), F.lit(" -> "), said(F.col("final"))), F.col("status") == "CORRECT"), part("split", said(F.col("split")), kept),
            part("class", F.concat(said(F.col("split")), F.lit("/"), said(F.col("final"))), kept), part("changed", F.lit(""), ~F.col("label").eqNullSafe(F.col("final"))),
        )
    )
    return rows.select("split", "label", status.alias("status"), final.alias("final")).select(F.explode(counts).alias("c")).groupBy("c.part", "c.key").agg(F.count("*").alias("n"))


def augment_rare(rows: DataFrame, target: int, window: int = 140, stride: int = 70, rounds: int = 8) -> DataFrame:
    """Word windows of documents of classes with fewer than `target` rows, by round and id, as many as are missing."""
    n = rows.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < target)
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")
    made = rows.join(n, "label").select("doc_id", "label", "n", words.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    made = made.filter(F.size("w") > F.col("round") * stride).select("doc_id", "label", "n", "round", F.array_join(F.slice("w", F.col("round") * stride + 1, F.lit(window)), " ").alias("text"))
    w = Window.partitionBy("label").orderBy("round", "doc_id")
    return made.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.lit(target) - F.col("n")).select("doc_id", "label", "round", "text")


def sample_reviews(labels: DataFrame, share: float = 0.2) -> DataFrame:
    """All rows of low confidence and a hashed share of the others."""
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return labels.filter((F.col("confidence") < 0.5) | (u < share))


def ranking_metrics(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per case recall, reciprocal rank and nDCG at k; ranked ids count once, at their first place (graded gain 2^g - 1)."""
    first = run.groupBy("case_id", "id").agg(F.min("rank").alias("rank"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "id"))).filter(F.col("place") <= k)
    hits = ranked.join(relevant, ["case_id", "id"])
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1.0)
    ideal = relevant.withColumn("p", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "id"))).groupBy("case_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("p") <= k, gain(F.col("grade"), F.col("p"))).otherwise(0.0)).alias("ideal"))
    got = hits.groupBy("case_id").agg(F.count("*").alias("found"), F.min("place").alias("best"), F.sum(gain(F.col("grade"), F.col("place"))).alias("dcg"))
    out = ideal.join(got, "case_id", "left")
    return out.select("case_id", F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"))


def paired_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean metrics of two systems and their difference; unavailable unless both have every case."""
    rows = a.select("case_id", F.col("rr").alias("a")).join(b.select("case_id", F.col("rr").alias("b")), "case_id", "full")
    out = rows.agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("available"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return out.select("available", F.when(F.col("available"), F.round(F.col("b") - F.col("a"), 6)).alias("delta"))


def run_issues(cases: DataFrame, relevant: DataFrame, corpus: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """(run, case_id, issue) of what forbids a comparison; the run is null where the cases themselves are at fault.

    Cases (case_id, query): duplicate_case, empty_query, no_relevant. Relevant (case_id, id, grade): bad_grade, duplicate_relevant, not_in_corpus
    (column id). Runs (case_id, id, rank): missing_case, unknown_case, unknown_id.
    """
    row = lambda df, issue, run=None: df.select(F.lit(run).cast("string").alias("run"), "case_id", F.lit(issue).alias("issue")).distinct()
    known, ids = cases.select("case_id").distinct(), corpus.select("id").distinct()
    found = [
        row(cases.groupBy("case_id").count().filter("count > 1"), "duplicate_case"), row(cases.filter(F.coalesce(F.trim("query"), F.lit("")) == ""), "empty_query"), row(known.join(relevant, "case_id", "left_anti"), "no_relevant"),
        row(relevant.filter(~F.coalesce(F.col("grade") > 0, F.lit(False))), "bad_grade"), row(relevant.groupBy("case_id", "id").count().filter("count > 1"), "duplicate_relevant"), row(relevant.join(ids, "id", "left_anti"), "not_in_corpus"),
    ]
    for name, run in runs.items():
        found += [row(known.join(run, "case_id", "left_anti"), "missing_case", name), row(run.join(known, "case_id", "left_anti"), "unknown_case", name), row(run.join(ids, "id", "left_anti"), "unknown_id", name)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def compare_retrievers(cases: DataFrame, relevant: DataFrame, a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(metric, cases, a, b, delta) of two runs over the same cases; k is 10 at least. Means and delta are null unless both runs answer every case."""
    if k < 10:
        raise ValueError("k must be at least 10")
    known = cases.select("case_id").distinct()
    means = lambda run, name: ranking_metrics(run.join(known, "case_id", "left_semi"), relevant.join(known, "case_id", "left_semi"), k).agg(*(F.avg(m).alias(f"{m}_{name}") for m in METRICS))
    answered = lambda run, name: run.join(known, "case_id", "left_semi").agg(F.countDistinct("case_id").alias(f"n_{name}"))
    one = known.agg(F.count("*").alias("cases"))
    for part in (means(a, "a"), means(b, "b"), answered(a, "a"), answered(b, "b")):
        one = one.crossJoin(part)  # single rows
    whole = (F.col("n_a") == F.col("cases")) & (F.col("n_b") == F.col("cases"))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.when(whole, F.col(f"{m}_a")).alias("a"), F.when(whole, F.col(f"{m}_b")).alias("b")) for m in METRICS)))
    return one.select("cases", rows.alias("r")).select("r.metric", "cases", F.round("r.a", 6).alias("a"), F.round("r.b", 6).alias("b"), F.round(F.col("r.b") - F.col("r.a"), 6).alias("delta"))


METRICS = ("recall", "rr", "ndcg")


def citation_accuracy(required: Column, actual: Column, allowed: Column) -> Column:
    """All required sources are cited, and nothing but allowed ones."""
    return (F.size(F.array_except(required, actual)) == 0) & (F.size(F.array_except(actual, allowed)) == 0)


def answer_scores(cases: DataFrame) -> DataFrame:
    """numeric_accuracy: cases whose set of numbers is the expected one; rejection_rate: of the cases to be rejected (must) those that were (did); null without any."""
    same = F.array_sort("want").eqNullSafe(F.array_sort("got"))
    return cases.agg(F.round(F.avg(same.cast("int")), 6).alias("numeric_accuracy"), F.round(F.count_if(F.col("must") & F.col("did")) / F.nullif(F.count_if("must"), F.lit(0)), 6).alias("rejection_rate"))


def context_accuracy(turns: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Shares of turns whose inherited fields (arrays want_x and got_x, compared as sorted lists) are as expected, each and all together, and whose clarification is."""
    same = {f: F.array_sort(f"want_{f}").eqNullSafe(F.array_sort(f"got_{f}")) for f in fields}
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    both = F.lit(True)
    for c in same.values():
        both = both & c
    return turns.agg(*(share(c).alias(f) for f, c in same.items()), share(both).alias("all_fields"), share(F.col("want_clarification") == F.col("got_clarification")).alias("clarification"))


def classification_report(pred: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of each label, then of `accuracy`, `macro` (plain mean) and `weighted` (by support); 0 where a divisor is 0."""
    c = pred.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    tp = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    gold = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    said = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = gold.join(said, "label", "full").na.fill(0)
    p, r = (F.when(F.col(x) > 0, F.col("tp") / F.col(x)).otherwise(0.0) for x in ("predicted", "support"))
    rows = rows.select("label", "support", "tp", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    scores = ("precision", "recall", "f1")
    every = F.sum("support").alias("support")
    totals = [
        rows.agg(every, *((F.sum("tp") / F.sum("support")).alias(x) for x in scores)).withColumn("label", F.lit("accuracy")), rows.agg(every, *(F.avg(x).alias(x) for x in scores)).withColumn("label", F.lit("macro")),
        rows.agg(every, *((F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in scores)).withColumn("label", F.lit("weighted")),
    ]
    out = rows.drop("tp")
    for t in totals:
        out = out.unionByName(t)
    return out.select("label", "support", *(F.round(x, 6).alias(x) for x in scores))


def span_f1(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Strict precision, recall and F1 of spans (doc_id, start, end, label)."""
    key = ["doc_id", "start", "end", "label"]
    p, g = pred.select(key).distinct(), gold.select(key).distinct()
    n = p.agg(F.count("*").alias("p")).crossJoin(g.agg(F.count("*").alias("g"))).crossJoin(p.join(g, key, "left_semi").agg(F.count("*").alias("t")))
    return n.select(F.round(F.col("t") / F.col("p"), 6).alias("precision"), F.round(F.col("t") / F.col("g"), 6).alias("recall"), F.round(2 * F.col("t") / (F.col("p") + F.col("g")), 6).alias("f1"))


def ab_gate(base: DataFrame, candidate: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Passes if no metric (name, value) falls by more than the tolerance."""
    rows = base.select("name", F.col("value").alias("b")).join(candidate.select("name", F.col("value").alias("c")), "name")
    return rows.agg(F.bool_and(F.col("c") - F.col("b") >= -tolerance).alias("passed"), F.round(F.min(F.col("c") - F.col("b")), 6).alias("worst"))


def check_constraints(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) of each violated rule; a rule that is null counts as kept."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def check_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_refs(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference isn't there; null refers to nothing."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def check_embeddings(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows whose vector has another dimension or a value that isn't finite."""
    bad = F.exists(vector, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return rows.filter(F.col(vector).isNull() | (F.size(vector) != size) | bad).select(key)


#: Tokens of the training rows: words with inner numbers and paths, or single marks.
TOKEN = re.compile(r"\w+(?:[.,/]\w+)*|[^\w\s]")


def bio_tags(evidence: str, facts: list[tuple[str, str]]) -> tuple[list[str], list[str]] | None:
    """Tokens and their tags for facts (text, label): the longest first, later ones only where they overlap none; None if all are O."""
    spans: list[tuple[int, int, str]] = []
    for text, label in sorted(facts, key=lambda f: -len(f[0])):
        a = evidence.find(text) if text else -1
        if a >= 0 and all(a + len(text) <= b or e <= a for b, e, _ in spans):
            spans.append((a, a + len(text), label))
    spans.sort()
    tokens, tags, at = [], [], 0
    for m in TOKEN.finditer(evidence):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        inside = at < len(spans) and spans[at][0] < m.end()
        first = inside and not any(t.end() > spans[at][0] for t in tokens[-1:])
        tokens.append(m)
        tags.append(("B-" if first else "I-") + spans[at][2] if inside else "O")
    return ([m[0] for m in tokens], tags) if set(tags) - {"O"} else None


def silver_bio_rows(facts: DataFrame) -> DataFrame:
    """(doc_id, evidence, tokens, tags) of facts (doc_id, evidence, fact_text, label); rows without a tag are left out.

    Facts are distinct and a document has few (they are capped when extracted), so a group is short. Facts of equal length go by
    text and label. Null evidence or fact text gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tagged = [bio_tags(e, [(f["fact_text"], f["label"]) for f in fs]) for e, fs in zip(batch["evidence"], batch["facts"], strict=True)]
            keep = [t is not None for t in tagged]
            rows = [t for t in tagged if t]
            yield batch.loc[keep, ["doc_id", "evidence"]].assign(tokens=[a for a, _ in rows], tags=[b for _, b in rows])

    said = facts.filter("evidence is not null and fact_text is not null and label is not null")
    groups = said.groupBy("doc_id", "evidence").agg(F.array_sort(F.collect_set(F.struct("fact_text", "label"))).alias("facts"))
    return groups.mapInPandas(run, "doc_id long, evidence string, tokens array<string>, tags array<string>")
