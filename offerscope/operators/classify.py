"""Classification: ordered rules, label merging, arbitration, status, weights, a trained text classifier."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(surface: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(label, reason) of the first of the ordered (pattern, label, reason) rules that matches; null if none does."""
    made = [F.when(surface.rlike(p), F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))) for p, label, reason in rules]
    return F.coalesce(*made)


def merge_label_aliases(scores: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Scores of alias labels summed, rounded to four places and ranked anew."""
    name = reduce(lambda acc, kv: F.when(F.col("label") == kv[0], kv[1]).otherwise(acc), aliases.items(), F.col("label"))
    merged = scores.groupBy("doc_id", name.alias("label")).agg(F.round(F.sum("score"), 4).alias("score"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label")))


def resolve_label(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Arbitration of url, title, advisory and model labels (columns url, title, url_advisory, body_advisory, model, score).

    The first of url, title and the advisories is the metadata label. With it: agreement is accepted;
    a conflict with a firm label is accepted by metadata unless the model reaches max(threshold, .95),
    which puts it to review; a body conflict yields to such a model. Without it the model must reach the threshold.
    """
    firm = F.coalesce("url", "title")
    meta = F.coalesce(firm, F.col("url_advisory"), F.col("body_advisory"))
    sure, agree = F.col("score") >= max(threshold, 0.95), F.col("model") == meta
    decision = (
        F.when(meta.isNull() & (F.col("score") >= threshold), "ACCEPTED")
        .when(meta.isNull(), "REVIEW")
        .when(F.coalesce(agree, F.lit(False)), "ACCEPTED")
        .when(firm.isNotNull() & ~F.coalesce(sure, F.lit(False)), "ACCEPTED")
        .when(firm.isNull() & F.coalesce(sure, F.lit(False)), "ACCEPTED")
        .otherwise("REVIEW")
    )
    basis = F.when(meta.isNull(), "model").when(F.coalesce(agree, F.lit(False)), "agreement").when(firm.isNotNull(), "metadata").otherwise("model")
    label = F.when(meta.isNull(), F.col("model")).when(firm.isNotNull(), firm).when(F.coalesce(sure, F.lit(False)), F.col("model")).otherwise(meta)
    reasons = F.array_compact(F.array(F.when(meta.isNull(), "no_metadata"), F.when(meta.isNotNull() & ~F.coalesce(agree, F.lit(False)), "conflict"), F.when(~F.coalesce(F.col("score") >= threshold, F.lit(False)), "low_score")))
    return rows.select("doc_id", label.alias("label"), decision.alias("decision"), basis.alias("basis"), F.array_join(reasons, ",").alias("reasons"))


def classification_status(verified: Column, decision: Column, conflict: Column, confidence: Column, accept: float = 0.8, review: float = 0.65) -> Column:
    """verified, required, review or accepted, in this order of precedence."""
    return (
        F.when(verified, "verified").when(decision == "FAILED", "required").when(F.coalesce(confidence < review, F.lit(True)), "required").when((decision == "REVIEW") | conflict, "review").when(confidence >= accept, "accepted").otherwise("review")
    )


def diagnose(rows: DataFrame, k: int = 5) -> DataFrame:
    """Counts of (decision, basis, reason) with the ids of at most k samples each."""
    one = rows.select("doc_id", "decision", "basis", F.explode(F.split(F.when(F.col("reasons") == "", "none").otherwise(F.col("reasons")), ",")).alias("reason"))
    w = Window.partitionBy("decision", "basis", "reason").orderBy("doc_id")
    counts = one.groupBy("decision", "basis", "reason").agg(F.count("*").alias("n"))
    samples = one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).groupBy("decision", "basis", "reason").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))
    return counts.join(samples, ["decision", "basis", "reason"])


def class_weights(rows: DataFrame, label: str, low: float = 0.35, high: float = 5.0) -> DataFrame:
    """sqrt(N / n_c) over the mean of these, clipped."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    raw = n.crossJoin(F.broadcast(total)).select(label, "n", F.sqrt(F.col("total") / F.col("n")).alias("raw"))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select(label, "n", F.round(F.least(F.greatest(F.col("raw") / F.col("mean"), F.lit(low)), F.lit(high)), 6).alias("weight"))


def train_text_classifier(rows: DataFrame, label: str, text: str = "text", features: int = 1 << 12):
    """Class-weighted logistic regression on hashed TF-IDF; gives the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    weighted = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).join(class_weights(rows, label).select(label, "weight"), label)
    steps = [
        StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="words", pattern="\\s+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=10, regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(weighted)


def score_classifier(model, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, score, place) of all labels, ranked."""
    from pyspark.ml.functions import vector_to_array

    rows = rows.select(key, F.coalesce(text, F.lit("")).alias(text))
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    names = F.array(*map(F.lit, model.stages[0].labels))
    scores = F.arrays_zip(names.alias("label"), vector_to_array("probability").alias("score"))
    out = rows.select(key, F.explode(scores).alias("s")).select(key, "s.label", "s.score")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label")))
