"""Analytics over pages and facts: comparison, catalogue, dashboards, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def available_facts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Labelled entities and generated facts in one table with their provenance."""
    own = lambda df, source: df.select("doc_id", "fact_type", "fact_text", "value", "n", F.lit(source).alias("provenance"))
    return own(entities, "entity").unionByName(own(facts, "generated"))


def comparison_matrix(docs: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Per product: best pages of each bank in turn (first of each bank, then second) up to `limit`, with their facts.

    Two windows, by (product, bank) and by product over at most `limit` pages of a bank.
    """
    best = Window.partitionBy("product", "bank").orderBy(F.col("confidence").desc_nulls_last(), "doc_id")
    ranked = docs.select("doc_id", "bank", "product", "confidence").withColumn("bank_rank", F.row_number().over(best)).filter(F.col("bank_rank") <= limit)
    turn = Window.partitionBy("product").orderBy("bank_rank", "bank", "doc_id")
    chosen = ranked.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= limit)
    return chosen.join(facts, "doc_id", "left")


def dedup_attributes(rows: DataFrame) -> DataFrame:
    """First fact for each (document, type, text), text compared without case and outer space."""
    first = Window.partitionBy("doc_id", "fact_type", F.lower(F.trim("fact_text"))).orderBy("n", "value")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def attribute_map(rows: DataFrame) -> DataFrame:
    """Each document's facts as one row for each type with its values in order."""
    return rows.filter("fact_type is not null").groupBy("doc_id", "fact_type").agg(F.array_sort(F.collect_list(F.struct("n", "fact_text"))).alias("v")).select("doc_id", "fact_type", F.array_join(F.transform("v", lambda x: x.fact_text), ";").alias("texts"))


def bank_columns(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each bank: pages, best page by confidence, fact types it covers, facts."""
    pages = docs.groupBy("bank").agg(F.count("*").alias("pages"), F.max_by("doc_id", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("doc_id"))).alias("best_doc"))
    own = docs.select("doc_id", "bank").join(facts, "doc_id").groupBy("bank").agg(F.count("*").alias("n_facts"), F.array_join(F.array_sort(F.collect_set("fact_type")), ",").alias("fact_types"))
    return pages.join(own, "bank", "left").select("bank", "pages", "best_doc", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("fact_types", F.lit("")).alias("fact_types"))


def visible_fact_types(docs: DataFrame, facts: DataFrame, first: list[str], limit: int = 12) -> DataFrame:
    """Fact types by profile order, then by the number of banks that have them."""
    cover = docs.select("doc_id", "bank").join(facts, "doc_id").groupBy("fact_type").agg(F.countDistinct("bank").alias("banks"))
    place = F.coalesce(*(F.when(F.col("fact_type") == t, i) for i, t in enumerate(first)), F.lit(len(first)))
    return cover.withColumn("profile", place).orderBy("profile", F.desc("banks"), "fact_type").limit(limit)


def bank_highlights(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """For each bank the number of facts, the largest value and its text, and whether it leads in either."""
    own = docs.select("doc_id", "bank").join(facts, "doc_id").groupBy("bank").agg(F.count("*").alias("n_facts"), F.max("value").alias("top_value"), F.max_by("fact_text", F.struct("value", "fact_text")).alias("top_text"))
    top = own.agg(F.max("n_facts").alias("f"), F.max("top_value").alias("v"))
    return own.crossJoin(F.broadcast(top)).select("bank", "n_facts", "top_value", "top_text", (F.col("n_facts") == F.col("f")).alias("most_facts"), (F.col("top_value") == F.col("v")).alias("largest"))  # one row is broadcast


#: Ways to sort a comparison of banks.
MODES = ("coverage", "bank", "confidence", "maturity", "amount")


def stated_number(text: Column) -> Column:
    """The first number of a fact's text, 0 without one: dots group, a comma is decimal."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d[\d.]*?(?:,\d+)?)(?=\s|TL|tl|₺|%|$)", 1), F.lit("")), F.regexp_extract(text, r"\d[\d.]*(?:,\d+)?", 0))
    return F.coalesce(F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def stated_months(text: Column) -> Column:
    """As stated_number, years as twelve months."""
    return stated_number(text) * F.when(F.lower(text).rlike("yıl|yil"), 12).otherwise(1)


def compare_banks(docs: DataFrame, facts: DataFrame, maturity: tuple[str, ...] = ("VADE_SURESI",), amount: tuple[str, ...] = ("FINANSMAN_TUTARI",)) -> DataFrame:
    """One row for each bank: n_facts (distinct types and texts), its best confidence, longest maturity in months and largest amount with their texts.

    docs: doc_id, bank, confidence; facts: doc_id, fact_type, fact_text. Banks without facts have zeros; null confidence counts as 0. Of equal values the least text counts.
    """
    own = facts.join(docs.select("doc_id", "bank"), "doc_id").groupBy("bank", "fact_type", "fact_text").agg(F.lit(1).alias("one"))
    best = lambda types, value: F.min(F.when(F.col("fact_type").isin(*types), F.struct((-value).alias("less"), F.col("fact_text").alias("text"))))
    found = own.groupBy("bank").agg(F.count("*").alias("n_facts"), best(maturity, stated_months(F.col("fact_text"))).alias("m"), best(amount, stated_number(F.col("fact_text"))).alias("a"))
    rows = docs.groupBy("bank").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence")).join(found, "bank", "left")
    zero = lambda c: F.coalesce(-F.col(c), F.lit(0.0))
    return rows.select("bank", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "confidence", zero("m.less").alias("months"), F.col("m.text").alias("months_text"), zero("a.less").alias("amount"), F.col("a.text").alias("amount_text"))


def sort_comparison(banks: DataFrame, mode: str) -> DataFrame:
    """Adds the place of each bank: names in Turkish order, or the largest first with equal ones in Turkish order."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    column = {"coverage": "n_facts", "confidence": "confidence", "maturity": "months", "amount": "amount"}.get(mode)
    name = [F.collate(F.col("bank"), "tr"), F.col("bank")]
    order = [F.desc(column), *name] if column else name
    return banks.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row for each bank


def comparison_highlights(banks: DataFrame) -> DataFrame:
    """(highlight, bank, value): the bank with most facts, with the longest maturity and with the largest amount; none where all are zero."""
    rows = []
    for name, column, value in (("coverage", "n_facts", F.col("n_facts").cast("string")), ("maturity", "months", F.col("months_text")), ("amount", "amount", F.col("amount_text"))):
        top = banks.filter(F.col(column) > 0) if name != "coverage" else banks
        rows.append(top.select(F.lit(name).alias("highlight"), "bank", value.alias("value"), F.col(column).alias("n")).orderBy(F.desc("n"), F.collate(F.col("bank"), "tr"), "bank").limit(1).drop("n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def period_change(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Banks whose set of attributes changed, appeared or went between two periods, with the difference in facts."""

    def signed(df: DataFrame, name: str) -> DataFrame:
        own = df.groupBy("bank", "fact_type", "fact_text").agg(F.count("*").alias("n"))
        # a digest of the set that is combined in any order: no bank's facts are gathered
        sign = F.struct(F.count("*"), F.bit_xor(F.xxhash64("fact_type", "fact_text")), F.bit_xor(F.xxhash64(F.lit(1), "fact_type", "fact_text")))
        return own.groupBy("bank").agg(sign.alias(f"sign_{name}"), F.sum("n").alias(f"n_{name}"))

    both = signed(current, "now").join(signed(baseline, "then"), "bank", "full")
    return both.select("bank", (~F.col("sign_now").eqNullSafe(F.col("sign_then"))).alias("changed"), (F.coalesce("n_now", F.lit(0)) - F.coalesce("n_then", F.lit(0))).alias("fact_delta"), F.coalesce("n_then", F.lit(0)).alias("baseline"))


def period_bounds(snaps: DataFrame, months: int | None) -> DataFrame:
    """From and to of the last `months` before the latest snapshot, or of all."""
    return snaps.agg(F.max("day").alias("to_day"), F.min("day").alias("first")).select(F.add_months("to_day", -months).alias("from_day") if months else F.col("first").alias("from_day"), "to_day")


#: Sort keys of the catalogue and their columns.
SORTS = {"relevance": "relevance", "confidence": "confidence", "facts": "n_facts", "bank": "_bank", "title": "_title", "updated": "_updated"}


def catalog(docs: DataFrame, facts: DataFrame, query: str, banks: list[str] | None = None, product: str | None = None, min_confidence: float | None = None, has_facts: bool | None = None, page: int = 1, size: int = 20, sort: str = "relevance", descending: bool = True) -> DataFrame:
    """A page of the catalogue: optional filters, relevance 4 for title, 2 for text, 1 for bank, plus confidence, with the total.

    Sorted by one of SORTS in either direction, missing values last, then by doc_id from the largest; `updated` needs that column in docs.
    """
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}")
    like = lambda c: F.col(c).ilike(f"%{query}%")
    n = facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    keep: list[Column] = [like("title") | like("text") | like("bank")]
    if banks:
        keep.append(F.col("bank").isin(banks))
    if product:
        keep.append(F.col("product") == product)
    if min_confidence is not None:
        keep.append(F.col("confidence") >= min_confidence)
    rows = docs
    for k in keep:
        rows = rows.filter(k)
    updated = F.col("updated") if "updated" in docs.columns else F.lit(None).cast("timestamp")
    rows = rows.select("doc_id", "bank", "product", "confidence", F.lower("bank").alias("_bank"), F.lower("title").alias("_title"), updated.alias("_updated"), (F.when(like("title"), 4).otherwise(0) + F.when(like("text"), 2).otherwise(0) + F.when(like("bank"), 1).otherwise(0) + F.coalesce("confidence", F.lit(0.0))).alias("relevance"))
    rows = rows.join(n, "doc_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    if has_facts is not None:
        rows = rows.filter((F.col("n_facts") > 0) == has_facts)
    total = rows.agg(F.count("*").alias("total"))
    key = F.col(SORTS[sort])
    shown = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.desc("doc_id")).drop("_bank", "_title", "_updated").offset((page - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total))  # one row is broadcast


def coverage(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents, those with facts, share in percent and the gap."""
    has = facts.select("doc_id").distinct().withColumn("has", F.lit(1))
    return docs.join(has, "doc_id", "left").agg(F.count("*").alias("documents"), F.count("has").alias("with_facts")).select("documents", "with_facts", (F.col("documents") - F.col("with_facts")).alias("gap"), F.bround(100 * F.col("with_facts") / F.when(F.col("documents") > 0, F.col("documents")), 1).alias("percent"))


def buckets(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Counts by key with shares in percent of all rows (half-even); null is the bucket `unlabelled`."""
    grouped = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unlabelled")).alias("key")).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n").alias("total"))
    out = grouped.crossJoin(F.broadcast(total)).select("key", "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("share"))
    return out.orderBy(F.desc("n"), "key").limit(limit) if limit else out


def merge_buckets(live: DataFrame, historical: DataFrame) -> DataFrame:
    """Sums of two bucket tables with new shares (half-up)."""
    grouped = live.select("key", "n").unionByName(historical.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    return grouped.crossJoin(F.broadcast(grouped.agg(F.sum("n").alias("total")))).select("key", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("share"))


def top_n_with_other(rows: DataFrame, n: int) -> DataFrame:
    """The n largest buckets and one row for the others."""
    top = rows.orderBy(F.desc("n"), "key").limit(n).select(F.col("key").alias("top_key"))
    marked = rows.join(top, F.col("key") == F.col("top_key"), "left")
    return marked.groupBy(F.coalesce("top_key", F.lit("other")).alias("key")).agg(F.sum("n").alias("n"))


def dashboard(docs: DataFrame, facts: DataFrame, snaps: DataFrame) -> DataFrame:
    """One row of totals; each grain has one aggregation, and single rows are crossed."""
    d = docs.agg(F.count("*").alias("documents"), F.countDistinct("bank").alias("banks"), F.count_if("verified").alias("verified"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    f = facts.agg(F.count("*").alias("facts"))
    s = snaps.agg(F.count("*").alias("snapshots"), F.count_if("searchable").alias("searchable"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return d.crossJoin(f).crossJoin(coverage(docs, facts).select("with_facts", "gap", "percent")).crossJoin(s)


def version_groups(snaps: DataFrame) -> DataFrame:
    """Versions of a page numbered by day, with their count."""
    w = Window.partitionBy("page").orderBy("day", "snap_id")
    return snaps.select("page", "snap_id", "day", F.row_number().over(w).alias("version"), F.count("*").over(Window.partitionBy("page")).alias("versions"))


def as_of(snaps: DataFrame, days: DataFrame, by: str = "product") -> DataFrame:
    """For each asked day and key the latest searchable snapshot on or before it.

    Snapshots are first combined to one for each key and day, then asked days join them by key and a running
    maximum answers all days at once: the window sees calendar days, not snapshots.
    """
    keys = snaps.select(by).distinct()
    asked = keys.crossJoin(days.distinct()).select(by, F.col("as_of").alias("day"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("snap_id"))
    daily = snaps.filter("searchable").groupBy(by, "day").agg(F.max("snap_id").alias("snap_id"))
    rows = daily.select(by, "day", F.lit(0).alias("asked"), "snap_id").unionByName(asked)
    last = Window.partitionBy(by).orderBy("day", "asked", "snap_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("snap_id", ignorenulls=True).over(last)).filter("asked = 1").select(by, F.col("day").alias("as_of"), F.col("found").alias("snap_id"))


def fact_verified(method: Column, status: Column) -> Column:
    """Approved, or made or confirmed by a person."""
    return F.coalesce(status == "approved", F.lit(False)) | F.coalesce(F.lower(method).rlike("human|manual|review_approved"), F.lit(False))


def coverage_audit(docs: DataFrame, facts: DataFrame, recoverable: Column) -> DataFrame:
    """Per product and bank: pages, pages with facts, gaps, gaps that a rule would fill, and the share after it."""
    has = facts.select("doc_id").distinct().withColumn("has", F.lit(True))
    rows = docs.join(has, "doc_id", "left").groupBy("product", "bank").agg(F.count("*").alias("pages"), F.count("has").alias("with_facts"), F.count_if(F.col("has").isNull()).alias("gaps"), F.count_if(F.col("has").isNull() & recoverable).alias("recoverable"))
    return rows.withColumn("projected", F.bround(100 * (F.col("with_facts") + F.col("recoverable")) / F.col("pages"), 1))


def backfill(facts: DataFrame, entities: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed facts that neither store has, compared by type and trimmed lower text; one of equal proposals, the most certain."""
    key = lambda df, p: df.select(F.col("doc_id").alias(f"{p}d"), F.col("fact_type").alias(f"{p}t"), F.lower(F.trim("fact_text")).alias(f"{p}x")).distinct()
    best = Window.partitionBy("doc_id", "fact_type", "x").orderBy(F.desc("confidence"), "fact_text")
    rows = proposed.withColumn("x", F.lower(F.trim("fact_text")))
    for i, store in enumerate((facts, entities)):
        k = key(store, f"k{i}")
        rows = rows.join(k, (F.col("doc_id") == F.col(f"k{i}d")) & (F.col("fact_type") == F.col(f"k{i}t")) & (F.col("x") == F.col(f"k{i}x")), "left_anti")
    return rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "x")


def prioritised_facts(rows: DataFrame, wanted: DataFrame, limit: int = 6) -> DataFrame:
    """Per query and document the wanted fact types first, then the others, `limit` at most."""
    marked = rows.join(wanted.withColumn("wanted", F.lit(1)), "fact_type", "left")
    order = Window.partitionBy("doc_id").orderBy(F.col("wanted").asc_nulls_last(), "fact_type", "n")
    return marked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("doc_id", "fact_type", "n", "place")
