"""Tables of questions: entities, periods, intent, evidence order, answer rows, session context."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.text import MONTHS, fold_text, ordered_dates


def extract_entities(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names whose alias occurs as a word, with an optional suffix after an apostrophe."""
    folded = fold_text(text)
    found = [F.when(reduce(lambda a, b: a | b, (folded.rlike(rf"\b{p}('[a-z]+)?\b") for p in patterns)), F.lit(name)) for name, patterns in aliases.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def extract_years(text: Column) -> Column:
    """struct(from_year, to_year) of the years in a text, null without one."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("from_year"), F.array_max(years).alias("to_year")))


# Ranges of years and months in folded text.
_YEAR, _MONTH, _TO = r"((?:19|20)\d{2})", f"({'|'.join(MONTHS)})", r"\s*(?:-|ile)\s*"
YEARS, MONTHS_OF_YEARS, MONTHS_OF_YEAR = rf"(?<!\d){_YEAR}{_TO}{_YEAR}(?!\d)", rf"(?<!\w){_MONTH}\s+{_YEAR}{_TO}{_MONTH}\s+{_YEAR}(?!\d)", rf"(?<!\w){_MONTH}{_TO}{_MONTH}\s+{_YEAR}(?!\d)"


def extract_period(text: Column) -> Column:
    """struct(year, since, until): a range of years, of months, or the first and last day that a text names, the first that fits and isn't reversed.

    The year is the first one named, given only where there is no range. All are null for a text without any.
    """
    folded = fold_text(text)
    year = lambda p, g: F.regexp_extract(folded, p, g).try_cast("int")
    month = lambda p, g: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(folded, p, g)), F.lit(0)).cast("int")
    bounds = lambda y1, m1, y2, m2: F.struct(F.make_date(y1, m1, F.lit(1)).alias("since"), F.last_day(F.make_date(y2, m2, F.lit(1))).alias("until"))
    ranges = [
        bounds(year(YEARS, 1), F.lit(1), year(YEARS, 2), F.lit(12)), bounds(year(MONTHS_OF_YEARS, 2), month(MONTHS_OF_YEARS, 1), year(MONTHS_OF_YEARS, 4), month(MONTHS_OF_YEARS, 3)),
        bounds(year(MONTHS_OF_YEAR, 3), month(MONTHS_OF_YEAR, 1), year(MONTHS_OF_YEAR, 3), month(MONTHS_OF_YEAR, 2)),
    ]
    days = ordered_dates(F.regexp_replace(folded, r"(?<!\d)((?:19|20)\d{2})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3"), repair=False)
    ranges.append(F.struct(F.array_min(days).alias("since"), F.array_max(days).alias("until")))
    found = F.coalesce(*(F.when(r["since"] <= r["until"], r) for r in ranges))
    named = F.when(found.isNull(), F.regexp_extract(folded, rf"(?<!\d){_YEAR}(?!\d)", 1).try_cast("int"))
    return F.struct(named.alias("year"), found["since"].alias("since"), found["until"].alias("until"))


def intent(text: Column) -> Column:
    """calculate, compare, historical, list or lookup, the first that fits."""
    t = fold_text(text)
    return F.when(t.rlike("hesapla|calculate"), "calculate").when(t.rlike("karsilastir|compare|versus|fark"), "compare").when(t.rlike("gecmis|eski|history|previous"), "historical").when(t.rlike("liste|hangi|all|list"), "list").otherwise("lookup")


def standalone_query(banks: Column, products: Column, fields: Column, year: Column) -> Column:
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), F.array_join(F.array_sort(c), ",")))
    return F.concat_ws("; ", part("banks", banks), F.when(year.isNotNull(), F.concat(F.lit("year="), year.cast("string"))), part("products", products), part("fields", fields))


def fold_session(turns: DataFrame, slots: list[str], change: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """State after each turn: a stated value replaces, a missing one is inherited since the last change of topic, sessions apart.

    A running count of topic changes starts a new group, in which the last stated value is carried on.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.withColumn("topic", F.sum(F.col(change).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "topic").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, order, *(F.last(s, ignorenulls=True).over(own).alias(s) for s in slots))


def cleared_fields(states: DataFrame, slots: list[str], key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Names of slots whose value changed from one turn to the next."""
    w = Window.partitionBy(key).orderBy(order)
    changed = [F.when(F.lag(s).over(w).isNotNull() & ~F.col(s).eqNullSafe(F.lag(s).over(w)), F.lit(s)) for s in slots]
    return states.select(key, order, F.array_join(F.array_compact(F.array(*changed)), ",").alias("cleared"))


def order_evidence(rows: DataFrame, descending: bool) -> DataFrame:
    """Place by missing value last, value in the asked direction, fusion score, bank and document."""
    value = F.col("value").desc_nulls_last() if descending else F.col("value").asc_nulls_last()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(value, F.desc("rrf"), "bank", "doc_id")))


def select_evidence(hits: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """The hits that may stand as evidence, `limit` for each query, with their new place.

    Columns of a hit: query_id, place, chunk_id, bank, product_match, contradicts (its title names another product), field_match (it
    has an asked fact), confirmation (2: its title names the product, 1: its text does, 0), and of its query: intent, asks_product,
    asks_field, asks_bank, numeric. Which hits stand is one strategy for each query, from what its hits have:
    joint matches of product and field, hits whose text confirms the product, hits of the product, joint ones before
    other field matches, field matches, all, or none. Comparisons and lists without a named bank first take the
    best confirmed hit of each bank. With `strict` a numeric answer needs the product in the text.
    """
    of = Window.partitionBy("query_id")
    product, field = F.col("product_match") & ~F.col("contradicts"), F.col("field_match")
    joint, confirmed = product & field, field & (F.col("confirmation") > 0)
    title = confirmed & (F.col("confirmation") == 2)
    rows = hits.select(
        "*", product.alias("is_product"), joint.alias("is_joint"), confirmed.alias("is_confirmed"), title.alias("is_title"), F.max(product).over(of).alias("any_product"), F.max(field).over(of).alias("any_field"), F.max(joint).over(of).alias("any_joint"),
        F.max(confirmed).over(of).alias("any_confirmed"), F.sum(title.cast("int")).over(of).alias("n_title"), (F.col("numeric") & F.col("intent").isin("lookup", "compare", "list", "calculate")).alias("counts"), (~F.col("asks_bank") & F.col("intent").isin("compare", "list")).alias("wide"),
    )
    both = F.col("asks_product") & F.col("asks_field")
    numeric = both & F.col("counts")
    fall = F.when(F.col("asks_product") & F.col("any_product"), "product").when(F.col("asks_field") & F.col("any_field"), "field").otherwise("all")
    if strict:
        named = F.when(F.col("wide"), "confirmed").when((F.col("n_title") > 0) & ((F.col("intent") != "compare") | (F.col("n_title") >= 2)), "title").otherwise("confirmed")
        sure = F.when(F.col("any_confirmed"), named).when(F.col("any_field"), "none").otherwise(fall)
    else:
        sure = F.when(F.col("any_joint"), "joint").when(F.col("any_confirmed"), "confirmed").when((F.col("intent") == "lookup") & F.col("any_product"), "product").otherwise("none")
    pick = F.when(numeric, sure).when(both & F.col("any_field"), "joint_first").otherwise(fall)
    rows = rows.withColumn("pick", pick).withColumn("wide", F.col("wide") & numeric & F.col("pick").isin("joint", "confirmed"))
    stands = F.when(F.col("pick") == "joint", F.col("is_joint")).when(F.col("pick") == "confirmed", F.col("is_confirmed")).when(F.col("pick") == "title", F.col("is_title")).when(F.col("pick") == "product", F.col("is_product")).when(F.col("pick").isin("field", "joint_first"), field).otherwise(F.col("pick") == "all")
    kept = rows.filter(stands)
    bank = Window.partitionBy("query_id", "bank")
    first = F.col("wide") & (F.row_number().over(bank.orderBy(F.desc("confirmation"), "place")) == 1)
    lead = F.when(first, 0).when((F.col("pick") == "joint_first") & F.col("is_joint"), 0).otherwise(1)
    kept = kept.withColumn("lead", lead).withColumn("rank", F.row_number().over(of.orderBy("lead", "place"))).filter(F.col("rank") <= limit)
    return kept.select("query_id", "chunk_id", "bank", "pick", F.col("rank").alias("place"))


def numeric_answer_rows(rows: DataFrame, k: int) -> DataFrame:
    """The best value of each bank for each query, then the k best; queries with fewer than two banks go."""
    one = rows.groupBy("query_id", "bank").agg(F.max(F.struct("value", "doc_id")).alias("best")).select("query_id", "bank", "best.value", "best.doc_id")
    w = Window.partitionBy("query_id")
    ranked = one.withColumn("banks", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("value"), "bank")))
    return ranked.filter((F.col("banks") >= 2) & (F.col("place") <= k)).drop("banks")


def source_ids(rows: DataFrame) -> DataFrame:
    """S1, S2, ... for the evidence of each query."""
    return rows.withColumn("source_id", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("string")))


def recent_context(turns: DataFrame, n: int, budget: int, cap: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns, newest first, while their capped lengths fit in the budget."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    rows = turns.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).withColumn("said", F.substring("text", 1, cap))
    used = F.sum(F.length("said")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.col("used") <= budget).select(key, order, "age", "used")


def validate_answers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(issue, n): claims whose source is unknown, that name another bank, cite several offers, whose numbers aren't in the evidence, or that share too few words with it (two and half of theirs at least, all if they have fewer).

    Banks are compared where both tables have `bank` (null: none is named), offers where claims have `claim_id` (a row for each
    source it cites) and the evidence `offer_id`.
    """
    banks, offers = {"bank"} <= set(claims.columns) & set(evidence.columns), "claim_id" in claims.columns and "offer_id" in evidence.columns
    other = [F.col("bank").alias("e_bank")] * banks + [F.col("offer_id").alias("e_offer")] * offers
    rows = claims.join(evidence.select("query_id", "source_id", F.col("text").alias("e"), *other), ["query_id", "source_id"], "left")
    wrong_bank = F.coalesce(F.col("bank") != F.col("e_bank"), F.lit(False)) if banks else F.lit(False)
    of = Window.partitionBy("query_id", "claim_id")
    several = F.coalesce(F.min("e_offer").over(of) != F.max("e_offer").over(of), F.lit(False)) if offers else F.lit(False)
    rows = rows.withColumn("wrong_bank", wrong_bank).withColumn("several", several)
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(fold_text(c), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= 4))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    shared, own = F.size(F.array_intersect(words(F.col("claim")), words(F.col("e")))), F.size(words(F.col("claim")))
    needed = F.least(own, F.greatest(F.lit(2), F.floor(own / 2)))
    issue = F.when(F.col("e").isNull(), "unknown_source").when(F.col("wrong_bank"), "bank").when(F.col("several"), "several_offers").when(F.size(F.array_except(numbers(F.col("claim")), numbers(F.col("e")))) > 0, "number").when(shared < needed, "support").otherwise("none")
    return rows.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def session_islands(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """Sessions of a user: a gap over the time to live begins another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    rows = events.withColumn("begins", (gap.isNull() | (gap > ttl_seconds * 1_000_000)).cast("int")).withColumn("session", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_session_hits(fresh: DataFrame, session: DataFrame, most: int = 2) -> DataFrame:
    """Hits of a query, then the hits carried over from its session, in their order.

    A carried hit is left out if its chunk is there or if its offer or its document has `most` hits already. Columns query_id, place,
    chunk_id, offer_id, doc_id; lists are results of a top-k search, so a query's list is short. Queries of either table are kept.
    """
    hit = "array<struct<place:bigint,chunk_id:bigint,offer_id:string,doc_id:bigint>>"
    lists = lambda t, name: t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "offer_id", "doc_id"))).cast(hit).alias(name))
    rows = lists(fresh, "own").join(lists(session, "old"), "query_id", "full")
    empty = F.array().cast(hit)

    def add(kept: Column, h: Column) -> Column:
        n = lambda c: F.size(F.filter(kept, lambda k: k[c].eqNullSafe(h[c])))
        return F.when((n("chunk_id") == 0) & (n("offer_id") < most) & (n("doc_id") < most), F.concat(kept, F.array(h))).otherwise(kept).cast(hit)

    own = F.coalesce("own", empty)
    kept = rows.select("query_id", F.size(own).alias("n"), F.aggregate(F.coalesce("old", empty), own, add).alias("kept"))
    out = kept.select("query_id", "n", F.posexplode("kept").alias("at", "h"))
    return out.select("query_id", (F.col("at") + 1).alias("place"), "h.chunk_id", "h.offer_id", "h.doc_id", (F.col("at") >= F.col("n")).alias("carried"))


def cited_refs(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """(conv_id, source_id, turn): sources that verified answers cite as [Sx], with the newest turn that does."""
    cited = turns.filter("verified").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(S\d+)\]"), F.lit(1)))).alias("source_id"))
    return cited.join(evidence.select("conv_id", "turn", "source_id").distinct(), ["conv_id", "turn", "source_id"]).groupBy("conv_id", "source_id").agg(F.max("turn").alias("turn"))
