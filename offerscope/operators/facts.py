"""Fact extraction: rules are rows, joined with the segments of all documents."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.text import fold_text, parse_number


def segments(docs: DataFrame, least: int = 12, most: int = 420, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, segment): sentences and lines of a document, trimmed, of fitting length, without folded repeats."""
    marked = F.regexp_replace(F.col(text), "([.!?;]) ", "$1\n")
    rows = docs.select(key, F.posexplode(F.transform(F.split(marked, "\n"), lambda s: F.trim(s))).alias("at", "segment")).filter(F.length("segment").between(least, most))
    first = rows.withColumn("folded", fold_text("segment")).groupBy(key, "folded").agg(F.min(F.struct("at", "segment")).alias("s"))
    return first.select(key, "s.at", "s.segment")


def _rule_values(text: Column, rule: dict, every: bool) -> Column:
    """Distinct values of a rule's matches whose surroundings have the required cue and not the excluded one."""
    whole, value = (F.regexp_extract_all(text, F.lit(rule["pattern"]), F.lit(i)) for i in (0, 1))
    gaps, radius = F.split(text, rule["pattern"], -1), rule.get("radius", 60)
    chars = lambda texts: F.aggregate(texts, F.lit(0), lambda n, x: n + F.length(x))

    def around(v: Column, i: Column) -> Column:
        place = chars(F.slice(gaps, F.lit(1), i + 1)) + chars(F.slice(whole, F.lit(1), i)) + F.instr(F.get(whole, i), v)
        start = F.greatest(place - radius, F.lit(1))
        return F.substring(text, start, place + F.length(v) + radius - start)

    found = F.transform(value, lambda v, i: F.struct(v.alias("value"), around(v, i).alias("around")))
    found = found if every else F.slice(found, 1, 1)
    if rule.get("required"):
        found = F.filter(found, lambda m: m["around"].rlike(rule["required"]))
    if rule.get("excluded"):
        found = F.filter(found, lambda m: ~m["around"].rlike(rule["excluded"]))
    return F.array_distinct(F.filter(F.transform(found, lambda m: m["value"]), lambda v: v != ""))


def apply_rules(rows: DataFrame, rules: list[dict], key: str = "doc_id", every: bool = True) -> DataFrame:
    """(key, at, fact_type, fact_text, evidence, confidence, ordinal) of all matches, distinct for each segment and rule.

    A rule has fact_type, pattern (with one group, matching no empty text), required and excluded cues, radius and
    confidence. The number of rules is fixed by the program; they are one array literal, exploded over each segment, so
    a segment is read once whatever the number of rules, and cues are looked for in the radius around each match.
    With `every` false only a rule's first match in a segment is taken.
    """

    def made(i: int, r: dict) -> Column:
        fact = lambda v: F.struct(F.lit(r["fact_type"]).alias("fact_type"), v.alias("fact_text"), F.lit(float(r["confidence"])).alias("confidence"), F.lit(i).alias("ordinal"))
        return F.transform(_rule_values(F.lower("segment"), r, every), fact)

    found = rows.select(key, "at", "segment", F.explode(F.flatten(F.array(*(made(i, r) for i, r in enumerate(rules))))).alias("f"))
    return found.select(key, "at", "f.fact_type", "f.fact_text", F.col("segment").alias("evidence"), "f.confidence", "f.ordinal")


def cap_facts(facts: DataFrame, per_type: int = 3, per_doc: int = 18, key: str = "doc_id") -> DataFrame:
    """Facts that occur in their evidence, one of equal folded texts, at most `per_type` and `per_doc` in the order of emission."""
    rows = facts.filter(F.instr(F.lower("evidence"), F.lower("fact_text")) > 0).withColumn("x", fold_text("fact_text"))
    order = ("at", "ordinal", "fact_text")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, "fact_type", "x").orderBy(*order))).filter("rn = 1")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, "fact_type").orderBy(*order))).filter(F.col("rn") <= per_type)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= per_doc)
    return rows.drop("rn", "x")


def page_keywords(docs: DataFrame, stop: tuple[str, ...], key: str = "doc_id", title: str = "title") -> DataFrame:
    """(key, keywords): sorted folded title words of four letters and more without stop words."""
    words = F.split(F.trim(F.regexp_replace(fold_text(title), "[^a-z0-9]+", " ")), " ")
    return docs.select(key, F.array_sort(F.array_distinct(F.array_except(F.filter(words, lambda w: F.length(w) >= 4), F.array(*map(F.lit, stop))))).alias("keywords"))


def nearest_cue(text: Column, place: Column, cues: dict[str, str], radius: int = 130) -> Column:
    """The name of the cue pattern that is found nearest before or after a place; null if there is none in the radius."""
    before, after = F.substring(text, F.greatest(place - radius, F.lit(1)), F.least(F.lit(radius), place - 1)), F.substring(text, place, F.lit(radius))
    far = F.lit(10**6)
    best = None
    for name, pattern in cues.items():
        left = F.when(before.rlike(pattern), F.length(F.regexp_extract(before, f"({pattern})(?!.*({pattern}))(.*)$", 3))).otherwise(far)
        right = F.when(after.rlike(pattern), F.length(F.regexp_extract(after, f"^(.*?)({pattern})", 1))).otherwise(far)
        one = F.struct(F.least(left, right).alias("far"), F.lit(name).alias("name"))
        best = one if best is None else F.least(best, one)
    return F.when(best["far"] < far, best["name"])


def surface_check(kind: Column, value: Column) -> Column:
    """Money needs a currency, percent its mark, a count lies in 1 to 120 without unit, a duration needs a unit, a range two dates."""
    date = r"\d{1,2}\.\d{1,2}\.\d{4}"
    return (
        F.when(kind == "money", value.rlike(r"(?i)\d.*(tl|try|usd|eur|[$€₺])"))
        .when(kind == "percent", value.rlike(r"%|(?i)yuzde|percent"))
        .when(kind == "count", value.rlike(r"^\s*\d+\s*$") & F.coalesce(F.trim(value).try_cast("int").between(1, 120), F.lit(False)))
        .when(kind == "duration", value.rlike(r"(?i)\d+\s*(ay|yil|gun|month|year|day)"))
        .when(kind == "range", value.rlike(f"{date}.*{date}"))
        .otherwise(F.lit(True))
    )


def normalise_value(kind: Column, value: Column) -> Column:
    """struct(value, unit) of money, percent, duration and count; null value for others."""
    unit = F.when(kind == "money", F.upper(F.regexp_extract(value, r"(?i)(tl|try|usd|eur)", 1))).when(kind == "percent", "percent").when(kind == "duration", F.when(value.rlike("(?i)yil|year"), "year").when(value.rlike("(?i)gun|day"), "day").otherwise("month")).when(kind == "count", "count")
    return F.struct(F.when(kind.isin("money", "percent", "duration", "count"), parse_number(value)).alias("value"), unit.alias("unit"))


def evidence_window(text: Column, start: Column, end: Column, radius: int = 180) -> Column:
    """The text between the nearest sentence ends within the radius around a span (offsets from 0, end exclusive)."""
    left = F.substring(text, F.greatest(start - radius, F.lit(0)) + 1, F.least(start, F.lit(radius)))
    right = F.substring(text, end + 1, F.lit(radius))
    head = F.regexp_extract(left, r"([^.!?\n]*)\z", 1)
    tail = F.when(right.rlike(r"[.!?\n]"), F.regexp_extract(right, r"^([^.!?\n]*[.!?]?)", 1)).otherwise(right)
    return F.trim(F.concat(head, F.substring(text, start + 1, end - start), tail))


def decide(rows: DataFrame, thresholds: dict[str, float], numeric: tuple[str, ...], review: float = 0.5) -> DataFrame:
    """(doc_id, label, fact_text, decision, reason) in order of priority (columns label, fact_text, evidence, rule_ok, confidence)."""
    floor = F.coalesce(*(F.when(F.col("label") == k, v) for k, v in thresholds.items()), F.lit(0.95))
    odd = F.col("fact_text").rlike("[\\uFFFD\\p{Co}²³]")
    reason = (
        F.when(F.instr("evidence", F.col("fact_text")) == 0, "not_in_evidence").when(F.col("label").isin(*numeric) & ~F.col("fact_text").rlike("[0-9]"), "no_digit").when(odd, "suspicious").when(F.col("rule_ok") & (F.col("confidence") >= floor), "accepted")
        .when(F.col("rule_ok") & (F.col("confidence") >= review), "low_confidence").otherwise("rule")
    )
    decision = F.when(reason == "accepted", "accepted").when(reason.isin("suspicious", "low_confidence"), "review").otherwise("rejected")
    return rows.select("doc_id", "label", "fact_text", decision.alias("decision"), reason.alias("reason"))


def allowed_labels(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per product: spans kept and dropped by the table (product, label) of allowed labels."""
    rows = spans.join(allowed.withColumn("ok", F.lit(1)), ["product", "label"], "left")
    return rows.groupBy("product").agg(F.count("ok").alias("kept"), F.count_if(F.col("ok").isNull()).alias("dropped"))


def dedup_candidates(rows: DataFrame) -> DataFrame:
    """Best of each (document, label, folded text) by decision, confidence and order of emission."""
    rank = F.when(F.col("decision") == "accepted", 0).when(F.col("decision") == "review", 1).otherwise(2)
    w = Window.partitionBy("doc_id", "label", fold_text("fact_text")).orderBy(rank, F.desc("confidence"), "ordinal")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def merge_bio_tokens(tokens: DataFrame, threshold: float) -> DataFrame:
    """Spans from token labels (doc_id, word, label as B-x, I-x or O, score): runs begin at B or at a change; score is the mean."""
    w = Window.partitionBy("doc_id").orderBy("word")
    kind = F.when(F.col("label") == "O", None).otherwise(F.substring("label", 3, 100))
    rows = tokens.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w)).withColumn("gap", F.col("word") - F.lag("word").over(w))
    begin = F.col("kind").isNotNull() & (F.col("label").startswith("B") | F.col("before").isNull() | (F.col("before") != F.col("kind")) | (F.col("gap") != 1))
    rows = rows.withColumn("span", F.sum(begin.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("kind is not null")
    out = rows.groupBy("doc_id", "span", "kind").agg(F.min("word").alias("start"), F.max("word").alias("end"), F.round(F.avg("score"), 6).alias("score"))
    return out.filter(F.col("score") >= threshold).select("doc_id", "kind", "start", "end", "score")


def campaign_bounds(facts: DataFrame) -> DataFrame:
    """(doc_id, start, end, ambiguous, multiple): least start and largest end; deadlines give an end only, reversed periods are left out but make it ambiguous."""
    period = (F.col("kind") == "period") & (F.col("start") <= F.col("end"))
    return facts.groupBy("doc_id").agg(
        F.min(F.when(period, F.col("start"))).alias("start"), F.max(F.when(period | (F.col("kind") == "deadline"), F.col("end"))).alias("end"),
        F.bool_or((F.col("kind") == "period") & (F.col("start") > F.col("end"))).alias("ambiguous"), (F.countDistinct(F.when(period, F.concat_ws("/", "start", "end"))) > 1).alias("multiple"),
    )


def merge_fact_sources(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Stored facts, then derived ones whose type and folded text are new for the document."""
    key = ["doc_id", "fact_type", "x"]
    s, n = stored.withColumn("x", fold_text("fact_text")), derived.withColumn("x", fold_text("fact_text"))
    return stored.withColumn("origin", F.lit("stored")).unionByName(n.join(s.select(key).distinct(), key, "left_anti").drop("x").withColumn("origin", F.lit("derived")))


def fact_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# Patterns that the folded evidence of a claimed fact must contain, all of them, by type of fact.
AMOUNT, PERCENT, DIGIT = r"\d[\d., ]*\s*(?:tl|try|turk lirasi)\b", "%|yuzde", r"\d"
MONTHS = r"\b\d{1,4}\s*(?:ay(?:a|lik)?|yil(?:a|lik)?|gun(?:e|luk)?)\b"
DAY = r"\b\d{1,2}\s+(?:ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)\b"
CLAIMS = {
    "FINANSMAN_TUTARI": ("finansman", AMOUNT),
    "FINANSMAN_ORANI": ("finansman", PERCENT),
    "GEREKLI_BELGE": ("belge|nufus|ehliyet|pasaport|gelir|bordro|tapu|ikametgah|fatura",),
    "BASVURU_KANALI": ("basvuru|sube|internet|web sitesi|online|mobil|iletisim merkezi",),
    "ODEME_PLANI": ("odeme|taksit",),
    "VERGI_MUAFIYETI": ("kkdf|bsmv|vergi.*muaf|muaf.*vergi",),
    "SIGORTA_KOSULU": ("sigorta|dask|deprem",),
    "ERKEN_ODEME_KOSULU": ("erken", "odeme"),
    "TEMINAT": ("teminat|ipotek|kefil",),
    "HARCAMA_ESIGI": ("harcama", AMOUNT),
    "INDIRIM_ORANI": ("indirim", PERCENT),
    "KAMPANYA_SURESI": ("kampanya", rf"{MONTHS}|{DAY}|\b20\d{{2}}\b"),
    "KAR_PAYI_ORANI": ("kar payi|kar orani", DIGIT),
    "KAR_PAYLASIM_ORANI": ("paylasim", rf"{PERCENT}|{DIGIT}"),
    "MASRAF_DURUMU": ("masraf|ucret|komisyon|muaf",),
    "ODUL_MIKTARI": ("odul|puan|iade", DIGIT),
    "TAHSIS_UCRETI": ("tahsis", rf"{AMOUNT}|{PERCENT}"),
    "TAKSIT_SAYISI": ("taksit", DIGIT),
    "VADE_SURESI": ("vade", MONTHS),
    "ALISVERIS_PUANI": ("puan", DIGIT),
}


def recover_evidence(text: Column, claimed: Column) -> Column:
    """The passage of a text that equals a claimed one but for case and kinds of white space; null without one."""
    said = F.trim(F.regexp_replace(claimed, r"\s+", " "))
    literal = F.regexp_replace(said, r"([^\p{L}\p{M}\p{N}_ ])", r"\\$1")
    return F.when(said != "", F.regexp_substr(text, F.concat(F.lit("(?iu)"), F.replace(literal, F.lit(" "), F.lit(r"\s+")))))


def validate_claimed_facts(claims: DataFrame, docs: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """Claims (key, fact_type, fact_text, evidence, confidence and others) with the evidence as the source has it and the reason of a rejection.

    Checked in order: confidence, evidence in the source, fact in the evidence, patterns of the type; null reason: accepted.
    Claims without a document have no evidence. Only claims of enough confidence ask for texts.
    """
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    sources = docs.select(F.col(key).alias("_key"), F.col("text").alias("_source"))
    rows = claims.join(sources, (F.col(key) == F.col("_key")) & sure, "left").withColumn("_found", F.when(sure, recover_evidence(F.col("_source"), F.col("evidence"))))
    folded = fold_text("_found")
    inside = F.coalesce(F.instr(folded, fold_text("fact_text")) > 0, F.lit(False))
    met = F.lit(True)
    for kind, patterns in CLAIMS.items():
        for p in patterns:
            met = met & ((F.col("fact_type") != kind) | folded.rlike(p))
    reason = F.when(~sure, "low_confidence").when(F.col("_found").isNull(), "evidence_not_in_source").when(~inside, "fact_not_in_evidence").when(~F.coalesce(met, F.lit(True)), "label_rule_failed")
    return rows.withColumn("reason", reason).withColumn("evidence", F.coalesce("_found", "evidence")).drop("_found", "_source", "_key")


# Application channels (specific ones, then the plain branch), cues of free use and of tax exemption, on folded text.
CHANNELS = (
    r"\bmobil sube\b", r"\bmobil uygulama(?:si|dan|mizdan)?\b", r"\binternet sube(?:si|den|mizden)?\b", r"\bweb sitesi(?:nden)?\b",
    r"\bonline basvuru\b", r"\bcagri merkezi(?:nden)?\b", r"\bmusteri iletisim merkezi(?:nden)?\b", r"\bgoruntulu gorusme\b",
)
BRANCH = r"\bsube(?:lerimiz|miz|den|ye)?\b"
NOT_NEEDED = r"(?!.{0,12}gitmeden)"
OPERATION, ABLE = "islem|alim satim|hesap acilis", "yapabilir|gerceklestirebilir|acabilirsiniz"
FREE = r"masrafsiz|ucret alinmaz|masraf alinmaz|herhangi bir ucret alinmamaktadir|ucretsiz olarak kullan|islemler ucretsiz|islem ucretsiz|basvuru ucretsiz|hesap acilis ucretsiz"
FREE_OF = "urun|finansman|hesap|basvuru|islem|kart|kampanya|hizmet"
FREE_VALUE = r"\bmasrafsiz\b|\bucretsiz\b|\bucret alinmaz\b|\bmasraf alinmaz\b|\bherhangi bir ucret alinmamaktadir\b"
TAX, EXEMPT = r"\b(?:kkdf|bsmv)\b", "muaf|alinmaz|tabi degil"


def _matches(rows: DataFrame, values: Column, fact_type: str, confidence: float, key: str) -> DataFrame:
    out = rows.select(key, "at", F.explode(F.array_distinct(values)).alias("fact_text"), F.col("segment").alias("evidence"))
    return out.select(key, "at", F.lit(fact_type).alias("fact_type"), "fact_text", "evidence", F.lit(confidence).alias("confidence"))


def channel_rules(rows: DataFrame, operations: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Application channels (folded) of segments that speak of applying, or of operations for products (column `product`) in `operations`.

    The plain branch word doesn't count inside a specific channel; "gitmeden" (without going) shortly after a channel cancels it.
    """
    text = fold_text("segment")
    applies = text.contains("basvur")
    if operations:
        applies = applies | (F.col("product").isin(*operations) & text.rlike(OPERATION) & text.rlike(ABLE))
    specific = "|".join(CHANNELS)
    found = F.concat(F.regexp_extract_all(text, F.lit(f"(?:{specific}){NOT_NEEDED}"), F.lit(0)), F.regexp_extract_all(F.regexp_replace(text, specific, "/"), F.lit(BRANCH + NOT_NEEDED), F.lit(0)))
    return _matches(rows.filter(applies), found, "BASVURU_KANALI", 0.96, key)


def fee_tax_rules(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Free use (0.95) and taxes that aren't charged (0.98), as folded values."""
    text = fold_text("segment")
    free = _matches(rows.filter(text.rlike(FREE) & text.rlike(FREE_OF)), F.regexp_extract_all(text, F.lit(FREE_VALUE), F.lit(0)), "MASRAF_DURUMU", 0.95, key)
    return free.unionByName(_matches(rows.filter(text.rlike(EXEMPT)), F.regexp_extract_all(text, F.lit(TAX), F.lit(0)), "VERGI_MUAFIYETI", 0.98, key))
