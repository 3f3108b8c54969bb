"""What an amount or a percentage stands for in its evidence, and whether the evidence speaks for or against a label.

All are expressions on folded text; places are counted in characters from 0, ends exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.text import fold_text

# Money and percentages in folded text.
MONEY = r"\b\d[\d. ]*(?:,\d+)?\s*(?:tl|try|turk lirasi|usd|eur)\b"
AMOUNT = r"\b\d[\d. ]*(?:,\d+)?\s*(?:tl|try|turk lirasi)\b"
PERCENT = r"%\s*\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\s*%"
# What stands around the amount that has to be spent.
OVER_AFTER = r"^\s*(?:['’]?(?:ye|ya|e|a))?\s*(?:ve\s+)?(?:uzeri|ustu|uzerindeyse|ustundeyse)\b"
SPEND_AFTER = r"^\s*(?:['’]?(?:ye|ya|e|a))?\s*(?:(?:deger|tutar)inde\s+)?(?:tek\s+seferde\s+)?(?:harcama|alisveris)\b"
LEAST, SPEND = "en az|minimum|alt limit|harcama esigi", "harcama|alisveris"
# What stands around an amount that is given back.
REWARD = "worldpuan|world puan|wordpuan|iade|hediye|odul|bonus|promosyon|chip para|puan kazan|puan hediye"
FOR_SPENDING, IN_ALL, TIER = r"(?:harcamaya|alisverise)\s*$", r"^\s*,?\s*toplam(?:da)?\b", r"(?:kadarsa|arasindaysa|uzerindeyse|ustundeyse)\s*$"
# Words near a percentage.
DISCOUNT_CUES = ("indirim", "iade")
FINANCE_CUES = ("kar payi", "kar orani", "finansman orani", "oranla", "oranlarla", "orandan")


def _chars(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, x: n + F.length(x))


def _last(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - n, F.lit(0)) + 1, F.lit(n))


def matches(folded: Column, pattern: str) -> Column:
    """array<struct<said, start, stop>> of a pattern's matches, from the gaps between them."""
    gaps, said = F.split(folded, pattern, -1), F.regexp_extract_all(folded, F.lit(f"({pattern})"), F.lit(1))
    at = lambda i: _chars(F.slice(gaps, F.lit(1), i + 1)) + _chars(F.slice(said, F.lit(1), i))
    return F.transform(F.transform(said, lambda x, i: F.struct(x.alias("said"), at(i).alias("start"))), lambda m: F.struct(m["said"].alias("said"), m["start"].alias("start"), (m["start"] + F.length(m["said"])).alias("stop")))


def occurrences(folded: Column, value: Column) -> Column:
    """As `matches`, of a folded text that is not empty; none of null and of the empty text."""
    gaps = F.split(folded, F.concat(F.lit(r"\Q"), value, F.lit(r"\E")), -1)
    start = lambda i: _chars(F.slice(gaps, F.lit(1), i + 1)) + i * F.length(value)
    found = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda _, i: F.struct(value.alias("said"), start(i).alias("start"), (start(i) + F.length(value)).alias("stop")))
    none = F.array().cast("array<struct<said:string,start:int,stop:int>>")
    return F.when(F.coalesce(value, F.lit("")) != "", found).otherwise(none)


def _amount_role(c: Column) -> Column:
    """Of struct(before, after, future): the spending asked for comes first, then a reward, then a discount."""
    before, after = c["before"], c["after"]
    asked = after.rlike(OVER_AFTER) | F.substring(after, 1, 70).rlike(SPEND_AFTER) | (_last(before, 65).rlike(LEAST) & F.concat(before, F.lit("\n"), after).rlike(SPEND))
    later = c["future"].rlike(REWARD) & (after.rlike(IN_ALL) | _last(before, 55).rlike(TIER))
    given = F.substring(after, 1, 100).rlike(REWARD) | _last(before, 65).rlike(REWARD) | _last(before, 55).rlike(FOR_SPENDING) | later
    less = F.substring(after, 1, 65).contains("indirim") | _last(before, 55).contains("indirim")
    return F.when(asked, "spend_threshold").when(given, "reward").when(less, "discount")


def with_amount_roles(folded: Column, places: Column) -> Column:
    """array<struct<said, start, role>>. An amount's text reaches from 100 characters before it to 130 behind it, but not past another amount."""
    money = matches(folded, MONEY)

    def bounds(m: Column) -> Column:
        left = F.array_max(F.transform(F.filter(money, lambda o: o["stop"] <= m["start"]), lambda o: o["stop"]))
        right = F.array_min(F.transform(F.filter(money, lambda o: o["start"] >= m["stop"]), lambda o: o["start"]))
        left, right = F.greatest(F.lit(0), m["start"] - 100, left), F.least(F.length(folded), m["stop"] + 130, right)
        return F.struct(m["said"].alias("said"), m["start"].alias("start"), m["stop"].alias("stop"), left.alias("left"), right.alias("right"))

    def context(m: Column) -> Column:
        cut = lambda a, b: F.substring(folded, a + 1, b - a)
        return F.struct(m["said"].alias("said"), m["start"].alias("start"), cut(m["left"], m["start"]).alias("before"), cut(m["stop"], m["right"]).alias("after"), F.substring(folded, m["stop"] + 1, F.lit(220)).alias("future"))

    return F.transform(F.transform(F.transform(places, bounds), context), lambda c: F.struct(c["said"].alias("said"), c["start"].alias("start"), _amount_role(c).alias("role")))


def with_percent_roles(folded: Column, places: Column, radius: int = 130) -> Column:
    """array<struct<said, start, role>>: finance or discount, whose cue is nearest on either side; discount at a tie, null without one.

    A cue counts if it lies whole in the radius and outside of the percentage.
    """
    far = F.lit(2**31 - 1)

    def context(m: Column) -> Column:
        before = F.substring(folded, F.greatest(m["start"] - radius, F.lit(0)) + 1, F.least(m["start"], F.lit(radius)))
        return F.struct(m["said"].alias("said"), m["start"].alias("start"), F.reverse(before).alias("before"), F.substring(folded, m["stop"] + 1, F.lit(radius)).alias("after"))

    def distance(c: Column, cues: tuple[str, ...]) -> Column:
        places = [F.instr(c["after"], F.lit(cue)) for cue in cues] + [F.instr(c["before"], F.lit(cue[::-1])) for cue in cues]
        return F.least(*(F.when(p > 0, p - 1).otherwise(far) for p in places))

    def role(c: Column) -> Column:
        return F.when(c["finance"] < c["discount"], "finance").when(c["discount"] < far, "discount")

    read = F.transform(F.transform(places, context), lambda c: F.struct(c["said"].alias("said"), c["start"].alias("start"), distance(c, FINANCE_CUES).alias("finance"), distance(c, DISCOUNT_CUES).alias("discount")))
    return F.transform(read, lambda c: F.struct(c["said"].alias("said"), c["start"].alias("start"), role(c).alias("role")))


def amount_roles(rows: DataFrame) -> DataFrame:
    """A row for each amount in `evidence`, with its role: spend_threshold, reward, discount or null. Null evidence has none."""
    found = rows.withColumn("_folded", fold_text("evidence")).select(*rows.columns, F.explode(with_amount_roles(F.col("_folded"), matches(F.col("_folded"), AMOUNT))).alias("_m"))
    return found.select(*rows.columns, F.col("_m.said").alias("amount"), F.col("_m.role").alias("role"))


def percent_roles(rows: DataFrame) -> DataFrame:
    """A row for each percentage in `evidence`, with its role: finance, discount or null. Null evidence has none."""
    found = rows.withColumn("_folded", fold_text("evidence")).select(*rows.columns, F.explode(with_percent_roles(F.col("_folded"), matches(F.col("_folded"), PERCENT))).alias("_m"))
    return found.select(*rows.columns, F.col("_m.said").alias("percent"), F.col("_m.role").alias("role"))


# By label, patterns of folded evidence that must all be found.
HAS_AMOUNT, HAS_PERCENT, DIGIT = r"\d[\d., ]*\s*(?:tl|try|turk lirasi|usd|eur)\b|\d[\d., ]*\s*₺", "%|yuzde", r"\d"
SPENDING, MOVES = "harcama|alisveris", "islem|eft|fast|havale|transfer|atm"
DURATION_RANGE = r"\b\d{1,3}\s*[-–—]\s*\d{1,3}\s*(?:ay|yil|gun)\b"
TERM = r"(?=.*(?:vade|geri odeme suresi)).*\d+\s*(?:ay|yil|gun)(?:a|i|e|dir|lik)?\b"
SPEAKS_FOR = {
    "FINANSMAN_TUTARI": (HAS_AMOUNT, "finansman|inansman tutar|kredi tutari|kullanim tutari|finansman limiti|kredi limiti|tutari"),
    "VADE_SURESI": (f"{DURATION_RANGE}|{TERM}",),
    "TAKSIT_SAYISI": ("taksit", DIGIT),
    "KAR_PAYLASIM_ORANI": ("paylasim", f"{HAS_PERCENT}|{DIGIT}"),
    "TAHSIS_UCRETI": ("tahsis", HAS_AMOUNT),
    "EKSPERTIZ_UCRETI": ("ekspertiz|degerleme", HAS_AMOUNT),
    "IPOTEK_TESIS_UCRETI": ("ipotek", "tesis", HAS_AMOUNT),
    "HARCAMA_UST_LIMITI": (SPENDING, HAS_AMOUNT, "en fazla|azami|ust limit|tavan|kadar"),
    "KAMPANYA_TARIH_ARALIGI": ("kampanya|ampanya araligi|tarih|gecerli", DIGIT),
    "MINIMUM_BAKIYE": ("bakiye|hesap acilis", HAS_AMOUNT, "minimum|asgari|en az|alt"),
    "ISLEM_ALT_LIMITI": (MOVES, "minimum|asgari|en az|alt limit", HAS_AMOUNT),
    "ISLEM_UST_LIMITI": (MOVES, "maksimum|azami|en fazla|ust limit", HAS_AMOUNT),
}
# By label whose value has a role, that role, the patterns that must be found, and the cue that stands for the role where no value is given.
BY_ROLE = {
    "HARCAMA_ESIGI": ("spend_threshold", (SPENDING, HAS_AMOUNT), "en az|minimum|alt limit|esik|ve uzeri"),
    "INDIRIM_TUTARI": ("discount", (HAS_AMOUNT,), "indirim"),
    "ODUL_TUTARI": ("reward", (HAS_AMOUNT,), "odul|iade|bonus|worldpuan"),
    "INDIRIM_ORANI": ("discount", (HAS_PERCENT,), "indirim|iade"),
}
RATE_WORDS = "kar payi|kar orani|finansman orani"
# By label, named reasons against it in order, with patterns that must all be found.
SPEAKS_AGAINST = {
    "VADE_SURESI": (
        ("excluded_early_payment_context", ("erken odeme|tazminat|kalan vade",)),
        ("excluded_first_payment_timing_context", ("ilk taksit|lk taksit|ilk odeme|lk odeme|odeme tarihi|(?=.*en gec).*gun sonrasina kadar",)),
        ("excluded_commitment_extension_context", ("taahhut", "uzat")),
        ("excluded_residency_duration_context", ("oturan|ikamet", "en az|suresi|boyunca")),
        ("excluded_membership_duration_context", ("yil", "sistemde kalan|sistemde kaldiktan|devlet katkisi|emeklilik sistemi|56 yas")),
    ),
    "FINANSMAN_TUTARI": (
        ("excluded_insurance_policy_limit_context", ("abonman|police|sigorta limiti", "maksimum limit|teminat|gemi|kamyon")),
        ("excluded_total_repayment_context", ("odenecek toplam tutar|toplam geri odeme|toplam geri odenen",)),
        ("excluded_asset_value_tier_context", ("arasi vade|araliginda vade",)),
        ("conflicting_property_value_context", ("deger|bedel|fiyat|rayic|satis tutari|fatura tutari",)),
        ("excluded_document_requirement_threshold_context", ("gelir belgesi|gelir beyani|belge beyani", "asmayan|asmasi|muaf|talep edilmeyecek|istenmeyecek")),
    ),
}
# By label, the role its value should have, roles that speak against it where it has not, and the reason.
OTHER_ROLE = {
    "HARCAMA_ESIGI": ("spend_threshold", ("reward", "discount"), "excluded_reward_amount_context"),
    "ODUL_TUTARI": ("reward", ("spend_threshold",), "excluded_spend_threshold_context"),
    "INDIRIM_TUTARI": ("discount", ("reward", "spend_threshold"), "excluded_non_discount_amount_context"),
    "INDIRIM_ORANI": ("discount", ("finance",), "excluded_finance_rate_context"),
    "KAR_PAYI_ORANI": ("finance", ("discount",), "excluded_discount_rate_context"),
}
RATES = ("INDIRIM_ORANI", "KAR_PAYI_ORANI")
WITHDRAWAL = ("excluded_withdrawal_limit_context", ("para cek|nakit cek|atm'den cek|atm den cek", "ucretsiz|kadar|limit"))


def _has(text: Column, patterns: tuple[str, ...]) -> Column:
    met = F.lit(True)
    for p in patterns:
        met = met & text.rlike(p)
    return met


def with_value_roles(rows: DataFrame) -> DataFrame:
    """Adds _text and _value (folded evidence and value) and _roles, the roles of all places of the value; amounts and rates each by their own rule."""
    rows = rows.withColumn("_text", fold_text("evidence")).withColumn("_value", fold_text(F.coalesce("value", F.lit(""))))
    text, places = F.col("_text"), occurrences(F.col("_text"), F.col("_value"))
    asked = F.when(F.col("label").isin(*RATES), with_percent_roles(text, places)).when(F.col("label").isin(*BY_ROLE, *OTHER_ROLE), with_amount_roles(text, places))
    return rows.withColumn("_roles", F.array_compact(F.array_distinct(F.transform(F.coalesce(asked, F.array().cast("array<struct<said:string,start:int,role:string>>")), lambda m: m["role"]))))


def context_verdicts(rows: DataFrame) -> DataFrame:
    """Adds rule_ok (the evidence speaks for the label) and excluded (the first named reason against it, null: none).

    Columns label, evidence and value (null or empty: no value is known, so cue words stand for its role). Labels without a rule
    don't pass. Null evidence neither passes nor has a reason.
    """
    read = with_value_roles(rows)
    text, label, roles, known = F.col("_text"), F.col("label"), F.col("_roles"), F.col("_value") != ""
    ok, reason = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, patterns in SPEAKS_FOR.items():
        ok = F.coalesce(ok, F.when(label == name, _has(text, patterns)))
    for name, (role, patterns, cue) in BY_ROLE.items():
        ok = F.coalesce(ok, F.when(label == name, _has(text, patterns) & F.when(known, F.array_contains(roles, role)).otherwise(text.rlike(cue))))
    ok = F.coalesce(ok, F.when(label == "KAR_PAYI_ORANI", text.rlike(HAS_PERCENT) & (F.array_contains(roles, "finance") | text.rlike(RATE_WORDS))), F.lit(False))
    for name, reasons in SPEAKS_AGAINST.items():
        for said, patterns in reasons:
            reason = F.coalesce(reason, F.when((label == name) & _has(text, patterns), F.lit(said)))
    for name, (role, others, said) in OTHER_ROLE.items():
        other = ~F.array_contains(roles, role) & F.arrays_overlap(roles, F.array(*map(F.lit, others)))
        reason = F.coalesce(reason, F.when((label == name) & known & other, F.lit(said)))
    reason = F.coalesce(reason, F.when((label == "ODUL_TUTARI") & _has(text, WITHDRAWAL[1]), F.lit(WITHDRAWAL[0])))
    return read.withColumn("rule_ok", ok).withColumn("excluded", reason).drop("_text", "_value", "_roles")
