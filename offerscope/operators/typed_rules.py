"""Fact rules by product: amounts, ratios, terms, limits, plans, documents, cover and audience.

A rule is a row of RULES. All rules are one array literal that is exploded over each segment, so a segment is folded and read
once. Values are folded text. Columns: the key, at, product, segment, keywords (of the page, see facts.page_keywords).
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.text import fold_text, parse_number

# Product codes, patterns and cues on folded text.
FINANCE = ("DIGER_FINANSMAN", "FINANSMAN", "IHTIYAC_FINANSMANI", "KONUT_FINANSMANI", "TASIT_FINANSMANI", "TICARI_FINANSMAN")
INVESTMENT = ("HESAP_YATIRIM", "KATILMA_HESABI", "YATIRIM_URUNU")
INSURANCE = ("SIGORTA_TEKAFUL", "SIGORTA_TEKAFUL_URUNU")
PAYMENT = ("ODEME_TRANSFER", "ODEME_TRANSFER_HIZMETI")
AMOUNT = r"\b\d[\d. ]*(?:,\d+)?\s*(?:tl|try|turk lirasi)\b"
PERCENT = r"%\s*\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\s*%"
DURATION = r"\b\d{1,4}\s*(?:ay|yil|gun)(?:a|e|lik|luk)?\b"
SHARING = r"\b\d{1,3}\s*/\s*\d{1,3}\b"
TERM = r"\bvade(?:si|de|ye|ler|li|yle)?\b"
OFFERED = "finansman tutari|finansman limiti|kar payi|vade secenegi|vade olanagi|vade imkani"
OPERATION = "islem|eft|fast|havale|transfer|alim satim"
PLAN = r"\besnek odeme plani\b|\bodeme plani\b|\bartan taksit(?:li)?\b|\bazalan taksit(?:li)?\b|\bara odeme(?:li)?\b|\besit taksit(?:li)?\b"
AUDIENCE = (
    r"\bbireysel musteriler(?:imiz|e|in)?\b|\bticari musteriler(?:imiz|e|in)?\b|\bkobi(?:ler|lere|lerimiz)?\b|\besnaf(?:lar|lara)?\b|\bciftci(?:ler|lere)?\b|\bogrenci(?:ler|lere)?\b|"
    r"\bemekli(?:ler|lere)?\b|\bkamu calisanlari\b|\bkadin girisimci(?:ler|lere)?\b|\bgirisimci(?:ler|lere)?\b|\bisletme(?:ler|lere)?\b|\bureticiler\b|\bihracatci(?:lar|lara)?\b|"
    r"\barac sahipleri\b|\bkonut sahipleri\b|\bmaas musterileri\b"
)
SERVED = "yararlan|faydalan|yonelik|musterilere sun|musteriler icin sun"


@dataclass(frozen=True)
class Rule:
    fact_type: str
    products: tuple[str, ...]  # none: all
    value: str | None  # None: the whole segment
    cues: tuple[str, ...]  # all must occur in the segment
    confidence: float
    near: tuple[str, int] | None = None  # must occur in the radius of the value
    apart: tuple[str, int] | None = None  # must not
    relevant: str | None = None  # the segment must hold a keyword of its page, or this pattern ("": no pattern helps)
    most: int = 10**6  # characters of a segment
    without: str | None = None  # must not occur in the segment


RULES = (
    Rule("FINANSMAN_TUTARI", FINANCE, AMOUNT, ("finansman tutari|azami finansman|finansman limiti",), 0.97, relevant=OFFERED),
    Rule("FINANSMAN_ORANI", FINANCE, PERCENT, ("finansman orani|finanse edilebil",), 0.97, relevant=OFFERED),
    Rule("KAR_PAYI_ORANI", FINANCE, PERCENT, ("kar payi|kar orani",), 0.97, relevant=OFFERED),
    Rule("VADE_SURESI", FINANCE, DURATION, (TERM,), 0.96, ("vade", 36), ("odemesiz donem|erteleme suresi", 30), OFFERED),
    Rule("MINIMUM_BAKIYE", INVESTMENT, AMOUNT, ("bakiye|hesap acilis", "minimum|asgari|en az"), 0.97),
    Rule("KAR_PAYLASIM_ORANI", INVESTMENT, SHARING, ("kar paylasim",), 0.98),
    Rule("VADE_SURESI", INVESTMENT, DURATION, (TERM, "hesap ac|hesabi ac|katilma hesabi|vadeli hesap"), 0.96, ("vade", 36), relevant=""),
    Rule("ISLEM_ALT_LIMITI", INVESTMENT + PAYMENT, AMOUNT, (OPERATION, "minimum islem|asgari islem|en az islem tutari|islem alt limiti|alt limit"), 0.96),
    Rule("ISLEM_UST_LIMITI", INVESTMENT + PAYMENT, AMOUNT, (OPERATION, "maksimum islem|azami islem|en fazla islem tutari|islem ust limiti|ust limit"), 0.96),
    Rule("SIGORTA_UCRETI", INSURANCE, AMOUNT, ("sigorta primi|tekaful primi|sigorta ucreti",), 0.97),
    Rule("ODEME_PLANI", FINANCE, PLAN, (), 0.95, relevant="nakit akis|finansman|taksit"),
    Rule("ODEMESIZ_DONEM", FINANCE, DURATION, ("odemesiz donem",), 0.96, ("odemesiz donem", 30)),
    Rule("GEREKLI_BELGELER", FINANCE, None, ("gerekli belge|belgeler", "nufus|kimlik|gelir belgesi|bordro|tapu|ruhsat|fatura"), 0.93, relevant="", most=240),
    Rule("MEVDUAT_GUVENCESI", INVESTMENT, r"\btmsf\b|\btasarruf mevduati sigorta fonu\b", ("guvence|sigorta|kapsam",), 0.98),
    Rule("TEMINAT", INSURANCE, None, ("teminat", "kapsar|kapsam|guvence|vefat|maluliyet"), 0.93, most=240),
    Rule("SIGORTA_KOSULU", FINANCE + INSURANCE, None, ("sigorta|tekaful|dask", "zorunlu|istege bagli|dahil|yaptiril"), 0.93, most=240),
    Rule("HEDEF_KITLE", (), AUDIENCE, (SERVED,), 0.92, (SERVED, 72), relevant=""),
)


def _around(text: Column, value: Column, radius: int) -> Column:
    place = F.instr(text, value)
    start = F.greatest(place - radius, F.lit(1))
    return F.substring(text, start, place + F.length(value) + radius - start)


def _has_near(text: Column, cue: str, radius: int, wanted: bool = True) -> Callable[[Column], Column]:
    return lambda value: _around(text, value, radius).rlike(cue) == F.lit(wanted)


def _fact(rule: Rule, ordinal: int) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(rule.fact_type).alias("fact_type"), value.alias("fact_text"), F.lit(rule.confidence).alias("confidence"), F.lit(ordinal).alias("ordinal"))


def typed_rules(rows: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", more: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, at, fact_type, fact_text, evidence, confidence, ordinal) of the rules, distinct for each segment and rule.

    A page without keywords takes every segment as relevant; null segments have no facts; a null product only those of all products.
    `more` gives further facts of the folded segment in the same pass: an array of structs (fact_type, fact_text, confidence, ordinal).
    """
    text = F.col("_text")
    own = F.coalesce((F.size("keywords") <= 0) | F.exists("keywords", lambda k: F.contains(text, k)), F.lit(True)) if "keywords" in rows.columns else F.lit(True)
    found = []
    for i, r in enumerate(rules):
        ok = F.length("segment") <= r.most
        for cue in r.cues:
            ok = ok & text.rlike(cue)
        if r.without:
            ok = ok & ~text.rlike(r.without)
        if r.products:
            ok = ok & F.col("product").isin(*r.products)
        if r.relevant is not None:
            ok = ok & ((F.col("_own") | text.rlike(r.relevant)) if r.relevant else F.col("_own"))
        values = F.regexp_extract_all(text, F.lit(r.value), F.lit(0)) if r.value else F.array(text)
        if r.near:
            values = F.filter(values, _has_near(text, *r.near))
        if r.apart:
            values = F.filter(values, _has_near(text, *r.apart, wanted=False))
        found.append(F.when(ok, F.transform(F.array_distinct(values), _fact(r, i))))
    if more:
        found.append(more(text))
    read = rows.withColumn("_text", fold_text("segment")).withColumn("_own", own)
    out = read.select(key, "at", F.col("segment").alias("evidence"), F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("f"))
    return out.select(key, "at", "f.fact_type", "f.fact_text", "evidence", "f.confidence", "f.ordinal")


def sharing_ratio(value: Column) -> Column:
    """struct(customer, bank) of a ratio a/b."""
    parts = F.split(value, "/")
    return F.struct(parse_number(F.get(parts, 0)).alias("customer"), parse_number(F.get(parts, 1)).alias("bank"))
