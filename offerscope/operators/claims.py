"""Answers checked claim by claim against the evidence they cite. Column expressions and joins only.

An answer is cut into claims at lines and sentence ends; a piece that only cites belongs to the claim before. Each claim's numbers are typed
quantities, a canonical number with its unit, and must occur so in the cited evidence (without a unit, the number alone). Its named banks must be those of
the evidence, all cited evidence must be of one offer, and half of its words, two at least, must begin like a word there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.text import fold_text
from offerscope.operators.entities import BANKS

CITED = r"\[(S\d+)\]"
# Units in folded text, and the units of normalised values.
UNITS = {"currency": "tl|try|lira|₺", "percent": "%|yuzde", "month": "ay|aydir|aylik", "year": "yil|yildir|sene", "day": "gun|gundur|gunluk", "count": "adet|kez"}
UNIT_NAMES = {"currency": ("tl", "try", "lira"), "percent": ("%", "percent", "percentage"), "month": ("month", "months", "ay"), "year": ("year", "years", "yil"), "day": ("day", "days", "gun"), "count": ("count", "adet")}
STOP = tuple("aciklanan ait ancak bankasi belirtilmistir bilgi bulunmaktadir finansmani icin ile kaynak olarak olan teklif verilmistir".split())
_NUMBER = r"[-+]?(?:\d{1,3}(?:[. ]\d{3})+(?!\d)(?:,\d+)?|\d+(?:[.,]\d+)*)"
_QUANTITY = rf"(?:(%|(?<!\w)yuzde)\s*)?(?<![\w\]])({_NUMBER})[ ,.;:()\[\]{{}}-]*(?:(%|₺)|({'|'.join(u for u in UNITS.values()).replace('₺|', '').replace('|₺', '').replace('%|', '')})(?!\w))?"
FACTS = "array<struct<value:double,unit:string,currency:string>>"


def canonical_number(text: Column) -> Column:
    """A number as text without group marks and needless zeros: a comma is decimal, several dots or one before three digits group."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    grouped = plain.rlike(r"\..*\.") | plain.rlike(r"^[-+]?\d{1,3}\.\d{3}$")
    no_dots = F.replace(plain, F.lit("."), F.lit(""))
    number = F.when(F.contains(plain, F.lit(",")), F.replace(no_dots, F.lit(","), F.lit("."))).when(grouped, no_dots).otherwise(plain)
    return F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")


def _unit(word: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(word.isin(*words), F.lit(unit)) for unit, words in names.items()))


def quantities(folded: Column) -> Column:
    """The distinct quantities of a folded text as "number:unit"; a number without unit as "number:"."""
    group = lambda i: F.regexp_extract_all(folded, F.lit(_QUANTITY), F.lit(i))
    words = {unit: tuple(ws.split("|")) for unit, ws in UNITS.items()}
    parts = F.arrays_zip(group(1).alias("before"), group(2).alias("number"), group(3).alias("sign"), group(4).alias("word"))

    def said(p: Column) -> Column:
        unit = F.when((p["0"] != "") | (p["2"] == "%"), "percent").when(p["2"] == "₺", "currency").otherwise(_unit(p["3"], words))
        return F.concat(canonical_number(p["1"]), F.lit(":"), F.coalesce(unit, F.lit("")))

    zipped = F.transform(parts, lambda p: F.struct(*(p.getField(n).alias(str(i)) for i, n in enumerate(("before", "number", "sign", "word")))))
    return F.array_distinct(F.array_compact(F.transform(zipped, said)))


def fact_quantities(facts: Column) -> Column:
    """Quantities of normalised values; a value with a currency and no known unit is money."""

    def said(f: Column) -> Column:
        unit = F.coalesce(_unit(fold_text(f["unit"]), UNIT_NAMES), F.when(f["currency"].isNotNull(), F.lit("currency")), F.lit(""))
        return F.concat(F.regexp_replace(f["value"].cast("decimal(38,10)").cast("string"), r"\.?0+$", ""), F.lit(":"), unit)

    return F.array_compact(F.transform(F.coalesce(facts.cast(FACTS), F.array().cast(FACTS)), said))


def heads(folded: Column) -> Column:
    """The first four letters of each distinct content word of a folded text: four letters or more, no stop word, no number."""
    words = F.regexp_extract_all(folded, F.lit(r"\w+"), F.lit(0))
    return F.transform(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP) & ~w.rlike(r"^\d+$"))), lambda w: F.substring(w, 1, 4))


def named_banks(folded: Column, banks: dict[str, tuple[str, ...]]) -> Column:
    return F.array_compact(F.array(*(F.when(folded.rlike("|".join(map(re.escape, aliases))), F.lit(name)) for name, aliases in banks.items())))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim, text): the claims of each answer, from 1."""
    plain = F.regexp_replace("text", r"(?m)^[ \t]*(?:[-*+•]|\d+[.)])\s+", "")
    pieces = F.filter(F.transform(F.split(plain, r"\s*\n\s*|(?<=[.!?])\s+"), F.trim), lambda p: p != "")
    says = lambda p: F.regexp_replace(p, CITED, "").rlike(r"[\wÇĞİÖŞÜçğıöşü]")
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, p: F.when(says(p) | (F.size(acc) == 0), F.concat(acc, F.array(p))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.when(F.size(acc) > 0, last(acc)), p)))))
    rows = answers.select("answer_id", F.posexplode(joined).alias("at", "text"))
    return rows.select("answer_id", (F.col("at") + 1).alias("claim"), "text")


def validate(answers: DataFrame, evidence: DataFrame, banks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(answer_id, claim, issue, detail): what is wrong with each answer, nothing for those that hold; claim 0 is the whole answer.

    answers: answer_id, text. evidence: answer_id, source_id (S1, S2, ...), offer_id, bank, text, and facts (FACTS) if there are any. Issues: missing_citations,
    unknown_citations (of the answer); empty, missing_citation, cross_offer_context, unsupported_numbers (detail: the quantities), bank_context_mismatch,
    unsupported_text (of a claim). Of a claim whose sources are all unknown only that is said. Null answers have missing_citations alone.
    """
    banks = BANKS if banks is None else banks
    cited = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(CITED), F.lit(1)))
    facts = F.col("facts") if "facts" in evidence.columns else F.lit(None).cast(FACTS)
    whole = F.concat_ws(" ", "bank", "text")
    e = evidence.filter("source_id is not null").select("answer_id", "source_id", F.coalesce("offer_id", F.lit("")).alias("offer"), fold_text(whole).alias("f"), fold_text(F.coalesce("bank", F.lit(""))).alias("bank"), facts.alias("facts"))
    e = e.select("answer_id", "source_id", "offer", F.array_union(quantities(F.col("f")), fact_quantities(F.col("facts"))).alias("q"), heads(F.col("f")).alias("h"), named_banks(F.col("bank"), banks).alias("b"))
    e = e.groupBy("answer_id", "source_id").agg(F.collect_set("offer").alias("offers"), F.flatten(F.collect_list("q")).alias("q"), F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("b")).alias("b"))

    own = answers.select("answer_id", F.explode_outer(cited(F.coalesce("text", F.lit("")))).alias("source_id"))
    known = e.select("answer_id", "source_id", F.lit(True).alias("known"))
    of_answer = own.join(known, ["answer_id", "source_id"], "left").groupBy("answer_id").agg(F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("source_id")))).alias("unknown"), F.count("source_id").alias("n"))
    answer_issues = of_answer.select("answer_id", F.lit(0).alias("claim"), F.explode(F.array_compact(F.array(F.when(F.size("unknown") > 0, F.struct(F.lit("unknown_citations").alias("issue"), F.array_join("unknown", ",").alias("detail"))), F.when(F.col("n") == 0, F.struct(F.lit("missing_citations").alias("issue"), F.lit("").alias("detail")))))).alias("i"))

    said = F.regexp_replace("text", CITED, "")
    c = claims(answers).select("answer_id", "claim", cited(F.col("text")).alias("cited"), (~said.rlike(r"[\wÇĞİÖŞÜçğıöşü]")).alias("empty"), fold_text(said).alias("f"))
    c = c.select("answer_id", "claim", "cited", "empty", quantities(F.col("f")).alias("cq"), heads(F.col("f")).alias("ch"), named_banks(F.col("f"), banks).alias("cb"))
    sources = c.select("answer_id", "claim", F.explode("cited").alias("source_id")).join(e, ["answer_id", "source_id"]).groupBy("answer_id", "claim").agg(F.array_distinct(F.flatten(F.collect_list("offers"))).alias("offers"), F.flatten(F.collect_list("q")).alias("q"), F.array_distinct(F.flatten(F.collect_list("h"))).alias("h"), F.flatten(F.collect_list("b")).alias("b"))
    rows = c.join(sources, ["answer_id", "claim"], "left")
    have, numbers = F.col("offers").isNotNull(), F.transform("q", lambda q: F.concat(F.substring_index(q, ":", 1), F.lit(":")))
    missing = F.array_sort(F.filter(F.array_except("cq", "q"), lambda q: ~(q.endswith(":") & F.array_contains(numbers, q))))
    n = F.size("ch")
    supported = F.size(F.filter("ch", lambda h: F.array_contains(F.col("h"), h)))
    need = F.when(n <= 1, n).otherwise(F.greatest(F.lit(2), F.floor((n + 1) / 2)))
    issue = lambda when, name, detail="": F.when(when, F.struct(F.lit(name).alias("issue"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    found = F.array_compact(
        F.array(
            issue(F.col("empty"), "empty"), issue(F.size("cited") == 0, "missing_citation"), issue(have & (F.size("offers") > 1), "cross_offer_context"), issue(have & (F.size(missing) > 0), "unsupported_numbers", F.array_join(missing, ",")),
            issue(have & (F.size(F.array_except("cb", "b")) > 0), "bank_context_mismatch"), issue(have & (supported < need), "unsupported_text"),
        )
    )
    return answer_issues.unionByName(rows.select("answer_id", "claim", F.explode(found).alias("i"))).select("answer_id", "claim", "i.issue", "i.detail")
