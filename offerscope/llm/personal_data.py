"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame expressions only.

High-recall generators (regular expressions that read a text once) propose spans, which may overlap. Places come from the lengths of the pieces
between matches, summed in blocks of the square root of their number, so long texts with many matches stay cheap. E-mail
addresses, IP addresses, card numbers (Luhn) and international phone numbers that pass their fixed checks are base spans and always stay. All
other candidates (written-out addresses, national phone numbers, shorter or failing digit chains, account and identity numbers) get
features of their format and of the text around them, and a score by boosted trees, which are a column expression.

The trees are fitted here. Labels come by construction: CARRIERS documents, taken by hash of their ids, lend a few words of context, into which each
template of TEMPLATES plants a value whose digits come from a hash, with a fitting, a misleading or no cue before it. The generators run over these
rows as over any text; a candidate counts as positive if it is the planted value of a positive template of its own kind. A quarter of the
carriers is held out; on it each kind's threshold is calibrated as the least score from which precision is PRECISION or more. A kind that never
reaches it adds nothing. At most CARRIERS x (templates) rows of numbers reach the driver.

Of overlapping accepted spans the one with the higher score stays (then the longer, then the earlier); none that overlaps a base span is added.

Defined results: null and empty texts have no spans (counts 0, the digest of the empty string); a null doc_id is kept; repeated rows are each
scanned; offsets count code points, end exclusive; texts of any length are scanned whole; other columns, whatever their names, are ignored; an empty table gives an empty result,
and without carriers no spans are added to the base ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.llm.quality_gbdt import Trees, fit

CARRIERS = 400
PRECISION = 0.99
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_like", "phone_like", "card_like", "id_like")
KINDS = BASE_KINDS + ADDED_KINDS
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A match begins where a run begins or the last match ended, so a text is read once.
GENERATORS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "chain": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "written": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:\x20?(?:\(at\)|\[at\]|@)\x20?|\x20at\x20){_LABEL}{{1,63}}+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z]{{2,24}}+){{1,4}}+",
    "national": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])(?:[0-9]{2,5}[\x20.-]){0,3}[0-9]{2,5}(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What any match holds; texts without it are not searched.
_HOLDS = {"email": "@", "ip": ".", "phone": "+", "social": "-"}
_WRITTEN = ("@", "(at)", "[at]", " at ")
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: generators whose candidates that are no base spans get a score, and their kinds
SCORED = {"written": "email_like", "national": "phone_like", "chain": "card_like", "account": "id_like", "social": "id_like"}
CUES = {
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp)[a-z]{0,6}[.:]?\s*$",
    "mail": r"(?i)(?:mail|contact|write to|reach me)[a-z]{0,4}[.:]?\s*$",
    "card": r"(?i)(?:card|visa|amex|mastercard|pan)(?: no| number)?[.:]?\s*$",
    "account": r"(?i)(?:iban|account|acct|bank|ssn|social security|passport|tax id|id)(?: no| number)?[.:]?\s*$",
    "other": r"(?i)(?:order|invoice|version|isbn|issn|token|secret|key|ref|page|serial|sku|build|hash|no|lot|code)[.:#=]?\s*[\"']?$|[#$€£]\s*$",
}
FEATURES = (
    "generator", "length", "digits", "letters", "others", "groups", "first_group", "last_group", "luhn", "check97", "spaces", "dots", "dashes", "brackets", "zero_first", "at_sign", "date", "isbn",
    "cue_phone", "cue_mail", "cue_card", "cue_account", "cue_other", "touches_before", "touches_after", "set_before", "money_after", "digit_near",
)


def _size(c: Column, pattern: str) -> Column:
    """How many characters are in a class."""
    return F.length(F.regexp_replace(c, f"[^{pattern}]", ""))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def _gate(generator: str) -> Column:
    """Whether a text can hold a match; needs columns text, _digit and _low."""
    if generator == "written":
        return F.greatest(*(F.contains("_low", F.lit(x)) for x in _WRITTEN))
    own = F.contains("text", F.lit(_HOLDS[generator])) if generator in _HOLDS else F.lit(True)
    return own if generator == "email" else own & F.col("_digit")


def _pieces(hits: str, gaps: str) -> Column:
    """Each match with the length of the text since the last one, and what stands around it."""

    def piece(t: Column, i: Column) -> Column:
        gap = F.get(F.col(gaps), i)
        return F.struct(F.length(gap).alias("gap"), t.alias("text"), F.substring(gap, -24, 24).alias("before"), F.substring(F.get(F.col(gaps), i + 1), 1, 8).alias("after"))

    return F.when(F.size(hits) > 0, F.transform(hits, piece))


_SPAN = "array<struct<start:int,text:string,before:string,after:string>>"


def _blocks(pieces: Column) -> Column:
    """Places within each block of pieces, and the block's length."""
    k = F.size(pieces)
    b = F.ceil(F.sqrt(k)).cast("int")

    def place(acc: Column, p: Column) -> Column:
        at = acc.at + p.gap
        return F.struct((at + F.length(p.text)).alias("at"), F.concat(acc.out, F.array(F.struct(at.alias("start"), p.text.alias("text"), p.before.alias("before"), p.after.alias("after")))).alias("out"))

    one = lambda i: F.aggregate(F.slice(pieces, i * b + 1, b), F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), place)
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), F.floor((k - 1) / b).cast("int")), one))


def _located(blocks: Column) -> Column:
    """Start, end, text and surroundings of all matches, in order."""
    offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc.at + x.at).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))).out
    moved = lambda x, o: F.transform(x.out, lambda s: F.struct((s.start + o).alias("start"), (s.start + o + F.length(s.text)).alias("end"), s.text.alias("text"), s.before.alias("before"), s.after.alias("after")))
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    return F.coalesce(F.flatten(F.zip_with(blocks, offsets, moved)), none)


def generated(rows: DataFrame) -> DataFrame:
    """Adds a column of located matches for each generator to rows with a column `text`."""
    kept = rows.columns
    out = rows.select(*kept, F.col("text").rlike("[0-9]").alias("_digit"), F.lower("text").alias("_low"))
    out = out.select(*kept, *(F.when(_gate(g), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"_h_{g}") for g, p in GENERATORS.items()))
    out = out.select(*kept, *(f"_h_{g}" for g in GENERATORS), *(F.when(F.size(f"_h_{g}") > 0, F.split("text", p, -1)).alias(f"_g_{g}") for g, p in GENERATORS.items()))
    out = out.select(*kept, *(_pieces(f"_h_{g}", f"_g_{g}").alias(f"_p_{g}") for g in GENERATORS))
    out = out.select(*kept, *(_blocks(F.col(f"_p_{g}")).alias(f"_b_{g}") for g in GENERATORS))
    return out.select(*kept, *(_located(F.col(f"_b_{g}")).alias(g) for g in GENERATORS))


def _card(c: Column) -> Column:
    return _count(c.text).between(16, 19) & _luhn(F.regexp_replace(c.text, "[^0-9]", ""))


def base_spans() -> dict[str, Column]:
    """Spans that pass the fixed checks, by kind, each by start."""
    return {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda c: c.text.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")),
        "card": F.filter("chain", _card),
        "phone": F.filter("phone", lambda c: _count(c.text).between(8, 15)),
    }


def _mod97(text: Column) -> Column:
    """The number of an account number, its first four characters last and letters as two digits, modulo 97."""
    plain = F.upper(F.regexp_replace(text, " ", ""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    digit = lambda ch: F.ascii(ch) - F.when(ch >= "A", 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(F.length(ch) == 0, acc).otherwise((acc * F.when(ch >= "A", 100).otherwise(10) + digit(ch)) % 97))


def _features(c: Column, generator: str) -> Column:
    """FEATURES of a candidate as an array of doubles."""
    t, digits = c.text, F.regexp_replace(c.text, "[^0-9]", "")
    value = {
        "generator": F.lit(list(SCORED).index(generator)),
        "length": F.length(t),
        "digits": F.length(digits),
        "letters": _size(t, "A-Za-z"),
        "others": _size(t, "()\\[\\]@+"),
        "groups": F.length(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "#"), "[^#]", "")),
        "first_group": F.length(F.regexp_extract(t, "^[^0-9]*([0-9]+)", 1)),
        "last_group": F.length(F.regexp_extract(t, "([0-9]+)[^0-9]*$", 1)),
        "luhn": _luhn(digits) & (F.length(digits) > 8),
        "check97": (_mod97(t) == 1) if generator == "account" else F.lit(False),
        "spaces": _size(t, " "),
        "dots": _size(t, "."),
        "dashes": _size(t, "\\-"),
        "brackets": _size(t, "(\\["),
        "zero_first": t.rlike(r"^[(]?0"),
        "at_sign": t.contains("@"),
        "date": t.rlike(r"^(?:(?:19|20)\d\d[ .-][0-3]?\d[ .-][0-3]?\d|[0-3]?\d[ .-][01]?\d[ .-](?:19|20)\d\d)\b|^(?:19|20)\d\d[ -](?:19|20)\d\d$"),
        "isbn": t.rlike(r"^97[89]"),
        "cue_phone": c.before.rlike(CUES["phone"]),
        "cue_mail": c.before.rlike(CUES["mail"]),
        "cue_card": c.before.rlike(CUES["card"]),
        "cue_account": c.before.rlike(CUES["account"]),
        "cue_other": c.before.rlike(CUES["other"]),
        "touches_before": c.before.rlike(r"[A-Za-z0-9_/.-]$"),
        "touches_after": c.after.rlike(r"^[A-Za-z0-9_/-]"),
        "set_before": c.before.rlike(r"[=:]\s*[\"']?$"),
        "money_after": c.after.rlike(r"^\s?(?:%|€|\$|£|[A-Z]{3}\b|[a-z]{1,2}\b)"),
        "digit_near": c.before.rlike(r"[0-9]\W{1,3}$") | c.after.rlike(r"^\W{1,3}[0-9]"),
    }
    return F.array(*(value[f].cast("double") for f in FEATURES))


def _with_features(generator: str, kind: int):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c.start.alias("start"), c.end.alias("end"), _features(c, generator).alias("x"))


def candidates() -> Column:
    """All spans that get a score: kind (place in KINDS), start, end, x (features)."""
    parts = []
    for g, kind in SCORED.items():
        own = F.col(g)
        if g == "chain":
            own = F.filter(own, lambda c: ~_card(c))
        if g == "national":
            own = F.filter(own, lambda c: _count(c.text).between(7, 15))
        parts.append(F.transform(own, _with_features(g, KINDS.index(kind))))
    return F.concat(*parts)


@dataclass
class Model:
    """The trees and each added kind's least margin."""

    trees: Trees
    least: dict[str, float]

    def margin(self, x: str) -> str:
        """The sum of all trees as one SQL expression over an array of features."""
        t = self.trees

        def node(i: int) -> str:
            if t.left[i] == i:
                return f"{float(t.value[i])!r}D"
            return f"CASE WHEN get({x}, {t.feature[i]}) <= {float(t.threshold[i])!r}D THEN {node(t.left[i])} ELSE {node(t.right[i])} END"

        return " + ".join([f"{float(t.base)!r}D", *map(node, t.roots)])


# What is planted. # is a random digit, ~ a random word (^ with a capital), ? a digit that makes the whole pass Luhn, ! one
# that makes it fail, && the check digits of an account number; kinds of None are planted as negatives.
TEMPLATES = (
    ("phone_like", "(###) ###-####"), ("phone_like", "###-###-####"), ("phone_like", "### ### ####"), ("phone_like", "0### ### ## ##"), ("phone_like", "00## ### ### ####"), ("phone_like", "###.###.####"), ("phone_like", "0##-####-####"),
    ("email_like", "~.~ at ~ dot com"), ("email_like", "~ at ~ dot org"), ("email_like", "~ [at] ~ [dot] net"), ("email_like", "~(at)~.com"), ("email_like", "~ @ ~.org"), ("email_like", "~## (at) ~ dot ~ dot edu"),
    ("card_like", "34## ###### ###?"), ("card_like", "37##-######-####?"), ("card_like", "36###########?"), ("card_like", "30## ###### ###?"),
    ("id_like", "DE&& #### #### #### #### ##"), ("id_like", "FR&&####################"), ("id_like", "TR&& #### #### #### #### #### ##"), ("id_like", "###-##-####"),
    (None, "97#-#-##-######-#"), (None, "20##-0#-1#"), (None, "1#.0#.20##"), (None, "19##-20##"), (None, "#.##.###"), (None, "# ### ### ###"), (None, "###-#######-#######"), (None, "###########"), (None, "###############!"), (None, "#### #### #### ###!"),
    (None, "##.#### #.####"), (None, "##### #####"), (None, "af#############be##"), (None, "~ at ~.^"), (None, "~ at ~. ^"), (None, "~ at ~ dot"), (None, "AB## #### #### ####"), (None, "XY##-####-####"), (None, "### ### ### ### ###"), (None, "##-##-## ##"), (None, "####-####"),
)
# Cues before a planted value, by what they announce.
SAID = {"phone_like": ("phone: ", "call ", "tel. "), "email_like": ("mail: ", "contact ", "write to "), "card_like": ("card number: ", "amex ", "card no. "), "id_like": ("IBAN: ", "SSN: ", "account number: "), None: ("order ", "ref: ", "version ", "token = \"", "ISBN ", "page ", "code: ", "no. ")}


def _passes(stem: Column, good: bool):
    return lambda c: _luhn(F.concat(stem, c)) == F.lit(good)


def _one(cues: tuple[str, ...], hashed: Column) -> Column:
    return F.get(F.array(*map(F.lit, cues)), F.pmod(hashed, F.lit(len(cues))).cast("int"))


def planted(docs: DataFrame) -> DataFrame:
    """Rows of carrier, kind, start, end and text: words of a document with a template's value among them."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("carrier"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(key, "doc_id").limit(CARRIERS)
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    hashed = lambda *c: F.xxhash64("doc_id", *map(F.lit, c))
    words = carried.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.length(w).between(1, 40)).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("i", F.pmod(hashed("place"), F.size("w")).cast("int"))
    before, after = F.slice("w", F.greatest(F.lit(1), F.col("i") - 5), F.least(F.lit(6), F.col("i"))), F.slice("w", F.col("i") + 1, F.lit(6))
    drawn = []
    for n, (kind, form) in enumerate(TEMPLATES):
        digits = F.concat(*(F.lpad(F.pmod(hashed(n, k), F.lit(10**12)).cast("string"), 12, "0") for k in range(3)))
        parts, at, said = [], 0, 0
        for ch in re.findall(r"#+|[~^]|[^#~^]+", form):
            if ch[0] == "#":
                parts.append(F.substring(digits, at + 1, len(ch)))
                at += len(ch)
            elif ch in "~^":
                word = F.lower(F.regexp_replace(F.get(F.col("w"), F.pmod(hashed(n, "w", said), F.size("w")).cast("int")), "[^A-Za-z]", ""))
                word = F.coalesce(F.nullif(word, F.lit("")), F.lit("abel"))
                parts.append(F.initcap(word) if ch == "^" else word)
                said += 1
            else:
                parts.append(F.lit(ch))
        made = F.concat(*parts)
        if form[-1] in "?!":  # the last digit
            stem = F.substring(made, 1, len(form) - 1)
            fits = F.filter(F.array(*map(F.lit, "0123456789")), _passes(F.regexp_replace(stem, "[^0-9]", ""), form[-1] == "?"))
            made = F.concat(stem, F.get(fits, F.lit(0)))
        if "&&" in form:
            head, tail = F.substring(made, 1, 2), F.substring(made, 5, 100)
            made = F.concat(head, F.lpad((98 - _mod97(F.concat(head, F.lit("00"), tail))).cast("string"), 2, "0"), tail)
        fitting, misleading = SAID[kind], SAID[None] if kind else SAID["phone_like"]
        pick = F.pmod(hashed(n, "cue"), F.lit(8))
        cue = F.when(pick < 4, _one(fitting, hashed(n, "which"))).when(pick < 5, _one(misleading, hashed(n, "which")) if kind is None else F.lit("")).otherwise("")
        drawn.append(F.struct(F.lit(kind).cast("string").alias("kind"), cue.alias("cue"), made.alias("made")))
    rows = words.select("doc_id", F.array_join(before, " ").alias("b"), F.array_join(after, " ").alias("a"), F.explode(F.array(*drawn)).alias("p"))
    head = F.concat("b", F.lit(" "), "p.cue")
    return rows.select("doc_id", "p.kind", F.length(head).alias("from"), (F.length(head) + F.length("p.made")).alias("to"), F.concat(head, "p.made", F.lit(" "), "a").alias("text"))


def train(docs: DataFrame) -> Model:
    """Fits the trees and calibrates the thresholds on planted values."""
    rows = generated(planted(docs)).select("doc_id", "kind", "from", "to", F.explode(candidates()).alias("c"))
    own = F.array(*map(F.lit, KINDS))
    hit = F.coalesce((F.get(own, F.col("c.kind")) == F.col("kind")) & (F.col("c.start") == F.col("from")) & (F.col("c.end") == F.col("to")), F.lit(False))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    got = sorted(tuple(r) for r in rows.select(held.alias("held"), F.col("c.kind"), hit.cast("int").alias("hit"), "c.x").collect())
    if not got:
        return Model(fit(np.zeros((0, len(FEATURES))), np.zeros(0)), {})
    out = np.array([r[0] for r in got])
    kind, y, x = np.array([r[1] for r in got]), np.array([r[2] for r in got], float), np.array([r[3] for r in got], float)
    trees = fit(x[~out], y[~out], trees=40, depth=4, rate=0.3, bins=32, least=2.0)
    return Model(trees, calibrated(trees.margin(x[out]), y[out], kind[out]))


def calibrated(margin: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict[str, float]:
    """The least margin of each kind from which the precision of all held-out candidates above is PRECISION or more, at least 0."""
    least = {}
    for k in ADDED_KINDS:
        mine = kind == KINDS.index(k)
        order = np.argsort(-margin[mine], kind="stable")
        m, right = margin[mine][order], np.cumsum(y[mine][order])
        last = np.append(m[1:] != m[:-1], True) if len(m) else np.zeros(0, bool)
        good = np.flatnonzero(last & (right / np.arange(1, len(m) + 1) >= PRECISION) & (m > 0))
        if len(good) and right[good[-1]] >= 10:
            least[k] = float(m[good[-1]])
    return least


def _added(model: Model) -> Column:
    """Accepted candidates that overlap no base span and no better one, by kind and start; needs columns of base kinds and `_c`."""
    empty = F.array().cast("array<struct<start:int,end:int,margin:double,kind:int>>")
    if not model.least:
        return empty
    enough = lambda c: F.coalesce(*(F.when(c.kind == KINDS.index(k), c.margin >= least) for k, least in model.least.items()), F.lit(False))
    mine = F.filter(F.expr(f"transform(_c, c -> struct(c.start AS start, c.`end` AS `end`, {model.margin('c.x')} AS margin, c.kind AS kind))"), enough)
    fixed = F.concat(*(F.transform(f"base_{k}", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(float("inf")).alias("margin"), F.lit(-1).alias("kind"))) for k in BASE_KINDS))

    def step(acc: Column, s: Column) -> Column:
        apart = acc.cur.isNull() | (s.start >= acc.cur.end)
        better = (s.margin > acc.cur.margin) | ((s.margin == acc.cur.margin) & ((s.end - s.start > acc.cur.end - acc.cur.start) | ((s.kind < 0) & (s.end > acc.cur.end))))
        return F.struct(F.when(apart | better, s).otherwise(acc.cur).alias("cur"), F.when(apart & acc.cur.isNotNull(), F.concat(acc.out, F.array(acc.cur))).otherwise(acc.out).alias("out"))

    swept = F.aggregate(F.array_sort(F.concat(mine, fixed)), F.struct(F.lit(None).cast("struct<start:int,end:int,margin:double,kind:int>").alias("cur"), empty.alias("out")), step, lambda acc: F.when(acc.cur.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(acc.cur))))
    return F.when(F.size(mine) > 0, F.filter(swept, lambda s: s.kind >= 0)).otherwise(empty)


def _of(kind: str | int):
    return lambda s: s.kind == kind


def find_personal(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (base and added), arrays of kind, start and end by kind as listed in KINDS, then start.

    Without a model it is fitted on the same documents. `keep` names further columns to carry along.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)))
    model = model or train(rows.select("doc_id", "text"))
    carried = [f"keep_{i}" for i in range(len(keep))]
    base = base_spans()
    out = generated(rows).select("doc_id", *carried, *(base[k].alias(f"base_{k}") for k in BASE_KINDS), candidates().alias("_c"))
    out = out.select("doc_id", *carried, *(f"base_{k}" for k in BASE_KINDS), _added(model).alias("_added"))
    named = lambda k, spans: F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    fixed = F.concat(*(named(k, F.col(f"base_{k}")) for k in BASE_KINDS))
    more = F.concat(*(named(k, F.filter("_added", _of(KINDS.index(k)))) for k in ADDED_KINDS))
    return out.select("doc_id", fixed.alias("base"), F.concat(fixed, more).alias("spans"), *(F.col(c).alias(k) for c, k in zip(carried, keep, strict=True)))


def said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))


def redact_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and text with each stretch of overlapping spans replaced by the kind of its first span in brackets."""
    found = find_personal(docs, model, keep=("text",))
    step = lambda acc, s: F.when(s.start >= acc.at, F.struct(s.end.alias("at"), F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit("["), s.kind, F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    masked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")).alias("text"))
