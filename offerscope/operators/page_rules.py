"""Fact rules by title and campaign, rewards and periods of pages, weak labels, and the facts of a snapshot without repeats."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.functions.text import MONTHS, fold_text, ordered_dates, parse_number
from offerscope.operators import roles
from offerscope.operators.typed_rules import FINANCE, INSURANCE, INVESTMENT, PAYMENT, Rule, typed_rules

# By fact type of a title, its products and patterns on the folded title.
CARDS = ("KART", "KART_URUNU")
TITLES = {
    "FINANSMAN_AMACI": (FINANCE, (
        r"\begitim finansmani\b", r"\bhac ve umre finansmani\b", r"\bdayanikli tuketim finansmani\b", r"\bdogal ?gaz donusum finansmani\b", r"\balisveris finansmani\b", r"\btatil(?:iniz)?(?: icin)?\b", r"\bkira odeyen hesap\b",
        r"\baidat odeyen hesap\b", r"\bkonut finansman(?:i|lari)\b", r"\barsa finansmani\b", r"\bis yeri finansmani\b", r"\b(?:arac|tasit) finansman(?:i|lari)\b", r"\btarim(?: ve hayvancilik)? finansman(?:i|lari)\b",
    )),
    "FINANSMAN_TURU": (FINANCE, (
        r"\bmikro finansman\b", r"\bisletme finansmani\b", r"\btedarikci finansman(?:i| sistemi)?\b", r"\bithalat finansman(?:i|lari)\b", r"\bihracat finansman(?:i|lari)\b", r"\bdis ticaret finansman(?:i|lari)\b",
        r"(?<!gayri )\bnakdi finansman(?: urunleri)?\b", r"\bgayri ?nakdi finansman(?: urunleri|lar)?\b", r"\bfinansal kiralama(?:lar)?\b", r"\bleasing\b", r"\bteminat mektup(?:lari)?\b",
    )),
    "YATIRIM_ARACI": (INVESTMENT, (
        r"\bdoviz(?: ve)?(?: kiymetli maden)? alim[ -]?satim(?:i)?\b", r"\bkiymetli maden alim[ -]?satim(?:i)?\b", r"\byatirim fon(?:u|lari)\b", r"\bhisse senedi(?: islemleri)?\b", r"\bkira sertifika(?:si|lari)\b", r"\bsukuk\b",
        r"\bforward(?: islemleri)?\b", r"\belektronik urun senedi\b", r"\belus\b", r"\bkatilma hesap(?:i|lari)\b", r"\baltin hesabi\b", r"\bgumus hesabi\b", r"\byatirim hesabi\b",
    )),
    "KART_TURU": (CARDS, (r"\bkredi karti\b", r"\bbanka karti\b", r"\bsanal kart\b", r"\bticari kart(?:lar)?\b", r"\bdebit\b", r"\bhicaz kart\b", r"\beflatun kart(?:lar)?\b", r"\bbiz kart\b")),
    "SIGORTA_TURU": (INSURANCE, (r"\bhayat sigorta(?:si|lari)\b", r"\bferdi kaza(?: katilim)? sigortasi\b", r"\bdask\b", r"\bkonut sigortasi\b", r"\barac sigortasi\b", r"\byesil kart sigortasi\b", r"\btekaful\b")),
    "ODEME_HIZMETI": (PAYMENT, (r"\bfast\b", r"\beft\b", r"\bhavale\b", r"\bswift\b", r"\bpos(?: hizmetleri)?\b", r"\bbkm express\b", r"\bmail order\b", r"\bdbs\b", r"\bnakit yonetimi\b")),
}
TITLE_RULES = tuple(Rule(kind, products, pattern, (), 0.99, without="sigorta" if products == FINANCE else None) for kind, (products, patterns) in TITLES.items() for pattern in patterns)

# Products, dates and cues of campaigns, on folded text; fact type and confidence by role.
CAMPAIGN = ("ALISVERIS_PUANI", "DIGER_KAMPANYA", "KART", "KART_KAMPANYASI", "YENI_MUSTERI")
_DAY, _MONTH, _TO = r"\d{1,2}[./-]\d{1,2}[./-]20\d{2}", "|".join(MONTHS), r"\s*(?:-|–|—|ile|ve)\s*"
RANGES = (rf"\b{_DAY}{_TO}{_DAY}\b", rf"\b\d{{1,2}}\s+(?:{_MONTH})(?:\s+20\d{{2}})?{_TO}\d{{1,2}}\s+(?:{_MONTH})(?:\s+20\d{{2}})?\b")
ONE_DAY = rf"\b{_DAY}\b|\b\d{{1,2}}\s+(?:{_MONTH})\s+20\d{{2}}\b"
ELIGIBLE = "kampanyadan yararlan|yararlanabilmek icin|faydalanabilmek icin|kampanya kosulu|kampanya sarti"
DEMANDS = "gerekm|yeter|olmal|yararlanamay|zorunlu|verilmesi|yapilmasi|kullanmaniz|gerceklestiril"
CAMPAIGN_RULES = (
    *(Rule("KAMPANYA_TARIH_ARALIGI", CAMPAIGN, p, (), 0.99) for p in RANGES),
    Rule("BASVURU_SON_TARIHI", CAMPAIGN, ONE_DAY, ("son basvuru",), 0.98),
    Rule("TAKSIT_SAYISI", CAMPAIGN, r"\b\d{1,3}\s*taksit\b", (), 0.97),
    Rule("UYGUNLUK_KOSULU", CAMPAIGN, None, (ELIGIBLE, DEMANDS), 0.91, most=240),
)
AMOUNT_FACTS = {"discount": ("INDIRIM_TUTARI", 0.96), "reward": ("ODUL_TUTARI", 0.96), "spend_threshold": ("HARCAMA_ESIGI", 0.97)}
PERCENT_FACTS = {"discount": ("INDIRIM_ORANI", 0.97, CAMPAIGN), "finance": ("KAR_PAYI_ORANI", 0.97, ("DIGER_KAMPANYA",))}


def title_rules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts that the page title names, by product, as `typed_rules` gives them (columns key, product, title); null titles have none."""
    return typed_rules(docs.select(key, F.lit(0).alias("at"), "product", F.col("title").alias("segment")), TITLE_RULES, key)


def campaign_rules(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Periods, deadlines, rates, rewards, discounts, thresholds, instalments and conditions of campaign products' segments.

    Columns key, at, product, segment; values are folded; distinct for each segment and type of amount.
    """
    first = len(CAMPAIGN_RULES)

    def by_role(found: Column, table: dict, ordinal: int) -> Column:
        def fact(m: Column) -> Column:
            kind, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
            for role, (name, confidence, *products) in table.items():
                ok = (m["role"] == role) & F.col("product").isin(*(products[0] if products else CAMPAIGN))
                kind, sure = F.coalesce(kind, F.when(ok, F.lit(name))), F.coalesce(sure, F.when(ok, F.lit(confidence)))
            return F.struct(kind.alias("fact_type"), m["said"].alias("fact_text"), sure.alias("confidence"), F.lit(ordinal).alias("ordinal"))

        return F.array_distinct(F.filter(F.transform(found, fact), lambda f: f["fact_type"].isNotNull()))

    def more(text: Column) -> Column:
        amounts = by_role(roles.with_amount_roles(text, roles.matches(text, roles.AMOUNT)), AMOUNT_FACTS, first)
        percents = by_role(roles.with_percent_roles(text, roles.matches(text, roles.PERCENT)), PERCENT_FACTS, first + 1)
        return F.when(F.col("product").isin(*CAMPAIGN), F.concat(percents, amounts))

    return typed_rules(rows, CAMPAIGN_RULES, key, more)


# Rewards in points and the words that make dates a campaign's period or its end, on folded text.
POINTS = r"(?<!\d)(\d+(?:[. ]\d{3})*(?:,\d+)?)\s*tl\s*(?:['’]?\s*(?:ye|ya)\s+varan\s+)?(world\s*puan|worldpuan|altin\s*puan|bonus\s*puan|alisveris\s*puani)(?!\w)"
POINT_NAMES = {"world": "Worldpuan", "altin": "Altin Puan", "bonus": "Bonus Puan", "": "Alisveris Puani"}
PERIOD = "kampanya araligi|baslangic ve bitis|tarihleri arasinda|tarihlerinde gecerli|tarihleri boyunca gecerli"
ENDS = "tarihine kadar gecerli|tarihine dek gecerli|kampanya bitis|son katilim tarihi"
EVERY = "tum kampanyalar"


def reward_and_period_facts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, at, fact_type, fact_text, evidence, confidence) of the sentences of `text`, with the day `effective` (may be null) for missing years.

    Equal rewards and periods count once, where they stand first. A page has one period, the first range or else the first deadline,
    unless it is an index of campaigns: more than one "kampanya araligi" or "tum kampanyalar". Null and empty texts have no facts.
    """
    whole = fold_text("text")
    index = ((F.size(F.split(whole, "kampanya araligi", -1)) > 2) | whole.contains(EVERY)).alias("_index")
    sentences = F.transform(F.split("text", r"(?<=[.!?])\s+|[\r\n]+", -1), F.trim)
    rows = docs.select(key, "effective", index, F.posexplode(sentences).alias("at", "evidence")).filter("evidence <> ''").withColumn("_t", fold_text("evidence"))
    dates = F.when(F.col("_t").contains("kampanya"), ordered_dates("evidence", F.year("effective"), F.col("effective")))
    rows = rows.withColumn("_d", dates).withColumn("_n", F.coalesce(F.size("_d"), F.lit(0)))
    fact = lambda kind, text: F.struct(F.lit(kind).alias("fact_type"), text.alias("fact_text"))

    def points(said: Column) -> Column:
        name = F.lit(POINT_NAMES[""])
        for cue in ("bonus", "altin", "world"):
            name = F.when(F.regexp_extract(said, POINTS, 2).contains(cue), POINT_NAMES[cue]).otherwise(name)
        return fact("ALISVERIS_PUANI", F.concat(F.regexp_extract(said, POINTS, 1), F.lit(" TL "), name))

    start, end = F.get("_d", F.lit(0)), F.try_element_at("_d", F.lit(-1))
    period = F.when((F.col("_n") >= 2) & (end >= start) & F.col("_t").rlike(PERIOD), fact("KAMPANYA_TARIH_ARALIGI", F.concat(start, F.lit(" - "), end))).when((F.col("_n") == 1) & F.col("_t").rlike(ENDS), fact("BASVURU_SON_TARIHI", start.cast("string")))
    found = F.concat(F.transform(F.regexp_extract_all("_t", F.lit(POINTS), F.lit(0)), points), F.array_compact(F.array(period)))
    rows = rows.select(key, "_index", "at", "evidence", F.posexplode(found).alias("_i", "_f")).select(key, "_index", "at", "_i", "_f.*", "evidence")
    reward = F.col("fact_type") == "ALISVERIS_PUANI"
    same = F.when(reward, F.concat_ws(":", parse_number(F.substring_index("fact_text", " TL ", 1)).cast("string"), F.substring_index("fact_text", " TL ", -1))).otherwise(F.col("fact_text"))
    order = (F.when(F.col("fact_type") == "BASVURU_SON_TARIHI", 1).otherwise(0), "at", "_i")
    rows = rows.repartition(key).withColumn("_rn", F.row_number().over(Window.partitionBy(key, "fact_type", same).orderBy("at", "_i"))).filter("_rn = 1")
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, reward).orderBy(*order))).filter(reward | F.col("_index") | (F.col("_rn") == 1))
    return rows.select(key, "at", "fact_type", "fact_text", "evidence", F.lit(0.99).alias("confidence"))


# Branches on folded text.
SPECIFIC_BRANCH, PLAIN_BRANCH, YEAR = r"\b(?:mobil sube|internet subesi|internet sube)\b", r"\bsube\b", r"\b20\d{2}\b"
GUARANTEE = ("tmsf", "tasarruf mevduati sigorta fonu")


def dedup_snapshot_facts(facts: DataFrame) -> DataFrame:
    """Facts of snapshots (doc_id, fact_type, fact_text, normalized, evidence, decision, confidence, ordinal) without repeats.

    Facts are the same by their normalised value, or by folded text where it is null and for date ranges. A range without
    years goes where the document has it with one; the plain branch goes where its evidence names a specific branch and no plain one
    besides. Of equal facts the best decision stays, then confidence, then the longer text, then the first. Null counts as less.
    """
    text, said = F.col("_x"), F.col("_e")
    dates, branch = F.col("fact_type") == "KAMPANYA_TARIH_ARALIGI", F.col("fact_type") == "BASVURU_KANALI"
    dashed = F.regexp_replace(text, r"\s*[-–—]\s*", "-")
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, YEAR, ""), r"\s*[-–—]\s*", "-"), r"\s+", " "))
    same = F.when(dates, dashed).when(F.col("normalized").isNotNull(), F.col("normalized")).when((F.col("fact_type") == "MEVDUAT_GUVENCESI") & text.isin(*GUARANTEE), GUARANTEE[0]).otherwise(text)
    rows = facts.repartition("doc_id").withColumn("_x", fold_text(F.coalesce("fact_text", F.lit("")))).withColumn("_e", fold_text(F.coalesce("evidence", F.lit(""))))
    year, specific = dates & text.rlike(YEAR), branch & text.rlike(f"^{SPECIFIC_BRANCH}$")
    rows = rows.withColumn("_dated", F.max(year).over(Window.partitionBy("doc_id", F.when(dates, base)))).withColumn("_specific", F.max(specific).over(Window.partitionBy("doc_id", F.when(branch, F.sha2(said, 256)))))
    repeated = (dates & ~text.rlike(YEAR) & F.col("_dated")) | (branch & (text == "sube") & F.col("_specific") & ~F.regexp_replace(said, SPECIFIC_BRANCH, " ").rlike(PLAIN_BRANCH))
    rank = F.when(F.col("decision") == "accepted", 2).when(F.col("decision") == "review", 1).otherwise(0)
    best = Window.partitionBy("doc_id", "fact_type", same, dates | F.col("normalized").isNull()).orderBy(F.desc(rank), F.desc_nulls_last("confidence"), F.desc(F.length("fact_text")), "ordinal")
    return rows.filter(~F.coalesce(repeated, F.lit(False))).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select(*facts.columns)


@dataclass(frozen=True)
class WeakRule:
    label: str
    pattern: str
    context: str | None  # must be found in the radius
    forbidden: str | None  # must not
    radius: int
    confidence: float


# A rule for each of several labels, on texts as they are without regard to case; the greater priority wins a place.
MONEY = r"\b\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?\s*(?:TL|₺)"
WEAK_RULES = (
    WeakRule("KAR_PAYI_ORANI", r"%\s?\d{1,2}(?:[.,]\d{1,2})?", r"k[âa]r\s*pay[ıi]", r"uygulanmaz|al[ıi]nmaz|yoktur|k[âa]r\s*pay[ıi]\s*yok|indirim|iade|puan", 70, 0.92),
    WeakRule("KAR_PAYLASIM_ORANI", r"\b\d{1,2}\s?/\s?\d{1,2}\b", r"payla[şs][ıi]m\s*oran|kat[ıi]lma\s*oran|kat[ıi]l[ıi]m\s*oran", r"7\s?/\s?24|24\s?/\s?7", 60, 0.90),
    WeakRule("VADE_SURESI", r"\b\d{1,3}\s*ay\b(?:['’]?[ae]\s*(?:varan|kadar))?", r"vade|geri\s*[öo]deme|[öo]deme\s*plan|finansman|kredi", r"taksit", 80, 0.85),
    WeakRule("TAKSIT_SAYISI", r"\b\d{1,2}\s*(?:aya\s*varan\s*)?taksit\b", None, None, 0, 0.93),
    WeakRule("HARCAMA_ESIGI", MONEY + r"\s*(?:ve\s*[üu]zeri|ve\s*[üu]st[üu]|[üu]zerindeki?)", None, None, 0, 0.90),
    WeakRule("ODUL_MIKTARI", MONEY + r"(?:['’]?ye\s*(?:varan|kadar))?", r"nakit\s*iade|hediye|[çc]ek[ıi]|kazan|[öo]d[üu]l|para\s*iade|bonus", r"finansman|masraf|tahsis|limit", 80, 0.83),
    WeakRule("INDIRIM_ORANI", r"%\s?\d{1,2}(?:[.,]\d{1,2})?", r"indirim", r"k[âa]r\s*pay[ıi]", 50, 0.90),
)
PRIORITIES = {"KAR_PAYI_ORANI": 100, "KAR_PAYLASIM_ORANI": 100, "TAKSIT_SAYISI": 90, "HARCAMA_ESIGI": 88, "ODUL_MIKTARI": 80, "INDIRIM_ORANI": 75, "VADE_SURESI": 70}


def weak_label_spans(passages: DataFrame, rules: tuple[WeakRule, ...] = WEAK_RULES, priorities: dict[str, int] = PRIORITIES, key: str = "doc_id") -> DataFrame:
    """(key, label, start, stop, said, confidence) of passages (key, text), in code points from 0, end exclusive; no two spans overlap.

    A match needs its rule's context within the radius on either side of it, and not the forbidden one. Of overlapping spans that of the
    higher priority stays, then the longer, then the first, then the surer. All is done within the row of a passage. Null texts have none.
    """
    text = F.col("text")
    labelled: list[Column] = []

    def span(r: WeakRule) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(-priorities.get(r.label, 0)).alias("p"), (m["start"] - m["stop"]).alias("n"), m["start"].alias("start"), F.lit(-r.confidence).alias("c"), F.lit(r.label).alias("label"), m["stop"].alias("stop"), m["said"].alias("said"))

    def fits(r: WeakRule) -> Callable[[Column], Column]:
        def test(m: Column) -> Column:
            left = F.greatest(m["start"] - r.radius, F.lit(0))
            around = F.substring(text, left + 1, m["stop"] + r.radius - left)
            return (around.rlike(f"(?iu){r.context}") if r.context else F.lit(True)) & (~around.rlike(f"(?iu){r.forbidden}") if r.forbidden else F.lit(True))

        return test

    for r in rules:
        labelled.append(F.transform(F.filter(roles.matches(text, f"(?iu){r.pattern}"), fits(r)), span(r)))
    found = F.array_sort(F.flatten(F.array(*labelled)))
    kept = F.aggregate("_s", F.slice("_s", 1, 0), lambda have, s: F.when(F.exists(have, lambda h: (h["start"] < s["stop"]) & (s["start"] < h["stop"])), have).otherwise(F.concat(have, F.array(s))))
    out = passages.withColumn("_s", found).select(key, F.explode(kept).alias("s"))
    return out.select(key, "s.label", "s.start", "s.stop", "s.said", (-F.col("s.c")).alias("confidence"))
