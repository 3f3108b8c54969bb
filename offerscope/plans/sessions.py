"""Queries of sessions: names in questions, routes turn by turn. The questions are made from the given events, users being sessions."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.operators import entities, sessions
from offerscope.plans.corpus import FOLD
from offerscope.registry import query

#: Wordings of questions; a bank, a product, a field and a year of the event's own are put in.
FORMS = (
    "{b} {p} {f} nedir?", "Peki {f} ne kadar?", "İkincisinin {f} nedir?", "Bunun {f} kaç?", "{b}'ın {f}?", "{y} yılında nasıldı?", "Tüm dönem için göster.", "Aynı bankanın {p} {f} ne?", "Merhaba, nasılsın?", "Üçüncüsü {f} ne?",
    "Şimdi {b} {p} konusuna geçelim.", "{p} için bankaları karşılaştır.", "Biraz daha detaylı anlat.", "Hayır, Nisan-Haziran {y} {p} göster.", "En düşük {f} hangi bankada?", "{p} {f} listele", "Onun {f} nedir?", "Bu teklif {p} için mi?", "Toplam {f} ne kadar?", "Bitcoin ne olur?",
    "{b} ve {p}", "Güncel {p} {f} nedir?", "Aktif kampanyalarda {f} ne?", "Teşekkürler",
)
_BANKS, _PRODUCTS, _FIELDS = [*entities.BANKS], [*entities.PRODUCTS], [*entities.FIELDS]


def _aliases(names: dict[str, tuple[str, ...]]) -> list[str]:
    return [a for aliases in names.values() for a in aliases]


def _questions(spark, d):
    """One question for each event, with up to three offers as its answer."""
    e = A.events(spark, d)
    n = F.col("event_id") + F.col("user_id") * 7
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), ((n * k) % len(values)).cast("int"))
    text = of(FORMS, 5)
    for slot, value in (("{b}", of(_aliases(entities.BANKS), 11)), ("{p}", of(_aliases(entities.PRODUCTS), 13)), ("{f}", of(_aliases(entities.FIELDS), 17)), ("{y}", (2020 + n % 6).cast("string"))):
        text = F.replace(text, F.lit(slot), value)
    one = lambda i: F.struct(F.concat(F.lit("o"), ((n + i) % 50).cast("string")).alias("offer_id"), of(_BANKS, 3 + i).alias("bank"), F.array(of(_PRODUCTS, 1)).alias("products"), F.lit(i).alias("rank"))
    offers = F.slice(F.array(one(1), one(2), one(3)), F.lit(1), (n % 4).cast("int"))
    return e.select("user_id", "event_id", text.alias("text"), F.col("ts").cast("date").alias("asked_on"), offers.alias("offers"), (n % 5 != 0).alias("verified"), "ts")


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_N = "(event_id + user_id * 7)"
_SAYS = f"list_extract({_list(FORMS)}, {_N} * 5 % {len(FORMS)} + 1)"
for _slot, _names, _k in (("{b}", entities.BANKS, 11), ("{p}", entities.PRODUCTS, 13), ("{f}", entities.FIELDS, 17)):
    _SAYS = f"replace({_SAYS}, '{_slot}', list_extract({_list(_aliases(_names))}, {_N} * {_k} % {len(_aliases(_names))} + 1))"
_SAYS = f"replace({_SAYS}, '{{y}}', (2020 + {_N} % 6)::VARCHAR)"


def _found(names: dict[str, tuple[str, ...]], tail: str) -> str:
    """A list of the names for whose aliases a pattern fits, in order."""
    dotted = lambda a: a.replace(".", "[.]")
    cases = (f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])({'|'.join(map(dotted, aliases))}){tail}') THEN '{n}' END" for n, aliases in names.items())
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_BANK_TAIL, _PRODUCT_TAIL = (f"({'|'.join(s)})?($|[^a-z0-9_])" for s in (entities.BANK_SUFFIXES, entities.PRODUCT_SUFFIXES))


@query("l1_names_in_questions", f"""WITH q AS (SELECT user_id, event_id, {FOLD.format(c=_SAYS)} AS t FROM events), n AS (SELECT user_id, event_id, {_found(entities.BANKS, _BANK_TAIL)} AS banks, {_found(entities.PRODUCTS, _PRODUCT_TAIL)} AS p, {_found(entities.FIELDS, '')} AS fields FROM q)
SELECT user_id, event_id, banks, list_filter(p, lambda x: NOT (x = 'KART' AND (list_contains(p, 'KART_KAMPANYASI') OR list_contains(p, 'MOBIL_UYGULAMA_KAMPANYASI'))) AND NOT (x = 'KART_KAMPANYASI' AND list_contains(p, 'MOBIL_UYGULAMA_KAMPANYASI'))) AS products, fields FROM n""")
def l1_names(spark, d):
    return entities.with_entities(_questions(spark, d).select("user_id", "event_id", "text"), entities.standard()).drop("text")


@query("l5_session_routes")
def l5_routes(spark, d):
    """The route of each question of each user; tests hold it against plain loops."""
    return sessions.fold_sessions(_questions(spark, d), "user_id", "event_id")
