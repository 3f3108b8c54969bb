"""Query of the label rules: a page for each given order, whose title, body and path hold phrases by its numbers."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.operators import label_rules as L
from offerscope.registry import query

_WORDS = ("Konut", "Finansman", "Taşıt Finansmanı", "Kredi Kartı", "Kampanyası", "DASK", "Ev sahibi", "Hızlı Finansman", "Leasing", "Para Transferi", "Kobi", "Altın Hesabı", "Hakkımızda", "Katılma Hesabı", "Eğitim Finansmanı", "Şubeler", "İhtiyaç", "Teminat Mektubu", "Tarım")
_N = len(_WORDS)
_PATHS = ("/tr/konut-finansmani", "/kampanya/x", "/kobi/krediler", "/sigorta", "/bireysel/finansman-urunleri", "/tarim", "/x/arac-finansmani", "/umre-finansmani?a=kampanya", "", "/hakkimizda")


def _surface(names: str) -> str:
    """DuckDB: the phrases normalised, a space on both sides."""
    return f"' ' || trim(regexp_replace(lower(strip_accents(translate({names}, 'ıİ', 'ii'))), '[^a-z0-9%]+', ' ', 'g')) || ' '"


def _values(rules: tuple[L.LabelRule, ...]) -> str:
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    return "(VALUES " + ", ".join(f"({i}, '{r.label}', '{r.reason}', {words(r.phrases)}, {words(r.also)}, {str(r.whole).lower()}, {str(r.campaign).lower()})" for i, r in enumerate(rules)) + ") AS r(i, label, reason, ps, also, whole, camp)"


def _first(surface: str, rules: tuple[L.LabelRule, ...]) -> str:
    """DuckDB: for each page the least rule that fits, by a join of pages and rules."""
    return f"""SELECT doc_id, arg_min(label, i) AS label, arg_min(reason, i) AS reason FROM p, {_values(rules)} WHERE (NOT camp OR is_campaign)
AND CASE WHEN whole THEN list_contains(ps, trim({surface})) ELSE len(list_filter(ps, lambda x: contains({surface}, x))) > 0 AND (len(also) = 0 OR len(list_filter(also, lambda x: contains({surface}, x))) > 0) END GROUP BY doc_id"""


_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
_PATH_LIST = "[" + ", ".join(f"'{w.split('?')[0]}'" for w in _PATHS) + "]"


@query("g1_g2_label_rules", f"""WITH q AS (SELECT o_orderkey AS doc_id, o_custkey % 3 = 0 AS is_campaign, list_extract({_LIST}, o_orderkey % {_N} + 1) AS a, list_extract({_LIST}, o_custkey % {_N} + 1) AS b, list_extract({_LIST}, (o_orderkey + o_custkey) % {_N} + 1) AS c, list_extract({_PATH_LIST}, o_custkey % {len(_PATHS)} + 1) AS u FROM orders),
p AS (SELECT doc_id, is_campaign, CASE WHEN doc_id % 5 > 0 THEN {_surface("CASE WHEN doc_id % 2 = 0 THEN a ELSE a || ' - ' || b END")} END AS t, {_surface("c || chr(10) || b")} AS body, {_surface("u")} AS u FROM q),
ft AS ({_first('t', L.TEXT_RULES)}), fb AS ({_first('body', L.TEXT_RULES)}), fu AS ({_first('u', L.PATH_RULES)})
SELECT p.doc_id, ft.label AS title_label, ft.reason AS title_reason, fb.label AS body_label, fb.reason AS body_reason, fu.label AS url_label, fu.reason AS url_reason, coalesce(fu.reason IN ('campaign_path', 'generic_finance_path'), false) AS url_advises FROM p LEFT JOIN ft ON ft.doc_id = p.doc_id LEFT JOIN fb ON fb.doc_id = p.doc_id LEFT JOIN fu ON fu.doc_id = p.doc_id""")
def g1_labels(spark, d):
    o = A.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = lambda n: F.get(F.array(*map(F.lit, _WORDS)), (n % _N).cast("int"))
    title = F.when(k % 5 > 0, F.when(k % 2 == 0, word(k)).otherwise(F.concat(word(k), F.lit(" - "), word(c))))
    url = F.concat(F.lit("https://www.example.com"), F.get(F.array(*map(F.lit, _PATHS)), (c % len(_PATHS)).cast("int")))
    pages = o.select(k.alias("doc_id"), title.alias("title"), F.concat(word(k + c), F.lit("\n"), word(c)).alias("text"), url.alias("url"), (c % 3 == 0).alias("is_campaign"))
    return L.label_pages(pages)
