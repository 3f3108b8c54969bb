"""Queries of the title, campaign, reward and context rules (F2, F3, F13, F16, F17, F24, F26) and C10 on sentences that carry the numbers of order lines."""

from pyspark.sql import functions as F

from offerscope import adapters as A
from offerscope.functions import text as X
from offerscope.operators import page_rules as P
from offerscope.operators import roles
from offerscope.registry import query

_LINE = "l AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k, o_custkey % 900 + 100 AS p, o_orderkey % 90 + 5 AS s, o_orderkey % 49 + 1 AS q, o_orderdate::DATE AS day FROM orders)"


def _lines(spark, d):
    """Numbers of each order: k chooses a sentence, p, s and q stand in it."""
    n = F.col("o_orderkey")
    numbers = {"p": F.col("o_custkey") % 900 + 100, "s": n % 90 + 5, "q": n % 49 + 1}
    return A.table(spark, d, "orders").select(n.alias("doc_id"), (n % 8).alias("k"), *(v.cast("string").alias(c) for c, v in numbers.items()), F.col("o_orderdate").cast("date").alias("day"))


def _by_k(*texts):
    """The text of the line's k, with {p}, {s} and {q} replaced by its numbers."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        out = F.when(F.col("k") == k, text).otherwise(out)
    for name in "psq":
        out = F.replace(out, F.lit("{%s}" % name), F.col(name))
    return out


_DATES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [make_date(year(o_orderdate), 1, 3), make_date(year(o_orderdate), 1, 9)] WHEN 1 THEN [make_date(year(o_orderdate) - 1, 12, 20), make_date(year(o_orderdate), 1, 10)]
WHEN 2 THEN [o_orderdate::DATE, make_date(year(o_orderdate) + CASE WHEN make_date(year(o_orderdate), 5, 6) < o_orderdate::DATE THEN 1 ELSE 0 END, 5, 6)] ELSE []::DATE[] END AS dates FROM orders"""


@query("c10_ordered_dates", _DATES)
def c10(spark, d):
    year, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    says = (
        F.when(k == 0, F.concat(F.lit("3-9 Ocak "), year, F.lit(" arası"))).when(k == 1, F.concat(F.lit("20 Aralık - 10 Ocak "), year)).when(k == 2, F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" ve 6 Mayıs günü"))).otherwise("31 Şubat 2020 ve 6 günlük")
    )
    return A.table(spark, d, "orders").select("o_orderkey", X.ordered_dates(says).alias("dates"))


@query("f2_title_rules", f"""WITH {_LINE}, t AS (SELECT doc_id, CASE k WHEN 0 THEN [['FINANSMAN_AMACI', 'egitim finansmani'], ['FINANSMAN_TURU', 'leasing']] WHEN 1 THEN [['FINANSMAN_TURU', 'gayri nakdi finansman urunleri']] WHEN 3 THEN [['YATIRIM_ARACI', 'altin hesabi'], ['YATIRIM_ARACI', 'yatirim fonu']]
WHEN 4 THEN [['KART_TURU', 'kredi karti']] WHEN 5 THEN [['SIGORTA_TURU', 'dask'], ['SIGORTA_TURU', 'konut sigortasi']] WHEN 6 THEN [['ODEME_HIZMETI', 'eft'], ['ODEME_HIZMETI', 'fast']] ELSE [] END AS f FROM l), u AS (SELECT doc_id, unnest(f) AS f FROM t) SELECT doc_id, f[1] AS fact_type, f[2] AS fact_text FROM u""")
def f2(spark, d):
    product = _by_k("FINANSMAN", "TICARI_FINANSMAN", "FINANSMAN", "YATIRIM_URUNU", "KART", "SIGORTA_TEKAFUL", "ODEME_TRANSFER", "KART")
    title = _by_k("Eğitim Finansmanı {p} ve Leasing", "Gayri Nakdi Finansman Ürünleri {p}", "Konut Finansmanı Sigortası {p}", "Altın Hesabı ile Yatırım Fonu {q}", "Kredi Kartı {q}", "DASK ve Konut Sigortası", "EFT / FAST {s}", "Eğitim Finansmanı {p}")
    return P.title_rules(_lines(spark, d).select("doc_id", product.alias("product"), title.alias("title"))).select("doc_id", "fact_type", "fact_text")


_CAMPAIGN = f"""WITH {_LINE}, t AS (SELECT doc_id, CASE k WHEN 0 THEN [['HARCAMA_ESIGI', p || ' tl'], ['ODUL_TUTARI', s || ' tl']] WHEN 1 THEN [['BASVURU_SON_TARIHI', '15.03.2026'], ['TAKSIT_SAYISI', q || ' taksit']] WHEN 2 THEN [['INDIRIM_ORANI', '%' || q]]
WHEN 3 THEN [['KAR_PAYI_ORANI', '%' || q], ['KAMPANYA_TARIH_ARALIGI', '1 ocak - 28 subat 2026']] WHEN 4 THEN [['UYGUNLUK_KOSULU', 'kampanyadan yararlanmak icin ' || q || ' gun uye olmalisiniz.']] WHEN 6 THEN [['INDIRIM_TUTARI', p || ' tl']] ELSE [] END AS f FROM l), u AS (SELECT doc_id, unnest(f) AS f FROM t)
SELECT doc_id, f[1] AS fact_type, f[2] AS fact_text, CASE f[1] WHEN 'KAMPANYA_TARIH_ARALIGI' THEN 0.99 WHEN 'BASVURU_SON_TARIHI' THEN 0.98 WHEN 'UYGUNLUK_KOSULU' THEN 0.91 WHEN 'ODUL_TUTARI' THEN 0.96 WHEN 'INDIRIM_TUTARI' THEN 0.96 ELSE 0.97 END::DOUBLE AS confidence FROM u"""


@query("f3_campaign_rules", _CAMPAIGN)
def f3(spark, d):
    says = _by_k(
        "{p} TL ve üzeri harcamanıza {s} TL bonus kazanın.", "Son başvuru tarihi 15.03.2026, {q} taksit imkânı.", "Market alışverişlerinde %{q} indirim, başka koşul yok.", "Kâr payı %{q} ile başvurun; 1 Ocak - 28 Şubat 2026 arası geçerli.",
        "Kampanyadan yararlanmak için {q} gün üye olmalısınız.", "{p} TL ve üzeri harcamanıza {s} TL bonus kazanın.", "Bu ay {p} TL indirim sizinle.", "Bakiyeniz {p} TL olarak görünür.",
    )
    product = F.when(F.col("k") == 3, "DIGER_KAMPANYA").when(F.col("k") == 5, "FINANSMAN").otherwise("KART_KAMPANYASI")
    return P.campaign_rules(_lines(spark, d).select("doc_id", F.lit(0).alias("at"), product.alias("product"), says.alias("segment"))).select("doc_id", "fact_type", "fact_text", "confidence")


_REWARDS = f"""WITH {_LINE}, t AS (SELECT doc_id, CASE k WHEN 0 THEN [['KAMPANYA_TARIH_ARALIGI', day || ' - ' || (day + 30)], ['ALISVERIS_PUANI', p || ' TL Worldpuan']] WHEN 1 THEN [['BASVURU_SON_TARIHI', day::VARCHAR]] WHEN 2 THEN [['KAMPANYA_TARIH_ARALIGI', day || ' - ' || (day + 30)]]
WHEN 3 THEN [['BASVURU_SON_TARIHI', day::VARCHAR], ['KAMPANYA_TARIH_ARALIGI', day || ' - ' || (day + 30)]] WHEN 4 THEN [['ALISVERIS_PUANI', p || ' TL Altin Puan'], ['ALISVERIS_PUANI', s || ' TL Alisveris Puani']] ELSE [] END AS f FROM l), u AS (SELECT doc_id, unnest(f) AS f FROM t) SELECT doc_id, f[1] AS fact_type, f[2] AS fact_text FROM u"""


@query("f13_reward_and_period_facts", _REWARDS)
def f13(spark, d):
    first, last = F.date_format("day", "dd.MM.yyyy"), F.date_format(F.date_add("day", 30), "dd.MM.yyyy")
    period, end = "Kampanya {a} ve {b} tarihleri arasında düzenlenir.", "Kampanya {a} tarihine kadar geçerlidir."
    says = _by_k(f"{period} Üyelere {{p}} TL Worldpuan verilir. Yine {{p}} TL'ye varan World Puan!", end, f"{end} {period}", f"Tüm kampanyalar: {end} {period}", "{p} TL Altın Puan, {s} TL alışveriş puanı.", "{p} TL puan değil.", "Etkinlik {a} ve {b} tarihleri arasında.", "")
    text = F.replace(F.replace(says, F.lit("{a}"), first), F.lit("{b}"), last)
    return P.reward_and_period_facts(_lines(spark, d).select("doc_id", F.col("day").alias("effective"), text.alias("text"))).select("doc_id", "fact_type", "fact_text")


_VERDICT = f"""WITH {_LINE} SELECT doc_id, k IN (0, 2, 3, 4, 5, 7) AS rule_ok, CASE k WHEN 1 THEN 'excluded_reward_amount_context' WHEN 3 THEN 'excluded_first_payment_timing_context' WHEN 4 THEN 'conflicting_property_value_context' WHEN 6 THEN 'excluded_finance_rate_context' END AS excluded FROM l"""


@query("f16_f17_context_verdicts", _VERDICT)
def f16(spark, d):
    label = _by_k("HARCAMA_ESIGI", "HARCAMA_ESIGI", "VADE_SURESI", "VADE_SURESI", "FINANSMAN_TUTARI", "KAR_PAYI_ORANI", "INDIRIM_ORANI", "ODUL_TUTARI")
    value = _by_k("{p} TL", "{s},5 TL", "{q} ay", "{q} ay", "{p} TL", "%{q}", "%{q}", "")
    spend = "{p} TL ve üzeri harcamanıza yalnız bugün {s},5 TL bonus kazanın."
    says = _by_k(spend, spend, "Vade {q} ay olarak sunulur.", "Vade {q} ay, ilk taksit sonra.", "Finansman, {p} TL konut değeri için.", "Kâr payı %{q}, yazın.", "Kâr payı %{q} sabittir.", "Ödül olarak {p} TL iade.")
    return roles.context_verdicts(_lines(spark, d).select("doc_id", label.alias("label"), value.alias("value"), says.alias("evidence"))).select("doc_id", "rule_ok", "excluded")


_SNAP = """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_suppkey AS s, l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS price FROM lineitem), f AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN q % 3 = 0 THEN 'KAMPANYA_TARIH_ARALIGI' WHEN q % 3 = 1 THEN 'BASVURU_KANALI' ELSE 'HARCAMA_ESIGI' END AS fact_type, CASE WHEN q % 3 = 0 THEN CASE flag WHEN 'A' THEN '1 Ocak - 5 Mart 2026' ELSE '1 Ocak - 5 Mart' END WHEN q % 3 = 1 THEN CASE flag WHEN 'A' THEN 'mobil şube' ELSE 'Şube' END ELSE (s % 4) || ' TL' END AS fact_text,
CASE WHEN q % 3 = 2 THEN '{"value":' || s % 4 || '}' END AS normalized, CASE WHEN status = 'F' THEN 'accepted' ELSE 'review' END AS decision, price AS confidence FROM l),
y AS (SELECT *, coalesce(bool_or(fact_text LIKE '%2026') OVER (PARTITION BY doc_id), false) AS dated, bool_or(fact_text = 'mobil şube') OVER (PARTITION BY doc_id) AS specific FROM f), r AS (SELECT * FROM y WHERE NOT (fact_text = '1 Ocak - 5 Mart' AND dated) AND NOT (fact_text = 'Şube' AND specific))
SELECT doc_id, fact_type, fact_text, decision, n FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, fact_type, fact_text ORDER BY decision, confidence DESC, n) = 1"""


@query("f24_dedup_snapshot_facts", _SNAP)
def f24(spark, d):
    q, amount = F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 4).cast("string")
    dates, branch = q % 3 == 0, q % 3 == 1
    facts = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(dates, "KAMPANYA_TARIH_ARALIGI").when(branch, "BASVURU_KANALI").otherwise("HARCAMA_ESIGI").alias("fact_type"),
        F.when(dates, F.when(F.col("l_returnflag") == "A", "1 Ocak - 5 Mart 2026").otherwise("1 Ocak - 5 Mart")).when(branch, F.when(F.col("l_returnflag") == "A", "mobil şube").otherwise("Şube")).otherwise(F.concat(amount, F.lit(" TL"))).alias("fact_text"),
        F.when(~dates & ~branch, F.concat(F.lit('{"value":'), amount, F.lit("}"))).alias("normalized"), F.lit("Mobil şube ile başvurun.").alias("evidence"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("review").alias("decision"), F.col("l_extendedprice").alias("confidence"), F.col("l_linenumber").alias("ordinal"),
    )
    return P.dedup_snapshot_facts(facts).select("doc_id", "fact_type", "fact_text", "decision", F.col("ordinal").alias("n"))


_WEAK = f"""WITH {_LINE}, t AS (SELECT doc_id, CASE k WHEN 0 THEN [['HARCAMA_ESIGI', '0', p || ' TL ve üzeri'], ['ODUL_MIKTARI', (length(p::VARCHAR) + 23)::VARCHAR, s || ' TL']] WHEN 1 THEN [['KAR_PAYI_ORANI', '9', '%' || q]] WHEN 2 THEN [['INDIRIM_ORANI', '0', '%' || q]] WHEN 3 THEN [['TAKSIT_SAYISI', '9', q || ' taksit']] WHEN 4 THEN [['VADE_SURESI', '5', q || ' ay']] WHEN 5 THEN [['KAR_PAYLASIM_ORANI', '14', '98/2']] ELSE [] END AS f FROM l),
u AS (SELECT doc_id, unnest(f) AS f FROM t) SELECT doc_id, f[1] AS label, f[2]::INT AS start, f[2]::INT + length(f[3])::INT AS stop, f[3] AS said FROM u"""


@query("f26_weak_label_spans", _WEAK)
def f26(spark, d):
    says = _by_k("{p} TL ve üzeri harcamaya {s} TL bonus.", "Kâr payı %{q} olur.", "%{q} indirim bugün.", "Vadesiz, {q} taksit.", "Vade {q} ay.", "Paylaşım oran 98/2.", "Kâr payı %{q} uygulanmaz.", "Boş {p} satır.")
    return P.weak_label_spans(_lines(spark, d).select("doc_id", says.alias("text"))).select("doc_id", "label", "start", "stop", "said")
