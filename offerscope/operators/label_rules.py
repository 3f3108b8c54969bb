"""Product labels of pages by ordered tables of phrases over title, body and URL path. The tables are parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.functions.text import normalize_alnum


@dataclass(frozen=True)
class LabelRule:
    """A label for surfaces that hold any of the phrases, and any of `also` if there are some; or, with `whole`, that are one of the phrases."""

    label: str
    reason: str
    phrases: tuple[str, ...]
    also: tuple[str, ...] = ()
    whole: bool = False
    campaign: bool = False  # counts on campaign pages only


# The ordered rules, over normalised text; the first that fits decides.
TEXT_RULES = (
    LabelRule("KART_KAMPANYASI", "explicit_card_campaign", ("kredi kart", "banka kart", "mastercard", "worldpuan", "bankkart", "paraf", "business kart", "debit kart"), campaign=True),
    LabelRule("DIGER_KAMPANYA", "explicit_non_card_campaign", ("kampanya", "indirim", "hediye", "kazandir", "firsat"), campaign=True),
    LabelRule("DIGER_FINANSMAN", "named_finance_portal", ("hizli finansman",)),
    LabelRule("IHTIYAC_FINANSMANI", "named_personal_finance_product", ("kira odeyen hesap", "fatura odeyen hesap", "aidat odeyen hesap", "jet finansman")),
    LabelRule("DIGER_FINANSMAN", "named_other_finance_product", ("bes teminatli finansman", "findeks kredi notu")),
    LabelRule("DIGER_FINANSMAN", "generic_finance_title", ("finansman", "finansmanlar"), whole=True),
    LabelRule("TICARI_FINANSMAN", "named_commercial_finance_product", ("leasing", "finansal kiralama", "kobi nakdi finans", "kobi gayri nakdi finans")),
    LabelRule("SIGORTA_TEKAFUL_URUNU", "insurance_phrase", ("sigorta", "dask", "kasko", "tekaf", "ferdi kaza")),
    LabelRule("KONUT_FINANSMANI", "housing_finance_phrase", ("konut finans", "mortgage")),
    LabelRule("KONUT_FINANSMANI", "housing_finance_phrase", ("konut",), ("finansman", "ev sahibi")),
    LabelRule("TASIT_FINANSMANI", "vehicle_finance_phrase", ("tasit finans", "arac finans", "motosiklet finans", "togg finans")),
    LabelRule("IHTIYAC_FINANSMANI", "personal_finance_phrase", ("ihtiyac finans", "alisveris kredi", "egitim finans", "hazir limit")),
    LabelRule("KART_URUNU", "card_product_phrase", ("kredi kart", "banka kart", "sanal kart", "ek kart", "business kart")),
    LabelRule("KATILMA_HESABI", "participation_account_phrase", ("katilma hesabi", "kar payi odemeli hesap", "gunluk kazandiran hesap")),
    LabelRule("ODEME_TRANSFER_HIZMETI", "payment_transfer_phrase", ("para transfer", "moneygram", "swift", "eft", "havale", "fatura odeme", "sanal pos")),
    LabelRule("YATIRIM_URUNU", "investment_phrase", ("yatirim fon", "hisse sened", "kira sertifika", "sukuk", "kiymetli maden", "altin hesabi")),
    LabelRule("TICARI_FINANSMAN", "commercial_finance_phrase", ("ticari finans", "kobi finans", "isletme finans", "tedarikci finans", "teminat mektubu")),
)
PATH_RULES = (
    LabelRule("DIGER_KAMPANYA", "campaign_path", ("kampanya",)),
    LabelRule("SIGORTA_TEKAFUL_URUNU", "insurance_path", ("sigorta", "tekaf", "dask", "kasko", "ferdi kaza")),
    LabelRule("KONUT_FINANSMANI", "housing_finance_path", ("konut finansmani", "mortgage")),
    LabelRule("TASIT_FINANSMANI", "vehicle_finance_path", ("tasit finansmani", "motosiklet finansmani", "arac finansmani")),
    LabelRule("IHTIYAC_FINANSMANI", "personal_finance_path", ("ihtiyac finansmani", "egitim finansmani", "hac ve umre finansmani", "umre finansmani")),
    LabelRule("TICARI_FINANSMAN", "commercial_finance_path", (" kobi ", " ticari ", " kurumsal ", " tarim "), ("finans", "dis ticaret", "leasing", "kredi")),
    LabelRule("DIGER_FINANSMAN", "generic_finance_path", ("finansman urunleri", "kendim icin finansmanlar")),
)
#: Reasons of URL rules that advise only.
ADVISORY = ("campaign_path", "generic_finance_path")


def _any(surface: Column, phrases: tuple[str, ...]) -> Column:
    return surface.rlike("|".join(map(re.escape, phrases)))


def first_label(surface: Column, rules: tuple[LabelRule, ...], campaign: Column | None = None) -> Column:
    """struct(label, reason) of the first rule that fits a normalised surface, null if none does; surfaces have a space on both sides."""
    made = []
    for r in rules:
        fits = F.trim(surface).isin(*r.phrases) if r.whole else _any(surface, r.phrases)
        fits = fits & _any(surface, r.also) if r.also else fits
        fits = fits & F.coalesce(campaign, F.lit(False)) if r.campaign and campaign is not None else F.lit(False) if r.campaign else fits
        made.append(F.when(fits, F.struct(F.lit(r.label).alias("label"), F.lit(r.reason).alias("reason"))))
    return F.coalesce(*made)


def label_pages(pages: DataFrame, text_rules: tuple[LabelRule, ...] = TEXT_RULES, path_rules: tuple[LabelRule, ...] = PATH_RULES, key: str = "doc_id") -> DataFrame:
    """(key, title_label, title_reason, body_label, body_reason, url_label, url_reason, url_advises) of pages (key, title, text, url, is_campaign).

    Null and malformed values have no label. The body is read whole; url_advises marks URL labels that only advise. resolve_label takes them on.
    """
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    path = normalize_alnum(F.try_parse_url("url", F.lit("PATH")))
    rows = pages.select(key, "is_campaign", spaced(normalize_alnum("title")).alias("t"), spaced(normalize_alnum("text")).alias("b"), spaced(path).alias("p"))
    named = rows.select(key, first_label(F.col("t"), text_rules, F.col("is_campaign")).alias("t"), first_label(F.col("b"), text_rules, F.col("is_campaign")).alias("b"), first_label(F.col("p"), path_rules).alias("p"))
    return named.select(key, *(F.col(f"{c}.{f}").alias(f"{name}_{f}") for c, name in (("t", "title"), ("b", "body"), ("p", "url")) for f in ("label", "reason")), F.coalesce(F.col("p.reason").isin(*ADVISORY), F.lit(False)).alias("url_advises"))
