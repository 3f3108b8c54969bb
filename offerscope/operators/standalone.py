"""The question of a turn as one that stands by itself: names, period, qualifiers, ordering, fields, count and operation in a fixed order."""

from __future__ import annotations

import datetime
import re

from offerscope.functions.text import MONTHS
from offerscope.operators.entities import BANKS, FIELDS, PRODUCTS

# Labels of products and fields, and of scopes.
PRODUCT_LABELS = {
    "KONUT_FINANSMANI": "konut finansmani", "TASIT_FINANSMANI": "tasit finansmani", "IHTIYAC_FINANSMANI": "ihtiyac finansmani", "TICARI_FINANSMAN": "ticari finansman", "KATILMA_HESABI": "katilma hesabi", "CARI_HESAP": "cari hesap",
    "KART": "kredi karti", "KART_KAMPANYASI": "kart kampanyasi", "MOBIL_UYGULAMA_KAMPANYASI": "mobil uygulama kampanyasi", "YATIRIM_URUNU": "yatirim urunu", "ODEME_TRANSFER": "odeme transferi", "SIGORTA_TEKAFUL": "sigorta tekaful",
}
FIELD_LABELS = {"amount": "tutari", "rate": "orani", "maturity": "vade suresi", "fee": "ucreti", "reward": "odulu", "spending_threshold": "harcama esigi", "campaign_date": "kampanya tarihi"}
SCOPE_LABELS = {"current": "guncel", "historical": "gecmis", "all": "tum donem"}
# Words that qualify nothing, and suffixes of words.
IDLE = frozenset("acaba bana bunun icin kadar mi midir misiniz mu mudur ne nedir nelerdir onun peki".split())
GENERIC = frozenset(
    "anlat arasinda ayni banka bankanin belirt bilgi bugun bu cevap cevabinda dedin demistin dogru dort dusuk en fazla gecmis gore goster guncel hangi hakkinda iki ilk karsilastir kisa listele onceki sirala soyle teklif tum uc uzun yuksek".split()
)
SUFFIXES = frozenset(
    "a da daki dan de deki den e i in inda indan inde inden ini inin lar larda lardan lari larin le ler lerde lerden leri lerin na nda ndan ne nde nden ni nin nu nun si sini sinin su sunu sunun ta taki tan te teki ten u un unda undan unde unden unu unun ya ye yi yu".split()
)
LEAST, MOST = ("en dusuk", "en az", "en kisa"), ("en yuksek", "en fazla", "en uzun")
OPERATIONS = ("karsilastir", "listele", "sirala")
_YEAR = r"(?:19|20)\d{2}"
_DATES = re.compile(rf"(?<!\d)\d{{1,2}}\s+(?:{'|'.join(MONTHS)})(?:\s+{_YEAR})?(?!\d)|(?<!\d){_YEAR}[-/.]\d{{1,2}}[-/.]\d{{1,2}}(?!\d)|(?<!\d)\d{{1,2}}[./]\d{{1,2}}[./]{_YEAR}(?!\d)")
_MEASURE = re.compile(r"(?<!\w)\d+(?:[.,]\d+)?\s*(?:ay|gun|m2|metrekare|tl|try|usd|eur|yil)(?!\w)")
_COUNT = re.compile(r"(?<!\w)(bir|iki|uc|dort|bes|[1-5])\s+(?:guncel\s+)?(?:[a-z]+\s+){0,3}(?:teklif|kampanya|urun)[a-z]*(?!\w)")
_TOKEN = re.compile(r"[a-z0-9]+")


def _covered(token: str, roots: frozenset[str] | set[str]) -> bool:
    """Whether a token is a root, or a root of three letters or more with a suffix."""
    return token in roots or any(token[:cut] in roots and token[cut:] in SUFFIXES for cut in range(3, len(token)))


def qualifiers(folded: str, banks: list[str], products: list[str], fields: list[str]) -> list[str]:
    """Words of a folded question that its names and fields don't cover, then its measures."""
    text = _DATES.sub(" ", folded)
    measures = [] if any(w in text for w in ("onceki cevap", "cevabinda", "dedin", "demistin")) else [" ".join(m.group().split()) for m in _MEASURE.finditer(text)]
    phrases = [a for names, known in ((banks, BANKS), (products, PRODUCTS), (fields, FIELDS)) for n in names for a in (*known.get(n, ()), n.lower().replace("_", " "))]
    phrases += [PRODUCT_LABELS.get(p, "") for p in products] + [FIELD_LABELS.get(f, "") for f in fields]
    roots = {t for p in phrases for t in _TOKEN.findall(p)} | {*MONTHS}
    words = [t for t in _TOKEN.findall(_MEASURE.sub(" ", text)) if len(t) > 1 and t not in IDLE and not re.fullmatch(_YEAR, t) and not _covered(t, GENERIC) and not _covered(t, roots)]
    return list(dict.fromkeys(words + measures))


def standalone(folded: str, banks: list[str], products: list[str], fields: list[str], scope: str, year: int | None, since: datetime.date | None, until: datetime.date | None) -> str:
    """The question in full; days stand in brackets at its end where there is no year."""
    asked = [FIELD_LABELS[f] for f in fields if f in FIELD_LABELS]
    order = "en dusuk " if any(w in folded for w in LEAST) else "en yuksek " if any(w in folded for w in MOST) else ""
    if order and asked:
        asked[0] = order + asked[0]
    parts = [*banks, str(year) if year is not None else SCOPE_LABELS[scope], *(PRODUCT_LABELS.get(p, p.lower().replace("_", " ")) for p in products), *qualifiers(folded, banks, products, fields), *asked]
    operation = next((w for w in OPERATIONS if w in folded), None)
    if operation and fields:
        count = _COUNT.search(folded)
        parts += [count.group(1), operation] if count else [operation]
    days = " - ".join(d.isoformat() for d in (since, until) if d) if year is None else ""
    return " ".join(parts) + " nedir" + (f" ({days})?" if days else "?")
