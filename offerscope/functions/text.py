"""Column expressions for identity and normalisation of texts, URLs, numbers.

All are native expressions, so they fold, push down and stay in generated code. Accents are
removed by a letter table (Latin, with Turkish dotless and dotted i first), which equals
compatibility decomposition for the letters listed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters by base letter.
ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň",
    "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_FROM = "".join(v + v.upper().replace("I", "") for v in ACCENTS.values()) + "İ"
_TO = "".join(k * len(v + v.upper().replace("I", "")) for k, v in ACCENTS.items()) + "i"
WHITE = r"[ \t\n\x0B\f\r]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(col: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(col), WHITE, " "))


def fold_text(col: Column | str) -> Column:
    """Accents removed, lower case, white space squeezed; I and dotted/dotless i are one letter."""
    return squeeze(F.replace(F.lower(F.translate(_c(col), _FROM, _TO)), F.lit("ß"), F.lit("ss")))


def normalize_alnum(col: Column | str, decode: bool = False) -> Column:
    """fold_text, then everything but letters, digits and % as one space; URL-decoded first if asked."""
    col = F.coalesce(F.try_url_decode(_c(col)), _c(col)) if decode else _c(col)
    return F.trim(F.regexp_replace(fold_text(col), "[^a-z0-9%]+", " "))


def content_digest(col: Column | str) -> Column:
    """SHA-256 of the squeezed text, case kept."""
    return F.sha2(squeeze(col), 256)


def stable_digest(*cols: Column | str) -> Column:
    """SHA-256 of folded parts joined by the unit separator; null is an empty part."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(fold_text(_c(c).cast("string")), F.lit("")) for c in cols)), 256)


def canonical_url_archive(col: Column | str) -> Column:
    """https, host lowered without www., path decoded and squeezed, no query and no fragment; null for what has no host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(F.trim(_c(col)), F.lit("HOST"))), r"^www\.", "")
    raw = F.try_parse_url(F.trim(_c(col)), F.lit("PATH"))
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "/+", "/"), "/$", "")
    return F.concat(F.lit("https://"), host, path)


# Query keys that track visits.
TRACKING = ("fbclid", "gclid", "gad_source", "mc_cid", "mc_eid", "msclkid", "ref", "yclid")


def canonical_url_offer(col: Column | str) -> Column:
    """Scheme and port kept, host lowered, query sorted without utm_* and tracking keys, no fragment; malformed: folded text."""
    url = F.trim(_c(col))
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+:(\d+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+", "/"), "/$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when((scheme == "") | (host == "") | url.rlike(r"^[^/]*//[^/?#:]+:[^/?#\d]"), fold_text(url)).otherwise(F.concat(scheme, F.lit("://"), host, shown, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def parse_number(col: Column | str, mode: str = "last") -> Column:
    """Number from text with Turkish separators, null if there is none.

    last: with both marks the later one is decimal, and a lone mark before exactly three digits
    is for thousands; dots: with both marks dots are always for thousands; comma: a comma is
    always decimal and dots only group thousands.
    """
    raw = F.regexp_extract(_c(col), r"-?\d[\d.,]*", 0)
    raw = F.regexp_replace(raw, "[.,]+$", "")
    no_dots, no_commas = F.replace(raw, F.lit("."), F.lit("")), F.replace(raw, F.lit(","), F.lit(""))
    decimal_comma = F.replace(no_dots, F.lit(","), F.lit("."))
    if mode == "comma":
        grouped = raw.rlike(r"^-?\d{1,3}(\.\d{3})+$")
        text = F.when(raw.contains(","), decimal_comma).when(grouped, no_dots).otherwise(raw)
    else:
        both = decimal_comma if mode == "dots" else F.when(F.length(F.substring_index(raw, ",", -1)) < F.length(F.substring_index(raw, ".", -1)), decimal_comma).otherwise(no_commas)
        text = F.when(raw.contains(",") & raw.contains("."), both).when(raw.rlike(r"^-?\d+([.,]\d{3})+$"), F.regexp_replace(raw, "[.,]", "")).otherwise(F.replace(raw, F.lit(","), F.lit(".")))
    return text.try_cast("double")


def has_suspicious_chars(col: Column | str) -> Column:
    """Replacement character, private use, or superscript two and three."""
    return _c(col).rlike("[\\uFFFD\\p{Co}²³]")


def record_key(source: Column | str, url: Column | str) -> Column:
    """live-<slug>-<24 hex digits of the URL's digest>."""
    slug = F.regexp_replace(F.regexp_replace(fold_text(source), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit("live-"), slug, F.lit("-"), F.substring(F.sha2(canonical_url_archive(url), 256), 1, 24))


# Month names of dates in texts.
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")


def dates_in_text(col: Column | str) -> Column:
    """Sorted distinct dates of a text: dd.mm.yyyy, yyyy-mm-dd, and day, month word, year; impossible ones are left out."""
    text = fold_text(col)
    dmy, ymd = r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b"
    word = rf"\b(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{4}})\b"

    def found(pattern: str, year: int, day: int, month: int | None) -> Column:
        part = lambda d, g: F.regexp_extract(d, pattern, g)
        number = lambda d: F.array_position(F.array(*map(F.lit, MONTHS)), part(d, 2)) if month is None else part(d, month)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda d: F.try_to_timestamp(F.concat_ws("-", part(d, year), number(d).cast("string"), part(d, day)), F.lit("yyyy-M-d")).cast("date"))

    return F.array_sort(F.array_distinct(F.array_compact(F.concat(found(dmy, 3, 1, 2), found(ymd, 1, 3, 2), found(word, 3, 1, None)))))


def ordered_dates(col: Column | str, year: Column | None = None, reference: Column | None = None, repair: bool = True) -> Column:
    """Dates of a text in its order: dd.mm.yyyy (also / and -), ISO, "d month [year]" and "d-d month year"; impossible ones are left out.

    A missing year is that of the next date that has one, else of the one before, else `year`, else the date is left out.
    If two dates are all and the second comes first, the one whose year was missing moves by a year; if both were missing,
    that of the two readings which holds the reference date, if exactly one does. Without `repair` they stay as they are.
    """
    text, months = fold_text(col), "|".join(MONTHS)
    short = rf"(?<!\d)(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s+({months})\s+((?:19|20)\d{{2}})(?!\d)"
    iso, numeric = r"(?<!\d)((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?!\d)"
    word = rf"(?<!\d)(\d{{1,2}})\s+({months})(?:\s+(\d{{4}}))?"
    part = lambda x, p, g: F.regexp_extract(x, p, g).try_cast("int")
    named = lambda x, p, g: F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(x, p, g)).cast("int")
    date = lambda d, m, y: F.struct(d.alias("d"), m.alias("m"), y.alias("y"))

    def read(x: Column) -> Column:
        return (
            F.when(x.rlike(f"^{short}"), F.array(date(part(x, short, 1), named(x, short, 3), part(x, short, 4)), date(part(x, short, 2), named(x, short, 3), part(x, short, 4))))
            .when(x.rlike(f"^{iso}"), F.array(date(part(x, iso, 3), part(x, iso, 2), part(x, iso, 1))))
            .when(x.rlike(f"^{numeric}"), F.array(date(part(x, numeric, 1), part(x, numeric, 2), part(x, numeric, 3))))
            .otherwise(F.array(date(part(x, word, 1), named(x, word, 2), part(x, word, 3))))
        )

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"{short}|{iso}|{numeric}|{word}"), F.lit(0)), read))
    fallback = F.lit(None).cast("int") if year is None else year

    def dated(found: Column) -> Column:
        years = lambda part: F.filter(F.transform(part, lambda m: m["y"]), lambda y: y.isNotNull())
        near = lambda m, i: F.coalesce(m["y"], F.get(years(F.slice(found, i + 2, F.size(found))), F.lit(0)), F.try_element_at(years(F.slice(found, F.lit(1), i)), F.lit(-1)), fallback)
        return F.array_compact(F.transform(found, lambda m, i: F.try_to_timestamp(F.concat(near(m, i), F.lit("-"), m["m"], F.lit("-"), m["d"]), F.lit("yyyy-M-d")).cast("date")))

    def moved(day: Column, n: int) -> Column:
        other = F.add_months(day, 12 * n)
        return F.when(F.dayofmonth(other) == F.dayofmonth(day), other)

    def mended(s: Column) -> Column:
        a, b, first, second = F.get(s["days"], F.lit(0)), F.get(s["days"], F.lit(1)), F.get(s["found"], F.lit(0))["y"], F.get(s["found"], F.lit(1))["y"]
        earlier, later = F.array(moved(a, -1), b), F.array(a, moved(b, 1))
        ref = F.lit(None).cast("date") if reference is None else reference
        holds = lambda p: F.coalesce(ref.between(F.get(p, F.lit(0)), F.get(p, F.lit(1))), F.lit(False))
        one = F.when(first.isNotNull() & second.isNull(), later).when(first.isNull() & second.isNotNull(), earlier).when(first.isNull() & second.isNull() & (holds(earlier) != holds(later)), F.when(holds(earlier), earlier).otherwise(later))
        whole = F.when((F.size(s["days"]) == 2) & (F.size(s["found"]) == 2) & (b < a) & ~F.exists(one, lambda d: d.isNull()), one)
        return F.coalesce(whole, s["days"]) if repair else s["days"]

    # each step reads the one before as the element of an array, so it is computed once
    steps = F.transform(F.transform(F.array(found), lambda f: F.struct(f.alias("found"), dated(f).alias("days"))), mended)
    return F.when(text.isNotNull(), F.get(steps, F.lit(0)))
