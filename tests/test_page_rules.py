from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from offerscope.functions import text as X
from offerscope.operators import page_rules as P
from offerscope.operators import roles as R

WORDS = "ve uzeri|en az|harcama|alisverise|tek seferde|bonus|hediye|iade|indirim|toplamda|kadarsa|puan kazan|ye|bugun|kart|,|finansman orani|oranla|kar payi|minimum|sonra gelir".split("|")


def plain_amounts(text):
    """(amount, role) in order, by the description."""
    money = [m.span() for m in re.finditer(R.MONEY, text)]
    for m in re.finditer(R.AMOUNT, text):
        a, b = m.span()
        left = max([0, a - 100] + [e for _, e in money if e <= a])
        right = min([len(text), b + 130] + [s for s, _ in money if s >= b])
        before, after = text[left:a], text[b:right]
        rewarded = lambda t: re.search(R.REWARD, t)
        if re.search(R.OVER_AFTER, after) or re.search(R.SPEND_AFTER, after[:70]) or (re.search(R.LEAST, before[-65:]) and (re.search(R.SPEND, before) or re.search(R.SPEND, after))):
            yield m[0], "spend_threshold"
        elif rewarded(after[:100]) or rewarded(before[-65:]) or re.search(R.FOR_SPENDING, before[-55:]) or (rewarded(text[b : b + 220]) and (re.search(R.IN_ALL, after) or re.search(R.TIER, before[-55:]))):
            yield m[0], "reward"
        else:
            yield m[0], "discount" if "indirim" in after[:65] + "|" + before[-55:] else None


def plain_percents(text):
    for m in re.finditer(R.PERCENT, text):
        a, b = m.span()

        def far(cues):
            found = [p.start() - b for c in cues for p in re.finditer(f"(?={c})", text) if b <= p.start() and p.start() + len(c) <= b + 130]
            found += [a - p.start() - len(c) for c in cues for p in re.finditer(f"(?={c})", text) if a - 130 <= p.start() and p.start() + len(c) <= a]  # noqa: B023
            return min(found, default=10**9)

        finance, discount = far(R.FINANCE_CUES), far(R.DISCOUNT_CUES)
        yield m[0], None if min(finance, discount) == 10**9 else "finance" if finance < discount else "discount"


def test_roles_equal_the_plain_ones(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        parts = [rng.choice(WORDS) if rng.random() < 0.8 else rng.choice(["%12", "250 tl", "1.500,50 tl", "40 usd", "7 %"]) for _ in range(rng.randint(1, 40))]
        texts.append(re.sub(r"\s+", " ", " ".join(parts)).strip())
    rows = spark.createDataFrame(list(enumerate([*texts, "", None])), "id long, evidence string")
    for f, plain, name in ((R.amount_roles, plain_amounts, "amount"), (R.percent_roles, plain_percents, "percent")):
        got = sorted((r.id, r[name], r.role or "") for r in f(rows).collect())
        assert got == sorted((i, v, role or "") for i, t in enumerate(texts) for v, role in plain(t))
        assert len({r for _, _, r in got}) > 2


def test_ordered_dates(spark):
    cases = {
        "1 Ocak - 28 Şubat 2026": ["2026-01-01", "2026-02-28"], "3-5 Mart 2026 ve 2026-04-01": ["2026-03-03", "2026-03-05", "2026-04-01"], "20 Aralık 2025 - 10 Ocak": ["2025-12-20", "2026-01-10"],
        "20 Aralık - 10 Ocak": ["2025-12-20", "2026-01-10"], "10 Mart ile 5 Mayıs": ["2026-03-10", "2026-05-05"], "31.02.2026": [], "5.6.2026, 4.5.2026": ["2026-06-05", "2026-05-04"], "": [], None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = rows.select("id", X.ordered_dates("t", F.lit(2026), F.lit("2026-01-02").cast("date")).cast("array<string>").alias("d")).orderBy("id").collect()
    assert [r.d for r in got] == list(cases.values())


def test_context_verdicts(spark):
    cases = [
        ("VADE_SURESI", "Vade 12 ay, taahhüt süresi uzatılır.", "12 ay", True, "excluded_commitment_extension_context"), ("VADE_SURESI", "Erken ödeme halinde vade 12 ay.", "12 ay", True, "excluded_early_payment_context"),
        ("VADE_SURESI", "En az 5 yıl ikamet edenler.", "5 yıl", False, "excluded_residency_duration_context"), ("FINANSMAN_TUTARI", "Toplam geri ödeme 100 TL.", "100 TL", False, "excluded_total_repayment_context"),
        ("FINANSMAN_TUTARI", "Finansman limiti 100 TL.", "100 TL", True, None), ("ODUL_TUTARI", "ATM'den çekim 500 TL'ye kadar iade.", "", True, "excluded_withdrawal_limit_context"), ("TAKSIT_SAYISI", "6 taksit", "6", True, None),
        ("INDIRIM_TUTARI", "50 TL indirim", "50 TL", True, None), ("INDIRIM_TUTARI", "50 TL bonus", "50 TL", False, "excluded_non_discount_amount_context"), ("KAR_PAYI_ORANI", "%3 indirim", "%3", False, "excluded_discount_rate_context"),
        ("UNKNOWN", "anything", "x", False, None), ("VADE_SURESI", None, None, False, None), (None, "text", "text", False, None),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id int, label string, evidence string, value string")
    got = R.context_verdicts(rows).orderBy("id").collect()
    assert [(r.rule_ok, r.excluded) for r in got] == [c[3:] for c in cases]


def test_snapshot_facts(spark):
    rows = [
        (1, "KAMPANYA_TARIH_ARALIGI", "1 Ocak – 5 Ocak", None, "e", "accepted", 0.9, 0), (1, "KAMPANYA_TARIH_ARALIGI", "1 Ocak - 5 Ocak 2026", None, "e", "review", 0.5, 1),
        (1, "BASVURU_KANALI", "Şube", None, "Mobil şube yeter", "accepted", 0.9, 2), (1, "BASVURU_KANALI", "mobil şube", None, "Mobil şube yeter", "accepted", 0.9, 3), (2, "BASVURU_KANALI", "Şube", None, "Mobil şube veya şube", "accepted", 0.9, 4),
        (2, "BASVURU_KANALI", "mobil şube", None, "Mobil şube veya şube", "accepted", 0.9, 5), (2, "MEVDUAT_GUVENCESI", "TMSF", None, "", "accepted", 0.9, 6), (2, "MEVDUAT_GUVENCESI", "Tasarruf Mevduatı Sigorta Fonu", None, None, "accepted", 0.9, 7),
        (2, "X", "bir", '{"v":1}', "e", "rejected", 0.9, 8), (2, "X", "1", '{"v":1}', "e", "review", None, 9), (2, None, None, None, None, None, None, 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, fact_type string, fact_text string, normalized string, evidence string, decision string, confidence double, ordinal int")
    assert sorted(r.ordinal for r in P.dedup_snapshot_facts(df).collect()) == [1, 3, 4, 5, 7, 9, 10]
    assert P.dedup_snapshot_facts(df.limit(0)).count() == 0


def plain_spans(text, rules, priorities):
    found = []
    for r in rules:
        for m in re.finditer(r.pattern, text, re.I):
            around = text[max(0, m.start() - r.radius) : m.end() + r.radius]
            if (not r.context or re.search(r.context, around, re.I)) and not (r.forbidden and re.search(r.forbidden, around, re.I)):
                found.append((-priorities[r.label], m.start() - m.end(), m.start(), -r.confidence, r.label, m.end()))
    kept = []
    for s in sorted(found):
        if all(s[5] <= k[2] or k[5] <= s[2] for k in kept):
            kept.append(s)
    return {(s[4], s[2], s[5]) for s in kept}


def test_weak_spans_equal_the_plain_ones(spark):
    rng = random.Random(6)
    parts = ["%5", "12 ay", "6 taksit", "500 TL", "1.500 TL ve üzeri", "98/2", "7/24", "kâr payı", "indirim", "vade", "bonus", "limit", "paylaşım oranı", "uygulanmaz", "ve çok sonra gelen bir açıklama metni"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(150)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.label, r.start, r.stop) for r in P.weak_label_spans(rows).collect()}
    assert got == {(i, *s) for i, t in enumerate(texts) if t for s in plain_spans(t, P.WEAK_RULES, P.PRIORITIES)}
    assert len({g[1] for g in got}) == 7
