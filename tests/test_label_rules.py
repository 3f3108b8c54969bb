"""Ordered label rules against goldens and a plain loop."""

from __future__ import annotations

import random

import pytest

from offerscope.operators import label_rules as L


def loop(surface, rules, campaign=False):
    """Rule by rule."""
    if surface is None:
        return None, None
    for r in rules:
        if r.campaign and not campaign:
            continue
        if r.whole:
            fits = surface.strip() in r.phrases
        else:
            fits = any(p in surface for p in r.phrases) and (not r.also or any(p in surface for p in r.also))
        if fits:
            return r.label, r.reason
    return None, None


@pytest.mark.parametrize(
    "title,url,campaign,expected",
    [
        ("Konut Finansmanı", "https://x.com/tr/konut-finansmani", False, ("KONUT_FINANSMANI", "KONUT_FINANSMANI", False)),
        ("Kredi Kartı İndirimi", "https://x.com/kampanya/1", True, ("KART_KAMPANYASI", "DIGER_KAMPANYA", True)),
        ("Kredi Kartı İndirimi", None, False, ("KART_URUNU", None, False)),
        ("Market indirimi", "not a url", True, ("DIGER_KAMPANYA", None, False)),
        ("Finansman", "https://x.com/finansman-urunleri", None, ("DIGER_FINANSMAN", "DIGER_FINANSMAN", True)),
        ("Finansman hakkında", "https://x.com/kobi", None, (None, None, False)),
        ("Konut ve ev sahibi olmak", "https://x.com/KOB%C4%B0/Krediler", None, ("KONUT_FINANSMANI", None, False)),
        ("Hızlı Finansman", "https://x.com/tarim/leasing", None, ("DIGER_FINANSMAN", "TICARI_FINANSMAN", False)),
        (None, "", None, (None, None, False)),
    ],
)
def test_golden(spark, title, url, campaign, expected):
    page = spark.createDataFrame([(1, title, None, url, campaign)], "doc_id long, title string, text string, url string, is_campaign boolean")
    r = L.label_pages(page).first()
    assert (r.title_label, r.url_label, r.url_advises) == expected and r.body_label is None


def test_random_texts_equal_a_plain_loop(spark):
    rng = random.Random(2)
    vocab = [p.strip() for r in L.TEXT_RULES for p in r.phrases + r.also] + ["ve", "icin", "hakkimizda", "urun"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 3))), " ".join(rng.choices(vocab[-20:], k=rng.randint(0, 4))), None, rng.random() < 0.4) for i in range(400)]
    got = {r.doc_id: r for r in L.label_pages(spark.createDataFrame(rows, "doc_id long, title string, text string, url string, is_campaign boolean")).collect()}
    for i, title, text, _, campaign in rows:
        assert (got[i].title_label, got[i].title_reason) == loop(f" {title} ", L.TEXT_RULES, campaign)
        assert (got[i].body_label, got[i].body_reason) == loop(f" {text} ", L.TEXT_RULES, campaign)
    assert len({r.title_reason for r in got.values()}) > 12


def test_rules_are_a_parameter(spark):
    page = spark.createDataFrame([(1, "A b", "c", None, None)], "doc_id long, title string, text string, url string, is_campaign boolean")
    r = L.label_pages(page, (L.LabelRule("X", "own", ("c",)),), L.PATH_RULES).first()
    assert (r.title_label, r.body_label, r.body_reason) == (None, "X", "own")
