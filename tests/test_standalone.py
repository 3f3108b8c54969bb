"""Questions in full."""

from __future__ import annotations

import datetime

import pytest

from offerscope.operators.standalone import qualifiers, standalone

D = datetime.date


@pytest.mark.parametrize(
    "folded,names,expected",
    [
        ("kredi kartinin yillik ucreti ne kadar?", ([], ["KART"], ["fee"], "current", None, None, None), "guncel kredi karti yillik ucreti nedir?"),
        ("peki 2025 yilinda?", (["Vakif Katilim"], ["KONUT_FINANSMANI"], ["rate"], "historical", 2025, None, None), "Vakif Katilim 2025 konut finansmani yilinda orani nedir?"),
        ("en dusuk oranli uc konut kampanyasini karsilastir", ([], ["KONUT_FINANSMANI"], ["rate"], "current", None, None, None), "guncel konut finansmani oranli kampanyasini en dusuk orani uc karsilastir nedir?"),
        ("en uzun vade hangi bankada", ([], [], ["maturity"], "all", None, None, None), "tum donem en yuksek vade suresi nedir?"),
        ("1.5.2026 - 30 haziran 2026 kampanyalari", ([], ["KART_KAMPANYASI"], [], "current", None, D(2026, 5, 1), D(2026, 6, 30)), "guncel kart kampanyasi nedir (2026-05-01 - 2026-06-30)?"),
        ("120 ay vadeli 2 m2", ([], [], ["maturity"], "current", None, None, None), "guncel vadeli 120 ay 2 m2 vade suresi nedir?"),
        ("onceki cevapta 120 ay dedin", ([], [], ["maturity"], "current", None, None, None), "guncel vade suresi nedir?"),
        ("konut oranlari listele", ([], ["KONUT_FINANSMANI"], ["rate"], "current", None, None, None), "guncel konut finansmani orani listele nedir?"),
        ("goster", (["X"], ["NEW_KIND"], ["other"], "current", None, None, D(2026, 1, 1)), "X guncel new kind nedir (2026-01-01)?"),
    ],
)
def test_golden(folded, names, expected):
    assert standalone(folded, *names) == expected


def test_qualifiers_leave_out_what_is_named():
    assert qualifiers("ziraat katilimin konut finansmaninda memurlara ozel oranlari", ["Ziraat Katilim"], ["KONUT_FINANSMANI"], ["rate"]) == ["memurlara", "ozel"]
    assert qualifiers("", [], [], []) == []
