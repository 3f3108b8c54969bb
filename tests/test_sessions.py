"""Turns of sessions: a golden for each transition, then random sessions in other orders, batches and as a stream."""

from __future__ import annotations

import datetime
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from offerscope.operators import entities, sessions
from offerscope.operators.sessions import Offer, State

D = datetime.date
OFFER = [("first", "Ziraat Katilim", ["KONUT_FINANSMANI"], 1), ("second", "Vakif Katilim", ["KONUT_FINANSMANI"], 2), ("third", "Kuveyt Turk", ["TASIT_FINANSMANI"], 3)]
RANKED = [Offer(*o) for o in OFFER]


@pytest.fixture(scope="module")
def read(spark):
    """Reads many texts in one job; gives a function from text to turn."""
    texts = sorted({t for t, *_ in GOLDEN} | {"Konut finansmanlarini karsilastir.", "Konut vade"})
    rows = sessions.read_turns(spark.createDataFrame([(t, D(2026, 5, 4)) for t in texts], "text string, asked_on date"))
    found = {r["text"]: sessions.Turn(r.asDict(True)) for r in rows.collect()}
    return found.__getitem__


def state(**k):
    return State(**({"asked": True} | k))


GOLDEN = [
    # (text, state, what the route must say)
    ("Merhaba, nasılsın?", State(), {"transition": "chat", "intent": "chat"}),
    ("Bitcoin ne olur?", state(banks=["Kuveyt Turk"]), {"transition": "chat"}),
    ("Peki vadesi ne kadar?", State(), {"transition": "no_context", "intent": "clarification", "asks_back": "context", "fields": ["maturity"]}),
    ("Peki vadesi ne kadar?", state(banks=["Ziraat Katilim"], products=["KONUT_FINANSMANI"], fields=["amount"]), {"transition": "carried", "banks": ["Ziraat Katilim"], "products": ["KONUT_FINANSMANI"], "fields": ["maturity"], "inherited": ["banks", "products", "scope"]}),
    ("Vakıf Katılım'ın vadesi ne kadar?", state(banks=["Ziraat Katilim"], products=["KONUT_FINANSMANI"], active=["x"]), {"banks": ["Vakif Katilim"], "products": ["KONUT_FINANSMANI"], "offer_ids": []}),
    ("İkincisinin vadesi nedir?", state(ranked=RANKED), {"transition": "ordinal", "banks": ["Vakif Katilim"], "products": ["KONUT_FINANSMANI"], "offer_ids": ["second"], "intent": "lookup"}),
    ("Üçüncünün vadesi nedir?", state(ranked=RANKED[::-1]), {"offer_ids": ["third"]}),
    ("Üçüncüsü nedir?", state(ranked=RANKED[:2], banks=["Ziraat Katilim"]), {"transition": "ordinal", "asks_back": "offer", "banks": ["Ziraat Katilim"], "offer_ids": []}),
    ("Bunun vadesi nedir?", state(ranked=RANKED[:1]), {"transition": "pointed", "offer_ids": ["first"], "asks_back": None}),
    ("Bunun vadesi nedir?", state(ranked=RANKED), {"asks_back": "offer", "offer_ids": ["first", "second", "third"], "banks": ["Ziraat Katilim", "Vakif Katilim", "Kuveyt Turk"]}),
    ("Bunun vadesi nedir?", state(ranked=RANKED, active=["second"]), {"offer_ids": ["second"], "banks": ["Vakif Katilim"]}),
    ("Bu teklif taşıt için mi?", state(ranked=RANKED), {"offer_ids": [], "products": ["TASIT_FINANSMANI"], "banks": ["Kuveyt Turk"], "asks_back": None}),
    ("Bunun vadesi nedir?", state(active=["only"], banks=["Kuveyt Turk"]), {"transition": "pointed", "offer_ids": ["only"], "banks": ["Kuveyt Turk"]}),
    ("Bunun vadesi nedir?", state(active=["a", "b"]), {"asks_back": "offer", "offer_ids": ["a", "b"]}),
    ("Onun vadesi nedir?", state(banks=["Ziraat Katilim", "Vakif Katilim"], products=["KONUT_FINANSMANI"]), {"asks_back": "offer", "intent": "clarification"}),
    ("Bu ne kadar?", State(), {"transition": "no_context", "asks_back": "context"}),
    ("Aynı bankanın masrafı ne?", state(banks=["Ziraat Katilim"], wide=True), {"transition": "same_bank", "banks": ["Ziraat Katilim"], "fields": ["fee"]}),
    ("Aynı bankanın masrafı ne?", state(banks=["Ziraat Katilim", "Vakif Katilim"], year=2025, scope="historical"), {"transition": "same_bank", "asks_back": "bank", "scope": "historical", "year": None}),
    ("Peki tutarları ne kadar?", state(banks=["Vakif Katilim", "Turkiye Finans"], wide=True, products=["KONUT_FINANSMANI"]), {"banks": [], "products": ["KONUT_FINANSMANI"], "inherited": ["products", "scope"]}),
    ("2025'te nasıldı?", state(banks=["Ziraat Katilim"], products=["KONUT_FINANSMANI"], active=["x"], fields=["amount"]), {"banks": ["Ziraat Katilim"], "fields": ["amount"], "scope": "historical", "year": 2025, "offer_ids": [], "intent": "historical"}),
    ("Hayır, Nisan-Haziran 2026 kampanyalarını göster.", state(banks=["Vakif Katilim"], products=["KART_KAMPANYASI"], scope="historical", year=2025, active=["x"]), {"since": D(2026, 4, 1), "until": D(2026, 6, 30), "year": None, "offer_ids": [], "fields": ["campaign_date"]}),
    ("Tüm dönem için göster.", state(banks=["Vakif Katilim"], products=["KONUT_FINANSMANI"], scope="historical", year=2025, since=D(2025, 1, 1), until=D(2025, 12, 31)), {"scope": "all", "year": None, "since": None, "until": None, "banks": ["Vakif Katilim"]}),
    ("Şimdi Vakıf Katılım taşıt finansmanına geçelim.", state(banks=["Ziraat Katilim"], products=["KONUT_FINANSMANI"], scope="historical", year=2025, active=["x"]), {"transition": "topic", "banks": ["Vakif Katilim"], "products": ["TASIT_FINANSMANI"], "scope": "current", "year": None, "offer_ids": []}),
    ("Biraz daha detaylı anlat.", state(banks=["Vakif Katilim"], products=["KONUT_FINANSMANI"], fields=["rate"], scope="historical", year=2024, active=["x"]), {"transition": "carried", "year": 2024, "scope": "historical", "offer_ids": ["x"], "fields": ["rate"], "inherited": ["banks", "products", "fields", "year", "scope", "offer_ids"]}),
    ("Konut finansmanlarını karşılaştır.", State(), {"transition": "fresh", "intent": "compare", "products": ["KONUT_FINANSMANI"]}),
    ("1990 yılındaki mobil uygulama kampanyasının ödülü neydi?", state(banks=["Albaraka Turk"], products=["KART_KAMPANYASI"], active=["x"]), {"year": 1990, "scope": "historical", "products": ["MOBIL_UYGULAMA_KAMPANYASI"], "offer_ids": []}),
    ("Kredi kartı ödülü nedir?", State(), {"products": ["KART_KAMPANYASI"], "fields": ["reward"]}),
    ("Aktif kampanyalarda puan ne?", State(), {"since": D(2026, 5, 4), "until": D(2026, 5, 4), "products": ["KART_KAMPANYASI"]}),
    ("En düşük oran hangi üründe?", State(), {"intent": "compare"}),
    ("Kuveyt Türk en düşük oran ne?", State(), {"intent": "lookup", "banks": ["Kuveyt Turk"]}),
    ("Toplam ücret farkı ne kadar?", State(), {"intent": "calculate"}),
    ("Bankaların konut oranlarını getir.", State(), {"intent": "list"}),
]


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(read, i):
    text, before, expected = GOLDEN[i]
    r = sessions.resolve(read(text), before)
    assert {k: getattr(r, k) for k in expected} == expected


def test_state_after_a_turn(read):
    fresh = sessions.resolve(read("Konut vade"), State())
    s = sessions.after(State(), fresh, RANKED, True)
    assert (s.wide, s.active, s.banks, s.products) == (True, [], ["Ziraat Katilim", "Vakif Katilim", "Kuveyt Turk"], ["KONUT_FINANSMANI"])
    back = sessions.resolve(read("Bunun vadesi nedir?"), s)
    assert back.asks_back == "offer" and sessions.after(s, back, RANKED[:1], True) is s
    nth = sessions.resolve(read("İkincisinin vadesi nedir?"), s)
    t = sessions.after(s, nth, RANKED[1:2], True)
    assert (t.wide, t.active, [o.offer_id for o in t.ranked]) == (False, ["second"], ["second"])
    unsure = sessions.after(t, sessions.resolve(read("Konut vade"), t), [], False)
    assert (unsure.wide, unsure.banks, unsure.products, unsure.ranked) == (True, [], ["KONUT_FINANSMANI"], [])
    more = sessions.after(t, sessions.resolve(read("Biraz daha detaylı anlat."), t), [], False)
    assert (more.banks, more.active, more.ranked) == (["Vakif Katilim"], ["second"], t.ranked)
    moved = sessions.after(t, sessions.resolve(read("2025'te nasıldı?"), t), [], False)
    assert (moved.year, moved.active, moved.ranked) == (2025, [], [])


TEXTS = [t for t, *_ in GOLDEN] + [None, "", "oran", "Ziraat Katılım konut oranı nedir?", "Kuveyt Türk taşıt vadesi?", "peki 2024?", "hepsi", "teşekkürler"]


def random_turns(seed, n=40):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(rng.randint(1, 12)):
            picked = rng.sample(OFFER, rng.randint(0, 3))
            out.append((f"s{c}", k, rng.choice(TEXTS), [(o, b, p, i + 1) for i, (o, b, p, _) in enumerate(picked)], rng.random() < 0.7, D(2026, 5, 4), datetime.datetime(2026, 5, 4, 10, 0, c % 60)))
    return out


SCHEMA = f"conv_id string, turn long, text string, offers {sessions.OFFERS}, verified boolean, asked_on date, ts timestamp"


def plain(rows):
    return sorted(str(sorted(r.asDict(True).items())) for r in rows)


def by_hand(turns, read):
    """One session after the other in plain loops."""
    out, states, last = [], {}, {}
    for key, turn, text, offers, verified, *_ in sorted(turns, key=lambda t: (t[0], t[1])):
        if turn <= last.get(key, -1):
            continue
        last[key] = turn
        s = states.get(key, State())
        r = sessions.resolve(read(text), s)
        states[key] = sessions.after(s, r, [Offer(*o) for o in offers], verified)
        out.append(str(sorted({"conv_id": key, "turn": turn, **vars(r)}.items())))
    return sorted(out)


def test_fold_equals_plain_loops(spark):
    turns = random_turns(1)
    read = {r["text"]: sessions.Turn(r.asDict(True)) for r in sessions.read_turns(spark.createDataFrame([(t, D(2026, 5, 4)) for t in TEXTS], "text string, asked_on date")).collect()}
    got = sessions.fold_sessions(spark.createDataFrame(turns, SCHEMA).repartition(5)).collect()
    assert plain(got) == by_hand(turns, read.__getitem__)
    assert len({r.transition for r in got}) == 8 and {r.asks_back for r in got} == {None, "context", "offer", "bank"}


def test_repeats_nulls_and_empty(spark):
    turns = random_turns(2, 5)
    df = spark.createDataFrame(turns, SCHEMA)
    odd = spark.createDataFrame([(None, 1, "x", None, None, None, None), ("s0", None, "x", None, None, None, None)], SCHEMA)
    assert plain(sessions.fold_sessions(df.unionAll(df).unionAll(odd)).collect()) == plain(sessions.fold_sessions(df).collect())
    assert sessions.fold_sessions(df.limit(0)).collect() == []
    bare = sessions.fold_sessions(df.select("conv_id", "turn", "text"))
    assert bare.count() == len(turns)


def stream_of(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")


def replay(spark, folder, checkpoint, name, ttl):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = sessions.session_stream(src, ttl, summary=200)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_stream_equals_table(spark):
    turns = random_turns(3, 12)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parts = [[t for t in turns if t[1] < 3], [t for t in turns if t[1] in (2, 3, 4, 5)], [t for t in turns if t[1] > 5]]  # turn 2 comes twice
    stream_of(spark, folder, parts)
    replay(spark, folder, f"{folder}/c", "replayed", 30 * 86400)
    got = spark.table("replayed")
    assert plain(got.drop("version", "summary").collect()) == plain(sessions.fold_sessions(spark.createDataFrame(turns, SCHEMA)).collect())
    last = got.groupBy("conv_id").agg(F.max("version").alias("v"), F.count("*").alias("n"), F.max(F.length("summary")).alias("m")).collect()
    assert all(r.v == r.n and r.m <= 200 for r in last)


def test_state_is_empty_after_the_time_to_live(spark):
    at = lambda day, h: datetime.datetime(2026, 5, day, h)
    row = lambda key, turn, text, ts: (key, turn, text, [OFFER[0]], True, D(2026, 5, 4), ts)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parts = [
        [row("a", 1, "Ziraat Katılım konut oranı nedir?", at(1, 1)), row("b", 1, "Ziraat Katılım konut oranı nedir?", at(1, 1))],
        [row("b", 2, "Peki vadesi?", at(1, 20))],  # puts off the end of b
        [row("z", 1, "oran", at(2, 4))],  # the watermark passes a's end
        [row("a", 2, "Peki vadesi?", at(2, 5)), row("b", 3, "Peki vadesi?", at(2, 5))],
        [row("z", 2, "oran", at(9, 1))],
        [row("z", 3, "oran", at(9, 2))],
    ]
    stream_of(spark, folder, parts)
    replay(spark, folder, f"{folder}/c", "expired", 86400)
    got = {(r.conv_id, r.turn): r for r in spark.table("expired").collect()}
    assert got["b", 2].transition == got["b", 3].transition == "carried" and got["b", 3].version == 3
    assert got["a", 2].transition == "no_context" and got["a", 2].version == 1
    left = spark.read.format("statestore").option("stateVarName", "session").load(f"{folder}/c").select("key").collect()
    assert {r.key[0] for r in left} == {"z"}


def test_entities_equal_one_pattern_an_alias(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(300)]
    kinds = {"x": ({f"n{i}": [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3)] for i in range(800)}, ["da", "e", "b"]), "y": ({f"m{i}": [rng.choice(words)] for i in range(50)}, None)}
    v = entities.Vocabulary(kinds, {"n1": ("n2",)})
    for _ in range(60):
        text = " ".join(w + rng.choice(["", "", "da", "e", "q"]) for w in rng.choices(words, k=rng.randint(0, 12)))
        expected = []
        for names, endings in kinds.values():
            tail = r"" if endings is None else f"(?:{'|'.join(endings)})?(?!\\w)"
            found = [n for n, aliases in names.items() if any(re.search(rf"(?<!\w){re.escape(a)}{tail}", text) for a in aliases)]
            expected.append([n for n in found if not (n == "n2" and "n1" in found)])
        assert v.find(text) == expected


def test_entities_of_a_table(spark):
    rows = spark.createDataFrame([(1, "Kuveyt Türk'ün kart kampanyasını ve ödülü"), (2, None), (3, "mobil kampanya ve kart")], "id long, text string")
    got = {r.id: (r.banks, r.products, r.fields) for r in entities.with_entities(rows, entities.standard()).collect()}
    assert got == {1: (["Kuveyt Turk"], ["KART_KAMPANYASI"], ["reward"]), 2: ([], [], []), 3: ([], ["MOBIL_UYGULAMA_KAMPANYASI"], [])}
    aliases = spark.createDataFrame([("bank", "A", "Ünlü Banka"), ("bank", "B", "—"), ("bank", "A", "unlu")], "kind string, name string, alias string")
    v = entities.vocabulary_of(aliases, {"bank": ["nin"]})
    assert v.find("unlu bankanin ve x") == [["A"]] and v.find("unlux") == [[]]
