"""Questions of sessions, turn by turn: what each asks for, given what was asked and answered before.

A turn is read on its own first (names, period, wording, all in column expressions and one look-up of aliases). Then one pass over each
session's turns in order carries a small state: banks, products, fields, period, the offers of the last answer in their order.
The pass is a generator over sorted rows with the state of the current session only, so a session of any length takes constant memory;
a session is one task's by its nature. `fold_sessions` runs it on a table, `session_stream` on a stream with the state in the store.

Of each turn the first of these transitions that fits decides:
chat (small talk without a name), no_context (a follow-up in a new session), ordinal (the nth offer of the last answer), pointed (a pronoun that means one offer of the
last answer, or the one active offer), same_bank, carried (a follow-up takes over what it doesn't say), topic (a change of topic), fresh (says all itself).
ordinal, pointed and same_bank turn into a question back where nothing or more than one thing fits.

Defined results: turns need a session key and a number; rows without are left out; a turn that isn't newer than the session's last one is a repeat and is left out; null and
empty texts are small talk; offers of an answer are taken in the order of their ranks; a null `verified` counts as false.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from offerscope.functions.text import fold_text
from offerscope.operators.entities import Vocabulary, standard, with_entities
from offerscope.operators.questions import extract_period
from offerscope.operators.standalone import standalone

# Wordings in folded text, by what they mean.
ORDINALS = {"birincisi": 1, "ilki": 1, "ilk teklif": 1, "ikincisi": 2, "ikinci teklif": 2, "ucuncusu": 3, "ucuncunun": 3, "ucuncu teklif": 3}
WORDINGS = {
    "follows": ("peki", "onun", "bunun", "bu teklif", "ayni banka", "birincisi", "ikincisi", "ucuncusu", "ucuncunun"),
    "refers": ("bankanin", "dogru mu", "hayir", "icin de", "olanlari", "onceki cevap", "tum donem"),
    "softly": ("biraz daha", "daha detayli", "daha ayrintili", "devam et", "detaylandir", "ayrintilandir", "aciklar misin", "neden", "hangisi", "ozetle"),
    "turns": ("simdi", "gecelim", "konuyu degistir", "artik"),
    "foreign": ("bitcoin", "borsa tahmini", "doviz tahmini", "hava durumu", "kripto", "mac sonucu"),
    "casual": ("merhaba", "selam", "gunaydin", "iyi aksamlar", "iyi geceler", "nasilsin", "tesekkur", "sag ol", "adin ne", "sen kimsin", "ne yapabilirsin", "fikra", "sohbet edelim", "samimi"),
    "money": ("banka", "bankalar", "kampanya", "teklif", "urunleri", "finansman tutar", "finansman oran", "kar payi", "vade", "puan", "worldpuan", "altin puan", "harcama esigi", "masraf", "ucret", "aidat"),
    "period": ("guncel", "bugun", "gecmis", "arsiv", "tarihsel", "tum donem"),
    "all_periods": ("tum donem", "hepsi", "guncel ve gecmis"),
    "past": ("gecmis", "arsiv", "tarihsel", "onceki"),
    "past_year": ("gecmis", "arsiv", "tarihsel", "onceki yil"),
    "pronoun": ("onun", "bunun", "bu teklif"),
    "his": ("onun",),
    "same_bank": ("ayni banka",),
    "compares": ("karsilastir", "hangisi", "en avantajli", "gore sirala", "hangi banka"),
    "extreme": ("en dusuk", "en fazla", "en kisa", "en uzun", "en yuksek"),
    "lists": ("listele", "sirala", "nelerdir", "kac tane"),
    "shows": ("goster", "getir", "sun", "ver"),
    "campaign": ("kampanya",),
    "points": ("kampanya", "alisveris puan", "worldpuan", "altin puan"),
    "active": ("aktif", "devam eden", "halen gecerli"),
}
PATTERNS = {
    "this": r"(?<!\w)bu(?:nu|na|nun)?(?!\w)",
    "calculates": r"(?<!\w)(?:hesapla[a-z]*|toplam(?:i|ini|lari|larini)?|(?:aradaki\s+)?fark(?:i|ini)?\s+(?:kac|ne\s+kadar|hesapla[a-z]*)|(?:getiri|kazanc)(?:si|sini)?\s+(?:kac|ne\s+kadar))(?!\w)",
    "plural": r"\b[a-z]+(?:lar|ler)(?:i|ini|unu)?\b",
}
CAMPAIGNS = ("KART_KAMPANYASI", "MOBIL_UYGULAMA_KAMPANYASI")


def read_turns(turns: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", asked_on: str = "asked_on") -> DataFrame:
    """Adds what each turn says by itself: banks, products, fields, ordinal, year, since, until and `says`, the wordings that occur.

    Without a column of that name the day of asking is unknown and "active" sets no period. Works on streams.
    """
    known = with_entities(turns, vocabulary or standard(), text)
    t = F.coalesce(fold_text(F.col(text)), F.lit(""))
    ordinal = F.coalesce(*(F.when(F.contains(t, F.lit(w)), n) for w, n in ORDINALS.items()))
    heard = F.array_compact(F.array(*(F.when(t.rlike("|".join(map(re.escape, ws))), F.lit(name)) for name, ws in WORDINGS.items()), *(F.when(t.rlike(p), F.lit(name)) for name, p in PATTERNS.items())))
    period = extract_period(F.col(text))
    year = F.regexp_extract(t, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    day = F.col(asked_on).cast("date") if asked_on in turns.columns else F.lit(None).cast("date")
    return known.withColumns({"ordinal": ordinal, "year": year, "since": period["since"], "until": period["until"], "says": heard, "day": day, "folded": t})


@dataclass
class Offer:
    offer_id: str
    bank: str | None
    products: list[str]
    rank: int


@dataclass
class State:
    """What a session carries."""

    banks: list[str] = field(default_factory=list)
    wide: bool = False  # the banks are those an answer covered, not asked ones
    products: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    scope: str = "current"
    year: int | None = None
    since: datetime.date | None = None
    until: datetime.date | None = None
    active: list[str] = field(default_factory=list)
    ranked: list[Offer] = field(default_factory=list)
    asked: bool = False


@dataclass
class Route:
    """What a turn asks for."""

    transition: str
    intent: str
    banks: list[str] = field(default_factory=list)
    products: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    scope: str = "current"
    year: int | None = None
    since: datetime.date | None = None
    until: datetime.date | None = None
    offer_ids: list[str] = field(default_factory=list)
    inherited: list[str] = field(default_factory=list)
    asks_back: str | None = None
    standalone: str = ""


def _distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v is not None))


class Turn:
    """A read turn with the readings that depend on its own words only."""

    def __init__(self, row: dict):
        says = set(row["says"])
        self.banks, self.products, self.fields = ([*(row[k] or ())] for k in ("banks", "products", "fields"))
        self.ordinal, self.named_year, self.since, self.until = row["ordinal"], row["year"], row["since"], row["until"]
        self.says = says.__contains__
        self.folded = row["folded"]
        dated = bool(self.since or self.until)
        if dated and self.says("campaign") and "campaign_date" not in self.fields:
            self.fields.append("campaign_date")
        rewards = {"reward", "spending_threshold", "campaign_date"} & {*self.fields}
        if (self.products == ["KART"] and rewards) or (not self.products and "reward" in self.fields and self.says("points")):
            self.products = ["KART_KAMPANYASI"]
        campaign = self.says("campaign") or {*CAMPAIGNS} & {*self.products}
        if self.named_year is None and not dated and campaign and self.says("active") and row["day"]:
            self.since = self.until = row["day"]
        self.dated = bool(self.since or self.until)
        self.year = None if self.dated else self.named_year
        self.means_one = self.says("pronoun") or self.says("this")
        self.sets_period = bool(self.named_year or self.dated or self.says("period"))
        self.refers_back = self.ordinal is not None or self.says("follows") or self.says("refers") or self.says("this")
        self.follows = self.refers_back or self.says("softly")
        self.scope = "all" if self.says("all_periods") else "historical" if self.named_year is not None or self.says("past") else "current"
        self.turns_away = self.says("foreign") or (self.says("turns") and bool(self.banks or self.products))

    def small_talk(self, state: State) -> bool:
        if self.banks or self.products or self.fields or self.named_year is not None or self.dated or self.says("money"):
            return False
        if self.says("casual") or self.says("foreign"):
            return True
        back = self.says("follows") or self.says("refers") or self.says("this")
        return not back and not (state.asked and self.says("softly"))

    def intent(self, banks: int, scope: str) -> str:
        if self.says("calculates"):
            return "calculate"
        if self.says("compares") or (banks != 1 and self.says("extreme")):
            return "compare"
        if self.named_year is not None or self.dated or self.says("past_year"):
            return "historical"
        kind = "list" if self.says("lists") or (self.says("shows") and self.says("plural")) else "lookup"
        return "historical" if scope == "historical" else kind


def _ask_back(t: Turn, s: State, what: str, transition: str, **known) -> Route:
    """A question back, with what is known so far: the state's values but for those given."""
    own = {"banks": [*s.banks], "products": [*s.products], "offer_ids": [*s.active]} | {k: v for k, v in known.items() if k in ("banks", "products", "offer_ids")}
    period = known.get("period")
    scope, year, since, until = period or (s.scope, s.year, s.since, s.until)
    inherited = ["banks"] * bool(own["banks"]) + ["products"] * bool(own["products"])
    if s.asked and not period:
        inherited += ["scope"] + ["year"] * (s.year is not None) + ["dates"] * bool(s.since or s.until)
    inherited += ["offer_ids"] * bool(own["offer_ids"])
    return Route(transition, "clarification", fields=[*t.fields], scope=scope, year=year, since=since, until=until, inherited=inherited, asks_back=what, **own)


def _meant(t: Turn, s: State) -> list[Offer]:
    """The offers of the last answer that a pronoun may mean: active ones if any are, of the named banks and products."""
    found = [o for o in s.ranked if o.offer_id in s.active] or s.ranked
    found = [o for o in found if not t.banks or o.bank in t.banks]
    return [o for o in found if not t.products or {*t.products} & {*o.products}]


def resolve(t: Turn, s: State) -> Route:
    """The route of a turn in a state, with the question in full; small talk and turns that need a question back keep their own words."""
    r = _resolved(t, s)
    own = r.intent in ("chat", "clarification")
    r.standalone = t.folded if own else standalone(t.folded, r.banks, r.products, r.fields, r.scope, r.year, r.since, r.until)
    return r


def _resolved(t: Turn, s: State) -> Route:
    if t.small_talk(s):
        return Route("chat", "chat")
    follows = t.follows or (s.asked and t.sets_period)
    if follows and not s.asked and not t.banks and not t.products:
        return Route("no_context", "clarification", fields=[*t.fields], asks_back="context")

    offer, offer_ids, transition = None, [], "fresh"
    if t.ordinal is not None:
        transition = "ordinal"
        in_order = sorted(s.ranked, key=lambda o: o.rank)
        if t.ordinal > len(in_order):
            return _ask_back(t, s, "offer", transition, offer_ids=[])
        offer = in_order[t.ordinal - 1]
    elif t.means_one:
        transition = "pointed"
        if s.ranked:
            meant = _meant(t, s)
            if len(meant) != 1:
                return _ask_back(t, s, "offer", transition, banks=_distinct(o.bank for o in meant), products=_distinct(p for o in meant for p in o.products), offer_ids=[o.offer_id for o in meant])
            offer = meant[0]
        elif len(s.active) == 1:
            offer_ids = [*s.active]
        else:
            return _ask_back(t, s, "offer", transition)
    banks, products, asked = [*t.banks], [*t.products], [*t.fields]
    inherited = []
    if offer:
        offer_ids = [offer.offer_id]
        if not banks:
            banks, inherited = _distinct([offer.bank]), ["banks"]
        if not products:
            products, inherited = [*offer.products], [*inherited, "products"]
    inherited += ["offer_ids"] * bool(offer_ids)

    carries = follows or (bool(t.fields) and not t.products and s.asked)
    if carries and (not t.turns_away or t.says("foreign")):
        if transition == "fresh":
            transition = "carried"
        same = t.says("same_bank")
        if not banks and s.banks and (not s.wide or same or t.means_one or t.ordinal is not None):
            if same and len(s.banks) != 1:
                period = (t.scope if t.sets_period else s.scope, t.year, t.since, t.until)
                return _ask_back(t, s, "bank", "same_bank", period=period)
            if t.says("his") and len(s.banks) > 1 and not offer:
                return _ask_back(t, s, "bank", "pointed")
            banks, inherited = [*s.banks], [*inherited, "banks"]
            transition = "same_bank" if same else transition
        if not t.says("foreign"):
            if not products and s.products:
                products, inherited = [*s.products], [*inherited, "products"]
            if not asked and s.fields:
                asked, inherited = [*s.fields], [*inherited, "fields"]

    scope, year, since, until = t.scope, t.year, t.since, t.until
    other_bank = bool(t.banks) and {*t.banks} != {*s.banks}
    other_product = bool(t.products) and {*t.products} != {*s.products}
    if carries and not t.turns_away and not t.sets_period:
        scope, year, since, until = s.scope, s.year, s.since, s.until
        inherited += ["year"] * (year is not None) + ["dates"] * bool(since or until) + ["scope"]
        if not other_bank and not other_product and not offer_ids and s.active:
            offer_ids, inherited = [*s.active], [*inherited, "offer_ids"]
    if t.turns_away:
        transition = "topic"
        if year is None:
            scope, since, until = "current", None, None
    if t.turns_away or other_bank or other_product:
        offer_ids = []
    return Route(transition, t.intent(len(banks), scope), banks, products, asked, scope, year, since, until, offer_ids, inherited)


def after(s: State, r: Route, offers: list[Offer], verified: bool) -> State:
    """The state after a turn: small talk and questions back leave it, a verified answer puts its offers in, another one only what was asked."""
    if r.intent in ("chat", "clarification"):
        return s
    period = {"scope": r.scope, "year": r.year, "since": r.since, "until": r.until}
    names = bool(r.products or r.fields)
    if verified:
        covered = _distinct(o.bank for o in offers)
        wide = not r.banks and r.intent in ("lookup", "list", "compare") and names and bool(covered)
        products = r.products or _distinct(p for o in offers for p in o.products)
        return State(r.banks or covered, wide, products, r.fields, active=[] if wide else _distinct(o.offer_id for o in offers), ranked=offers, asked=True, **period)
    wide = not r.banks and r.intent in ("lookup", "list", "compare", "calculate") and names
    other_bank = bool(r.banks) and {*r.banks} != {*s.banks}
    other_product = bool(r.products) and {*r.products} != {*s.products}
    moved = (r.scope, r.year, r.since, r.until) != (s.scope, s.year, s.since, s.until)
    banks = r.banks or ([] if other_product or wide else s.banks)
    products = r.products or ([] if other_bank else s.products)
    active, ranked = s.active, s.ranked
    if other_bank or other_product or moved or wide:
        active, ranked = [], []
    elif r.offer_ids:
        active, ranked = r.offer_ids, [o for o in s.ranked if o.offer_id in r.offer_ids]
    return State(banks, wide, products, r.fields, active=active, ranked=ranked, asked=True, **period)


def _step(row: dict, s: State) -> tuple[Route, State]:
    offers = sorted((Offer(o["offer_id"], o["bank"], [*(o["products"] or ())], o["rank"]) for o in row["offers"] or ()), key=lambda o: o.rank)
    r = resolve(Turn(row), s)
    return r, after(s, r, offers, row["verified"] is True)


ROUTE = "transition string, intent string, banks array<string>, products array<string>, fields array<string>, scope string, year int, since date, until date, offer_ids array<string>, inherited array<string>, asks_back string, standalone string"
OFFERS = "array<struct<offer_id:string,bank:string,products:array<string>,rank:int>>"
_READ = ("banks", "products", "fields", "ordinal", "year", "since", "until", "says", "day", "folded")


def _read(turns: DataFrame, key: str, order: str, vocabulary: Vocabulary | None, *more: str) -> DataFrame:
    """One column for each thing the fold needs and those of `more`; offers and verified may be absent."""
    offers = F.col("offers").cast(OFFERS) if "offers" in turns.columns else F.lit(None).cast(OFFERS)
    verified = F.col("verified") if "verified" in turns.columns else F.lit(True)
    day = [F.col("asked_on")] if "asked_on" in turns.columns else []
    rows = turns.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), F.col("text").cast("string").alias("text"), offers.alias("offers"), verified.alias("verified"), *more, *day)
    return read_turns(rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull()), vocabulary).select(key, order, "text", "offers", "verified", *more, *_READ)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def fold_sessions(turns: DataFrame, key: str = "conv_id", order: str = "turn", vocabulary: Vocabulary | None = None) -> DataFrame:
    """The route of each turn (key, order, then the columns of ROUTE), sessions apart.

    turns: key, order, text, and if there are any: asked_on (date), offers (OFFERS, the turn's answer) and verified. One shuffle by session; tasks sort and stream their rows.
    """
    schema = f"`{key}` string, `{order}` long, {ROUTE}"
    rows = _read(turns, key, order, vocabulary).repartition(key).sortWithinPartitions(key, order, "text")
    names = [f.name for f in fields(Route)]
    kind = _arrow(schema, turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last, state = None, None, State()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != session:
                    session, last, state = row[key], None, State()
                if last is not None and row[order] <= last:
                    continue
                last = row[order]
                r, state = _step(row, state)
                out.append((session, last, *(getattr(r, n) for n in names)))
            columns = list(zip(*out, strict=True)) or [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return rows.mapInArrow(run, schema)


class _Session(StatefulProcessor):
    """The state of a session in the store. It goes when no turn has come for the time to live; each turn puts that off."""

    def __init__(self, key: str, order: str, ttl_ms: int, summary: int):
        self.key, self.order, self.ttl_ms, self.summary = key, order, ttl_ms, summary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", f"version long, last long, expires long, summary string, banks array<string>, wide boolean, products array<string>, fields array<string>, scope string, year int, since date, until date, active array<string>, ranked {OFFERS}, asked boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, last, said, state, expires = 0, None, "", State(), None
        now = timerValues.getCurrentWatermarkInMs()
        if self.state.exists():
            version, last, expires, said, *rest = self.state.get()
            if expires <= now:  # the timer of this session fires after its rows
                version, last, said = 0, None, ""
            else:
                state = State(**dict(zip([f.name for f in fields(State)], rest, strict=True)))
                state.ranked = [Offer(*o) for o in state.ranked]
        newest = 0
        for row in sorted((r.asDict(True) for r in rows), key=lambda r: (r[self.order], r["text"] or "")):
            newest = max(newest, int(row["ts"].timestamp() * 1000))
            if last is not None and row[self.order] <= last:
                continue
            version, last = version + 1, row[self.order]
            r, state = _step(row, state)
            said = _remembered(said, last, row["text"], r, self.summary)
            yield Row(**{self.key: key[0], self.order: last, "version": version, "summary": said, **asdict(r)})
        due = max(newest + self.ttl_ms, now + 1, expires or 0)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)
        kept = {f.name: getattr(state, f.name) for f in fields(State)} | {"ranked": [(o.offer_id, o.bank, o.products, o.rank) for o in state.ranked]}
        self.state.update((version, last, due, said, *kept.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _remembered(said: str, turn: int, text: str | None, r: Route, limit: int) -> str:
    """The rolling summary with a line for this turn; the oldest lines go beyond the limit, and of one line that is too long its end stays."""
    lines = [*filter(None, said.split("\n")), f"{turn} {r.intent}: {(text or '').replace(chr(10), ' ')}"]
    while len(lines) > 1 and len("\n".join(lines)) > limit:
        del lines[0]
    return "\n".join(lines)[-limit:]


def session_stream(turns: DataFrame, ttl_seconds: int, summary: int = 4000, key: str = "conv_id", order: str = "turn", delay: str = "1 minute", vocabulary: Vocabulary | None = None) -> DataFrame:
    """fold_sessions on a stream, with version and rolling summary; a session's state goes when its time to live has passed without a turn.

    turns also needs `ts`, whose watermark moves time. A session that comes back later begins anew. Needs the RocksDB state store.
    """
    read = _read(turns.withWatermark("ts", delay), key, order, vocabulary, "ts")
    schema = f"`{key}` string, `{order}` long, version long, summary string, {ROUTE}"
    return read.groupBy(key).transformWithState(_Session(key, order, ttl_seconds * 1000, summary), schema, "Append", "EventTime")
