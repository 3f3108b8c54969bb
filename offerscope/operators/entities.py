"""Names in questions: thousands of aliases looked up in one pass by a tree of their words.

An alias may be followed by one of its kind's suffixes, joined to its last word, or by anything where `suffixes` is None. All aliases that occur
count, overlapping ones too; then a name hides those that HIDES lists for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from offerscope.functions.text import fold_text

WORD = re.compile(r"\w+", re.ASCII)
#: Vocabularies are held by each task, so their size is checked.
MOST_ALIASES = 500_000

# Names by kind, with their aliases in folded text, in the order in which names are given.
BANKS = {
    "Adil Katilim": ("adil katilim", "adil bank"), "Albaraka Turk": ("albaraka turk", "albaraka"), "Dunya Katilim": ("dunya katilim", "dunya bank"), "Hayat Finans": ("hayat finans", "hayat katilim"),
    "Kuveyt Turk": ("kuveyt turk", "kuveyt katilim"), "T.O.M. Katilim": ("t.o.m. katilim", "tom katilim", "tom bank"), "Emlak Katilim": ("turkiye emlak katilim", "emlak katilim"), "Turkiye Finans": ("turkiye finans",),
    "Vakif Katilim": ("vakif katilim",), "Ziraat Katilim": ("ziraat katilim",),
}
PRODUCTS = {
    "KONUT_FINANSMANI": ("konut finansmani", "ev finansmani", "konut"), "TASIT_FINANSMANI": ("tasit finansmani", "arac finansmani", "tasit"), "IHTIYAC_FINANSMANI": ("ihtiyac finansmani", "bireysel finansman", "ihtiyac"),
    "TICARI_FINANSMAN": ("ticari finansman", "kobi finansmani", "kobi"), "KATILMA_HESABI": ("katilma hesabi", "katilim hesabi"), "CARI_HESAP": ("cari hesap", "vadesiz hesap"), "KART": ("kredi karti", "banka karti", "kart"),
    "KART_KAMPANYASI": ("kart kampanyasi", "kart kampanyalari"), "MOBIL_UYGULAMA_KAMPANYASI": ("mobil uygulama kampanyasi", "mobil kampanya"), "YATIRIM_URUNU": ("yatirim urunu", "yatirim", "altin hesabi"),
    "ODEME_TRANSFER": ("odeme transfer", "para transferi", "havale", "eft"), "SIGORTA_TEKAFUL": ("tekaful", "sigorta"),
}
FIELDS = {
    "amount": ("tutar", "miktar", "limit", "azami"), "rate": ("oran", "kar payi", "kar orani", "yuzde"), "maturity": ("vade", "kac ay", "vade suresi"), "fee": ("ucret", "masraf", "tahsis", "aidat"),
    "reward": ("odul", "puan", "indirim", "iade"), "spending_threshold": ("harcama esigi", "harcama kosulu", "harcama"), "campaign_date": ("kampanya tarihi", "son tarih", "tarih araligi"),
}
# Suffixes of names, and names that another one hides.
BANK_SUFFIXES = "inin unun in nin un nun dan den yi yu ya ye da de la le i u a e".split()
PRODUCT_SUFFIXES = "lar ler lari leri larin lerin inin unun ini unu nin nun si su yi yu da de dan den na ne ni nu i u a e".split()
HIDES = {"MOBIL_UYGULAMA_KAMPANYASI": ("KART", "KART_KAMPANYASI"), "KART_KAMPANYASI": ("KART",)}


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    ends: dict[str, list[tuple[int, int, frozenset[str] | None]]] = field(default_factory=dict)


class Vocabulary:
    """Names by kind, in order; `kinds` maps a kind to (names with aliases, suffixes or None)."""

    def __init__(self, kinds: dict[str, tuple[dict[str, Iterable[str]], Iterable[str] | None]], hides: dict[str, tuple[str, ...]] | None = None):
        self.kinds = list(kinds)
        self.names = [list(names) for names, _ in kinds.values()]
        self.hides = hides or {}
        self.root = _Node()
        for k, (names, suffixes) in enumerate(kinds.values()):
            ending = None if suffixes is None else frozenset(suffixes)
            for i, aliases in enumerate(names.values()):
                for alias in aliases:
                    *head, last = WORD.findall(alias)
                    node = self.root
                    for w in head:
                        node = node.next.setdefault(w, _Node())
                    node.ends.setdefault(last, []).append((k, i, ending))

    def find(self, folded: str | None) -> list[list[str]]:
        """The names of each kind that a folded text holds."""
        found: list[set[int]] = [set() for _ in self.kinds]
        words = WORD.findall(folded or "")
        for start in range(len(words)):
            node: _Node | None = self.root
            at = start
            while node is not None and at < len(words):
                w = words[at]
                if node.ends:
                    for cut in range(1, len(w) + 1):
                        for k, i, ending in node.ends.get(w[:cut], ()):
                            if cut == len(w) or ending is None or w[cut:] in ending:
                                found[k].add(i)
                node = node.next.get(w)
                at += 1
        out = [[names[i] for i in sorted(own)] for names, own in zip(self.names, found, strict=True)]
        hidden = [{h for n in own for h in self.hides.get(n, ())} for own in out]
        return [[n for n in own if n not in gone] for own, gone in zip(out, hidden, strict=True)]


def standard() -> Vocabulary:
    """Banks, products and fields."""
    return Vocabulary({"banks": (BANKS, BANK_SUFFIXES), "products": (PRODUCTS, PRODUCT_SUFFIXES), "fields": (FIELDS, None)}, HIDES)


def vocabulary_of(aliases: DataFrame, suffixes: dict[str, Iterable[str] | None], hides: dict[str, tuple[str, ...]] | None = None) -> Vocabulary:
    """A vocabulary from a table of kind, name, alias; names of a kind in alphabetical order. At most MOST_ALIASES rows, else an error."""
    rows = aliases.select("kind", "name", fold_text("alias").alias("alias")).filter("alias rlike '[a-z0-9_]'").distinct().limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    kinds: dict[str, dict[str, list[str]]] = {k: {} for k in suffixes}
    for r in sorted(rows):
        kinds[r.kind].setdefault(r.name, []).append(r.alias)
    return Vocabulary({k: (names, suffixes[k]) for k, names in kinds.items()}, hides)


def with_entities(rows: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Adds an array of names for each kind, in the vocabulary's order; null texts have none. One pass, also over a stream."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    name = "_folded"
    schema = rows.schema
    for k in vocabulary.kinds:
        schema = schema.add(k, ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            found = [held.value.find(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([f[k] for f in found], kind) for k in range(len(held.value.kinds)))], names=[*batch.schema.names[:-1], *held.value.kinds])

    return rows.withColumn(name, fold_text(F.col(text))).mapInArrow(run, schema)
