"""Periodic runs of words, found with a recompressed grammar.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, POWER * q) words that no neighbouring word extends.

Candidates come from a harmonic grid: a run of period q holds M = max(LEAST, POWER * q) - q places in a row whose word equals the one q later,
so of every M - 2 places one begins three such places. Places on that grid are tried for each q up to n / POWER, n log n of them, three words each;
most texts end there. What is left is extended exactly, to the right and to the left, by longest common extensions.

These come from a run-length grammar, built by recompression: levels of block compression (each stretch of one symbol
becomes one symbol with a count) and of pair compression (symbols are dealt to a left and a right class, each left-right neighbour pair becomes one symbol)
follow one another until a text has few symbols. Both depend on neighbours only, so equal stretches get equal symbols but
for a few at their ends. An extension climbs while both places begin equal symbols and descends from the first difference, a few steps a level.
No suffix array is built. The grammars of all texts of a slice that have candidates are built at once in numpy; symbols are numbered exactly.

A word belongs to the rest of a run if the run contains it after its first q words; the collapsed text has all other words, joined by one space.

Defined results: null, empty and wordless texts have no runs and an empty collapsed text; a null doc_id is kept; repeated rows are each worked on;
texts of any length are one grammar; runs never cross documents; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerscope.llm.normalised import joined
from offerscope.llm.words import Words, lean, mix, word_tables

POWER, LEAST = 4, 6
#: Levels are added while a text has more symbols than this.
TOP = 8
#: Places of the grid that are tried at a time.
BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Level:
    """A string of symbols: `end` the index after each document's last one, `more` how often the symbol is said from here on, `words` its length.

    `up` is the index of the symbol of the next level that begins here, -1 if none does; `down` that of the first one below.
    """

    symbol: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    down: np.ndarray
    end: np.ndarray
    more: np.ndarray
    blocks: bool = False
    up: np.ndarray | None = None


def _level(symbol: np.ndarray, doc: np.ndarray, words: np.ndarray, down: np.ndarray, docs: int) -> Level:
    n = len(symbol)
    new = np.ones(n, bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], n)
    more = np.repeat(stop, stop - start) - np.arange(n)
    return Level(symbol, doc, words, down, np.searchsorted(doc, np.arange(docs), "right"), more)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair; both are below 2**31."""
    return np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_inverse=True)[1]


def grammar(symbol: np.ndarray, doc: np.ndarray, docs: int) -> list[Level]:
    """Levels from the words up; `doc` ascends from 0 to docs - 1."""
    symbol = np.unique(symbol, return_inverse=True)[1]
    levels = [_level(symbol, doc, np.ones(len(doc), np.int64), np.arange(len(doc)), docs)]
    idle = 0
    while len(doc) and np.bincount(levels[-1].doc).max() > TOP and idle < 8:
        low = levels[-1]
        low.blocks = len(levels) % 2 == 1
        n = len(low.symbol)
        if low.blocks:
            first = np.ones(n, bool)
            first[1:] = (low.more[:-1] == 1) | (low.doc[1:] != low.doc[:-1])
            at = np.flatnonzero(first)
            number = _numbered(low.symbol[at], low.more[at])
            words = low.words[at] * low.more[at]
        else:
            coin = (mix(low.symbol.astype(np.uint64) + np.uint64(len(levels) << 32)) >> np.uint64(40)) & np.uint64(1) == 1
            joins = coin[:-1] & ~coin[1:] & (low.doc[1:] == low.doc[:-1])
            other = ~coin[:-1] & coin[1:] & (low.doc[1:] == low.doc[:-1])
            joins = other if other.sum() > joins.sum() else joins  # the class that gives more pairs goes left
            first = np.ones(n, bool)
            first[1:] = ~joins
            at = np.flatnonzero(first)
            two = np.append(joins, False)[at]
            after = np.minimum(at + 1, n - 1)
            number = _numbered(low.symbol[at], np.where(two, low.symbol[after] + 1, 0))
            words = low.words[at] + np.where(two, low.words[after], 0)
        low.up = np.full(n, -1)
        low.up[at] = np.arange(len(at))
        idle = idle + 1 if len(at) == n else 0
        levels.append(_level(number, low.doc[at], words, at, docs))
    return levels


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, a < b being places in the same document, or b the place after its last word."""
    x, y = a.copy(), b.copy()
    total = np.zeros(len(a), np.int64)
    doc = levels[0].doc[a] if len(a) else a
    own = np.arange(len(a))  # still climbing
    height = np.zeros(len(a), np.int64)
    for h, level in enumerate(levels[:-1]):
        above = levels[h + 1]
        left = own
        climbed = []
        while len(left):
            i, j = x[left], y[left]
            same = j < level.end[doc[left]]
            left, i, j = left[same], i[same], j[same]
            same = level.symbol[i] == level.symbol[j]
            left, i, j = left[same], i[same], j[same]
            u, v = level.up[i], level.up[j]
            both = (u >= 0) & (v >= 0)
            rises = both & (above.symbol[u] == above.symbol[v])
            up = left[rises]
            x[up], y[up], height[up] = u[rises], v[rises], h + 1
            climbed.append(up)
            left, i, j = left[~both], i[~both], j[~both]  # where both begin unequal symbols the search goes down
            step = np.minimum(level.more[i], level.more[j]) if level.blocks else 1
            total[left] += step * level.words[i]
            x[left] += step
            y[left] += step
        own = np.concatenate(climbed) if climbed else own[:0]
    for h in range(len(levels) - 1, -1, -1):
        level = levels[h]
        left = np.flatnonzero(height >= h)
        if h + 1 < len(levels):  # from the level above
            low = left[height[left] > h]
            above = levels[h + 1]
            x[low], y[low] = np.append(above.down, len(level.symbol))[x[low]], np.append(above.down, len(level.symbol))[y[low]]
        while len(left):
            i, j = x[left], y[left]
            same = j < level.end[doc[left]]
            left, i, j = left[same], i[same], j[same]
            same = level.symbol[i] == level.symbol[j]
            left, i, j = left[same], i[same], j[same]
            step = np.minimum(level.more[i], level.more[j])
            total[left] += step * level.words[i]
            x[left] += step
            y[left] += step
    return total


def candidates(word: np.ndarray, doc: np.ndarray, longest: int, power: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) on the harmonic grid where three words in a row equal those a period later."""
    n = len(word)
    q = np.arange(1, longest // power + 1)
    step = np.maximum(least, power * q) - q - 2
    count = np.maximum(0, (n - q - 2 + step - 1) // step)  # places i with i + q + 2 < n
    edge = np.concatenate([[0], np.cumsum(count)])
    places, periods = [], []
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + BLOCK, "right")) - 1)
        which = np.repeat(np.arange(lo, hi), count[lo:hi])
        i = (np.arange(edge[lo], edge[hi]) - edge[which]) * step[which]
        j = i + q[which]
        hit = np.flatnonzero(word[i] == word[j])
        i, j = i[hit], j[hit]
        hit = (word[i + 1] == word[j + 1]) & (word[i + 2] == word[j + 2]) & (doc[i] == doc[j + 2])
        places.append(i[hit])
        periods.append((j - i)[hit])
        lo = hi
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs(word: np.ndarray, doc: np.ndarray, docs: int, power: int = POWER, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; `start` counts through all documents."""
    none = (np.zeros(0, np.int64),) * 3
    size = np.bincount(doc, minlength=docs)
    if not len(word) or size.max() < least:
        return none
    at, q = candidates(word, doc, int(size.max()), power, least)
    within = power * q <= size[doc[at]]
    at, q = at[within], q[within]
    if not len(at):
        return none
    # grammars of the documents that have candidates, forwards and backwards
    held = np.unique(doc[at])
    mine = np.isin(doc, held)
    place = np.cumsum(mine) - 1
    word, own, at = word[mine], np.searchsorted(held, doc[mine]), place[at]
    back = np.flatnonzero(mine)
    n = len(word)
    right = extensions(grammar(word, own, len(held)), at, at + q)
    before = np.zeros(len(at), np.int64)
    inner = np.flatnonzero((at > 0) & (own[np.maximum(at - 1, 0)] == own[at]))
    mirrored = grammar(word[::-1], len(held) - 1 - own[::-1], len(held))
    before[inner] = extensions(mirrored, n - at[inner] - q[inner], n - at[inner])
    start, length = at - before, before + right + q
    long = length >= np.maximum(least, power * q)
    found = np.stack([start[long], length[long], q[long]], 1)
    found = np.unique(found, axis=0) if len(found) else found.reshape(0, 3)  # by start, length, period
    smallest = np.ones(len(found), bool)
    smallest[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # a multiple of the smallest period gives the same stretch
    found = found[smallest]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return back[found[:, 0]], found[:, 1], found[:, 2]


def collapsed(w: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay."""
    n = len(w.hash)
    edge = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] == 0


def _found(power: int, least: int) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_tables(batch.column(1)):
                docs = w.hi - w.lo
                start, length, period = runs(w.hash, w.doc, docs, power, least)
                j = joined(w, collapsed(w, start, length, period))
                first = w.first()
                where = w.doc[start]
                spans = pa.StructArray.from_arrays([pa.array(start - first[where]), pa.array(length), pa.array(period)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(docs + 1)).astype(np.int32)), spans)
                text = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(j.offsets.astype(np.int64)), pa.py_buffer(j.data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, docs), pa.array(np.diff(first)), lists, text], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, power: int = POWER, least: int = LEAST, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of each row; one pass, no shuffle.

    `power` is the least exponent of a run (2 or more), `least` its least number of words (5 or more, so that three places in a row match).
    """
    if power < 2 or least < 5:
        raise ValueError("power >= 2 and least >= 5")
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return rows.mapInArrow(lean(_found(power, least)), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def collapse_documents(docs: DataFrame, power: int = POWER, least: int = LEAST) -> DataFrame:
    """doc_id and text with the repeats of all runs removed."""
    return find_runs(docs, power, least).select("doc_id", F.col("collapsed").alias("text"))


def rewound(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a stretch of every tenth document (by a hash of its id) made periodic, so that runs of any period occur.

    With h the CRC-32 of the id in decimal, g = h div 10, n words and h mod 10 = 0: each word i from a = g mod n on becomes word a + (i - a) mod p,
    p being 1 + (n - a) div (3 + g mod 8). A null id leaves the text as it is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = rows.withColumns({"g": F.floor(h / 10), "w": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), (F.floor(rest / F.col("p")) + 1).cast("int"))), F.lit(1), rest)
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and SHA-256 of the list of runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.less") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(said.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
