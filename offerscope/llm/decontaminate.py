"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds short test items inside long documents: an item is contained if a document holds at
least `percent` of its distinct shingles (five words, ASCII capitals lowered; an item of fewer words is
one shingle, and a document holds it where the same words stand in a row). Ordinary MinHash signatures
compare resemblance, which is tiny for a short item in a long text. So documents keep a
fraction sketch, shingles whose hash is under a bound, and items are partitioned:
an item of n shingles may miss n - ceil(t n) of them, so its n - ceil(t n) + 1 least hashes are
its sketch and one of them is in every document that contains it. A partition holds the items of
one shingle width, one size class (power of two) and one band of largest sketch hashes (eighths of the
hash range), so its bound is tight for its items: long items, whose sketches reach a fifth of the range, don't share
the bound of short ones, which may reach the whole of it. A document meets the partitions whose items are small enough for it.
Candidates are then verified by exact containment, so the result has no false rows and, by the
argument above, misses none.

While the items' shingles are at most INDEX_ROWS (their count is checked), they are broadcast:
each document is sketched, probed and verified where it is read, in one pass without a shuffle of texts.
Beyond that, sketches meet in a shuffled join by (partition, hash), and candidates' texts by two more.

Defined results: null or empty text holds no shingles and never
matches, neither do such items; null ids match nothing; repeated rows give one row for each
pair of ids (rows that repeat an id with other texts or items: the most shingles of any); other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.shared import written
from offerscope.llm.words import Words, crossing, lean, mix, word_tables

INDEX_ROWS = 1_000_000
SHINGLE = 5
#: Bands of largest sketch hashes: bounds of partitions are multiples of a BANDS-th of the hash range.
BANDS = 8
_INDEX = "item long, item_id long, width int, part int, n_item long, bound long, sketch boolean, h long"


def _shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 63-bit hash), sorted and each once, of all runs of `width` words; documents may have fewer."""
    g, ok = w.grams(width)
    at = np.flatnonzero(ok)
    doc, h = w.doc[at], (mix(g[at] + np.uint64(width)) >> np.uint64(1)).view(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _part(width: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partition, its bound) of items by shingle width, shingles and largest sketch hash."""
    shift = 63 - (BANDS.bit_length() - 1)
    band = most >> shift
    size = np.floor(np.log2(n)).astype(np.int64)
    bound = np.where(band == BANDS - 1, np.iinfo(np.int64).max, ((band + 1) << shift) - 1)
    return (width * 64 + size) * BANDS + band, bound


def _item_index(percent: int) -> Callable:
    """Rows of items to their shingles: the item's own hash, partition and bound; `sketch` marks the least ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in word_tables(batch.column(1), lower=True):
                words = np.diff(w.first())
                for width in range(1, SHINGLE + 1):
                    doc, h = _shingles(w, width)
                    keep = (words[doc] == width) if width < SHINGLE else (words[doc] >= SHINGLE)
                    doc, h = doc[keep], h[keep]
                    if not len(h):
                        continue
                    first = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
                    n = np.diff(first)
                    last = first[:-1] + n - (percent * n + 99) // 100  # of the sketch
                    own = np.flatnonzero(n > 0)
                    part, bound, name = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                    part[own], bound[own] = _part(np.full(len(own), width), n[own], h[last[own]])
                    for i in own.tolist():  # items with one id and differing texts are told apart by their shingles
                        name[i] = np.bitwise_xor.reduce(mix(h[first[i] : first[i + 1]].view(np.uint64)) ^ mix(ids[w.lo + i : w.lo + i + 1].view(np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[doc]), pa.array(ids[w.lo + doc]), pa.array(np.full(len(h), width, np.int32)), pa.array(part[doc].astype(np.int32)), pa.array(n[doc]), pa.array(bound[doc]), pa.array(np.arange(len(h)) <= last[doc]), pa.array(h)],
                        names=[x.split()[0] for x in _INDEX.split(", ")],
                    )

    return run


class Index:
    """All shingles of all items, for one pass over documents."""

    def __init__(self, rows: pa.Table, percent: int):
        column = lambda name: np.asarray(rows.column(name).combine_chunks())
        item, at, number = np.unique(column("item"), return_index=True, return_inverse=True)
        self.percent, self.ids, self.n = percent, column("item_id")[at], column("n_item")[at]
        h, sketch, part, width = column("h"), np.asarray(rows.column("sketch").to_pylist(), bool), column("part"), column("width")
        order = np.lexsort((h, number))
        key = np.unique(np.stack([number[order], h[order]]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
        self.first, self.hashes = np.searchsorted(key[0], np.arange(len(item) + 1)), key[1]
        #: (width, least shingles a document needs, bound, sorted hashes, their items) of each partition
        self.parts = []
        for p in np.unique(part).tolist():
            own = np.flatnonzero((part == p) & sketch)
            own = own[np.argsort(h[own], kind="stable")]
            self.parts.append((int(width[own[0]]), -(-percent * int(column("n_item")[own].min()) // 100), int(column("bound")[own[0]]), h[own], number[own]))

    def candidates(self, doc: np.ndarray, h: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
        """Distinct (document, item) with a common sketch hash, by two columns."""
        found = [np.zeros((2, 0), np.int64)]
        for own, least, bound, keys, items in self.parts:
            if own == width:
                at = np.flatnonzero((h <= bound) & (n[doc] >= least))
                lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
                hit = np.flatnonzero(hi > lo)
                count = (hi - lo)[hit]
                place = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(hit) else np.zeros(0, np.int64)
                found.append(np.stack([np.repeat(doc[at[hit]], count), items[place]]))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def contained(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of the contained items."""
        for width in sorted({p[0] for p in self.parts}):
            doc, h = _shingles(w, width)
            first = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
            for d, i in self.candidates(doc, h, np.diff(first), width).T.tolist():
                own = self.hashes[self.first[i] : self.first[i + 1]]
                shared = int((crossing(h[first[d] : first[d + 1]], own) >= 0).sum())
                if 100 * shared >= self.percent * len(own):
                    yield d, i, shared


def _search(index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in word_tables(batch.column(1), lower=True):
                rows = [(int(ids[w.lo + d]), int(known.ids[i]), int(known.n[i]), shared) for d, i, shared in known.contained(w)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _clean(index) -> Callable:
    """Rows, with all their columns, whose text contains no item; rows without doc_id pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for w in word_tables(batch.column(batch.schema.get_field_index("text")), lower=True):
                for d, _, _ in known.contained(w):
                    keep[w.lo + d] = False
            keep |= np.asarray(batch.column(batch.schema.get_field_index("doc_id")).is_null())
            yield batch.filter(pa.array(keep))

    return run


def _doc_sketches(parts: list[tuple[int, int, int, int]]) -> Callable:
    """Shuffled form; parts: (partition, width, least shingles that a document needs, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in word_tables(batch.column(1), lower=True):
                for width in sorted({p[1] for p in parts}):
                    doc, h = _shingles(w, width)
                    n = np.bincount(doc, minlength=w.hi - w.lo)
                    for part, own, least, bound in parts:
                        if own == width:
                            at = np.flatnonzero((h <= bound) & (n[doc] >= least))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + doc[at]]), pa.array(np.full(len(at), part, np.int32)), pa.array(h[at])], names=["doc_id", "part", "h"])

    return run


def _verify(percent: int) -> Callable:
    """Shuffled form, rows (doc_id, item_id, text, item): exact containment of the item in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple[int, int, int, int]] = []
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                widths = np.zeros(len(part), np.int64)
                wanted: dict[int, np.ndarray] = {}
                for w in word_tables(part.column(3), lower=True):
                    widths[w.lo : w.hi] = np.minimum(np.diff(w.first()), SHINGLE)
                    for width in np.unique(widths[w.lo : w.hi][widths[w.lo : w.hi] > 0]).tolist():
                        doc, h = _shingles(w, width)
                        wanted |= {w.lo + i: h[doc == i] for i in np.flatnonzero(widths[w.lo : w.hi] == width).tolist()}
                for w in word_tables(part.column(2), lower=True):
                    for width in np.unique(widths[w.lo : w.hi][widths[w.lo : w.hi] > 0]).tolist():
                        doc, h = _shingles(w, width)
                        for i in np.flatnonzero(widths[w.lo : w.hi] == width).tolist():
                            own = wanted[w.lo + i]
                            shared = len(np.intersect1d(h[doc == i], own, assume_unique=True))
                            if 100 * shared >= percent * len(own):
                                out.append((int(docs[lo + w.lo + i]), int(items[lo + w.lo + i]), len(own), shared))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _indexed(items: DataFrame, percent: int) -> DataFrame:
    return written(items.mapInArrow(lean(_item_index(percent)), _INDEX), "items")


def _ready(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).filter("item_id is not null and item is not null")


def _broadcast_index(rows: DataFrame, percent: int):
    """The index for all tasks, or None where it has more than INDEX_ROWS rows."""
    if rows.limit(INDEX_ROWS + 1).count() > INDEX_ROWS:
        return None
    return rows.sparkSession.sparkContext.broadcast(Index(rows.toArrow(), percent))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item (shingles), n_shared, containment of each contained item."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = _ready(items, item_col, item_text_col)
    rows = _indexed(items, percent)
    index = _broadcast_index(rows, percent)
    if index is not None:
        found = docs.mapInArrow(lean(_search(index)), "doc_id long, item_id long, n_item long, n_shared long")
    else:
        parts = rows.groupBy("part", "width", "bound").agg(F.min("n_item").alias("least")).collect()  # a bounded number of partitions
        sketches = docs.mapInArrow(lean(_doc_sketches([(r["part"], r["width"], -(-percent * r["least"] // 100), r["bound"]) for r in parts])), "doc_id long, part int, h long")
        pairs = written(sketches.join(rows.filter("sketch").select("part", "h", "item_id"), ["part", "h"]).select("doc_id", "item_id").distinct(), "pairs")
        found = docs.join(pairs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item").mapInArrow(lean(_verify(percent)), "doc_id long, item_id long, n_item long, n_shared long")
    most = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("most"))
    return most.select("doc_id", "item_id", "most.n_item", "most.n_shared").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of documents that contain no item; rows without doc_id stay.

    With a broadcast index each row is judged by its own text, in one pass. Beyond it a doc_id is judged by all its texts.
    """
    items = _ready(items, "item_id", "text")
    index = _broadcast_index(_indexed(items, percent), percent)
    if index is not None:
        return docs.mapInArrow(lean(_clean(index)), docs.schema)
    leaks = contained_items(docs, items, percent, item_text_col="item").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
