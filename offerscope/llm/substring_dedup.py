"""Substring dedup with repeated-phrase automata.

A window is 13 consecutive words of a document. A word is removed if a window over it has a
word sequence that also starts in a document with a smaller doc_id.

1. Anchors. Of the six 8-word phrases in a window the one with the least hash is the window's
   anchor, so equal windows have equal anchors wherever they stand. About a quarter of all
   positions are anchors; only (hash, doc_id) of them is shuffled. Anchors of one document
   alone cannot belong to a recurring window and go.
2. Segments. Documents with recurring anchors are scanned again and give the words around these, with the anchor's
   home (the smallest doc_id that holds it). All documents with a window send it to the same
   home. A passage has one home as a rule, so a document gives one segment of it.
3. Automata. The segments are dealt out by home. Runs of homes form shards; in each shard the
   windows found in two documents or more are confirmed and compiled, with their first
   document, to an Aho-Corasick automaton over word numbers. All segments of the shard are streamed
   through it, and its matches are the occurrences.
4. The words covered by occurrences after the first document are removed.

Skew: anchors in over about 1 % of a corpus sample skip step 1's grouping (they are known to
recur); their home is the smallest doc_id of the sample that holds them, so that a common passage has one home too.
Homes with more than HOME_BYTES of segments are salted by document, and their windows are
confirmed over all salts by one aggregation that starts with pre-aggregated rows. The sample
steers placement only; results don't depend on it.

Defined results: null or empty text has no words and the digest of the empty string; a null
doc_id is compared with nothing and kept whole; rows that repeat a doc_id, with the same text or
another, have spans of their own and don't make each other's words removable, as neither id is
smaller; shorter texts than a window stay whole; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.shared import written
from offerscope.llm.words import Words, crossing, lean, mix, split, word_tables

WINDOW, ANCHOR = 13, 8
SPAN = WINDOW - ANCHOR
#: Segment bytes of one home beyond which it is salted.
HOME_BYTES = 1 << 18
#: Segment bytes of the homes that share an automaton.
SHARD_BYTES = 1 << 19
_DOC = np.uint64(0x9E3779B97F4A7C15)


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's anchors, each once."""
    a, _ = w.grams(ANCHOR)
    _, ok = w.grams(WINDOW)
    n = len(ok)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = a[:n].copy(), np.arange(n)
    for j in range(1, SPAN + 1):
        less = a[j : j + n] < least
        least[less] = a[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    at = np.unique(at[ok])
    doc, h = w.doc[at], a[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for w in word_tables(batch.column(1)):
            doc, h = _anchors(w)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + doc]), pa.array(h.view(np.int64))], names=["doc_id", "h"])


def _emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        marks = batch.column(2)  # list<struct<h, home>>
        reach = marks.offsets.to_numpy()
        hashes = np.asarray(marks.values.field(0)).view(np.uint64)
        homes = np.asarray(marks.values.field(1))
        for w in word_tables(batch.column(1)):
            a, ok = w.grams(ANCHOR)
            lo, hi = reach[w.lo], reach[w.hi]
            owner = np.repeat(np.arange(w.hi - w.lo), np.diff(reach[w.lo : w.hi + 1]))
            key = mix(hashes[lo:hi] ^ (owner.astype(np.uint64) * _DOC))
            order = np.argsort(key)
            at = np.flatnonzero(ok)
            found = crossing(key[order], mix(a[at] ^ (w.doc[at].astype(np.uint64) * _DOC)))
            at, home = at[found >= 0], homes[lo:hi][order][found[found >= 0]]
            if not len(at):
                continue
            doc, first = w.doc[at], w.first()
            s, e = np.maximum(at - SPAN, first[doc]), np.minimum(at + WINDOW, first[doc + 1])
            order = np.lexsort((at, home, doc))
            s, e, doc, home = s[order], e[order], doc[order], home[order]
            new = np.ones(len(s), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (home[1:] != home[:-1]) | (s[1:] > e[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(s)) - 1
            s, e, doc, home = s[head], e[tail], doc[head], home[head]
            full = e - s >= WINDOW
            s, e, doc, home = s[full], e[full], doc[full], home[full]
            text = [w.data[x:y].tobytes() for x, y in zip(w.start[s].tolist(), w.end[e - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(ids[w.lo + doc]), pa.array(keys[w.lo + doc]), pa.array((s - first[doc]).astype(np.int32)), pa.array(text, pa.binary())], names=["home", "doc_id", "key", "at", "segment"])


def _table(texts: list[bytes]) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return split(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _confirm(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with their smallest and largest document."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(h)) - 1
    return h[head], d[head], d[tail]


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of salted homes: (home, salt, window, smallest, largest document), pre-aggregated by run of rows."""
    for batch in batches:
        rows = batch.to_pydict()
        for lo in range(0, len(rows["home"]), 2000):
            part = slice(lo, lo + 2000)
            w = _table(rows["segment"][part])
            g, ok = w.grams(WINDOW)
            at = np.flatnonzero(ok)
            place = np.array([rows["home"][part], rows["salt"][part]])[:, w.doc[at]] if len(at) else np.zeros((2, 0), np.int64)
            docs = np.asarray(rows["doc_id"][part])[w.doc[at]]
            cells, inverse = np.unique(place, axis=1, return_inverse=True)
            for i in range(cells.shape[1]):
                own = np.flatnonzero(inverse.ravel() == i)
                h, least, most = _confirm(g[at[own]].view(np.int64), docs[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), cells[0, i])), pa.array(np.full(len(h), cells[1, i]).astype(np.int32)), pa.array(h), pa.array(least), pa.array(most)], names=["home", "salt", "win", "least", "most"])


def _locate(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, known: dict[int, int] | None) -> Iterator[tuple[int, int, int]]:
    """Streams segments through the automaton of their confirmed windows: (segment, first word, end) of later occurrences."""
    w = _table(texts)
    g, ok = w.grams(WINDOW)
    at = np.flatnonzero(ok)
    g = g[at].view(np.int64)
    if known is None:
        h, least, most = _confirm(g, docs[w.doc[at]])
        h, least = h[least < most], least[least < most]
    else:
        h = np.array(sorted(known), np.int64)
        least = np.array([known[x] for x in h.tolist()], np.int64)
    where = crossing(h, g)
    hit = np.flatnonzero(where >= 0)
    if not len(hit):
        return
    _, number = np.unique(w.hash, return_inverse=True)
    number = (number + 1).tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    which, place = np.unique(where[hit], return_index=True)
    for i, f in zip(at[hit[place]].tolist(), least[which].tolist(), strict=True):
        automaton.add_word(tuple(number[i : i + WINDOW]), f)
    automaton.make_automaton()
    first = w.first().tolist()
    for k, (doc, start) in enumerate(zip(docs.tolist(), starts.tolist(), strict=True)):
        begin = end = -1
        for last, f in automaton.iter(tuple(number[first[k] : first[k + 1]])):
            if f < doc:
                s = start + last + 1 - WINDOW
                if s > end:
                    if end >= 0:
                        yield k, begin, end
                    begin = s
                end = s + WINDOW
        if end >= 0:
            yield k, begin, end


def _emit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (salted, home, salt, kind): confirmed windows of a salted home lie before its segments."""
    texts: list[bytes] = []
    docs: list[int] = []
    keys: list[int] = []
    starts: list[int] = []
    known: dict[int, int] = {}
    held, cell, salted = 0, None, False

    def flush():
        if texts:
            found = list(_locate(texts, np.array(docs, np.int64), np.array(starts, np.int64), known if salted else None))
            if found:
                k, s, e = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in k], pa.int64()), pa.array([keys[i] for i in k], pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "key", "s", "e"])
        texts.clear(), docs.clear(), keys.clear(), starts.clear()

    for batch in batches:
        for home, salt, n_salts, kind, doc, key, at, seg, win in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if (home, salt) != cell:
                if held > SHARD_BYTES or salted or n_salts > 1:
                    yield from flush()
                    held = 0
                if salted or n_salts > 1:
                    known = {}
                cell, salted = (home, salt), n_salts > 1
            elif salted and held > SHARD_BYTES:
                yield from flush()
                held = 0
            if kind == 0:
                known[win] = doc
            else:
                texts.append(seg), docs.append(doc), keys.append(key), starts.append(at)
                held += len(seg)
    yield from flush()


def _emit_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        reach = spans.offsets.to_numpy()
        s_all, e_all = np.asarray(spans.values.field(0)), np.asarray(spans.values.field(1))
        for w in word_tables(batch.column(1)):
            n = w.hi - w.lo
            first = w.first()
            lo, hi = reach[w.lo], reach[w.hi]
            base = np.repeat(first[:-1], np.diff(reach[w.lo : w.hi + 1]))
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, base + s_all[lo:hi], 1)
            np.add.at(edge, base + e_all[lo:hi], -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.bincount(w.doc, gone, n).astype(np.int64)
            stay = np.flatnonzero(~gone)
            # the kept words, each with one space after it, copied at once
            size = w.end[stay] - w.start[stay] + 1
            out_at = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(w.start[stay] - out_at[:-1], size) + np.arange(out_at[-1])
            text = np.append(w.data, np.uint8(32))[np.minimum(take, len(w.data))]
            text[out_at[1:] - 1] = 32
            text = text.tobytes()
            cut = out_at[np.searchsorted(w.doc[stay], np.arange(n + 1))]
            digest = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, n), pa.array(np.diff(first), pa.int64()), pa.array(removed), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _hot(texts: DataFrame, share: float = 0.01, least: int = 32, limit: int = 1_000_000) -> list[tuple[int, int]]:
    """(hash, smallest doc_id) of anchors in at least `share` of a sample of documents; there are at most anchors-a-document / share."""
    part = texts.sample(0.02, seed=7)
    seen = part.mapInArrow(lean(_emit_anchors), "doc_id long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("home")).filter(F.col("n") >= least)
    if not seen.limit(1).count():
        return []
    floor = max(least, int(share * part.count()))
    return [(r.h, r.home) for r in seen.filter(F.col("n") >= floor).orderBy(F.desc("n"), "h").limit(limit).collect()]


def covered_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s, e): runs of words, end exclusive, that recur from a smaller doc_id; docs has doc_id, text and its key."""
    texts = docs.filter("doc_id is not null and length(text) >= 25").select("doc_id", "text", "key")
    anchors = texts.select("doc_id", "text").mapInArrow(lean(_emit_anchors), "doc_id long, h long")
    hot = texts.sparkSession.createDataFrame(_hot(texts.select("doc_id", "text")), "h long, hot long")
    # a hot anchor is known to recur: its rows go anywhere
    anchors = anchors.join(F.broadcast(hot), "h", "left").withColumn("place", F.when(F.col("hot").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("h")))
    one = Window.partitionBy("place", "h")
    marks = (
        anchors.select("h", "doc_id", "place", "hot", F.min("doc_id").over(one).alias("least"), F.max("doc_id").over(one).alias("most"))
        .filter("hot is not null or least < most")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h", F.coalesce("hot", "least").alias("home"))).alias("marks"))
    )
    segments = texts.join(marks, "doc_id").select("doc_id", "text", "marks", "key").mapInArrow(lean(_emit_segments), "home long, doc_id long, key long, at int, segment binary")
    segments = written(segments.withColumn("part", F.spark_partition_id()), "segments")  # part: rows that repeat one wholly get salts apart
    large = segments.groupBy("home").agg(F.sum(F.length("segment")).alias("size")).filter(F.col("size") > HOME_BYTES).select("home", F.ceil(F.col("size") / HOME_BYTES).cast("int").alias("n_salts"))
    large = written(large, "homes")  # at most one row for each HOME_BYTES of the corpus
    placed = segments.join(F.broadcast(large) if large.count() < 100_000 else large, "home", "left").withColumn("n_salts", F.coalesce("n_salts", F.lit(1)))
    placed = placed.withColumn("salt", F.when(F.col("n_salts") > 1, F.pmod(F.xxhash64("doc_id", "part"), F.col("n_salts"))).otherwise(0).cast("int"))
    windows = placed.filter("n_salts > 1").select("home", "salt", "doc_id", "segment").mapInArrow(lean(_emit_windows), "home long, salt int, win long, least long, most long")
    windows = written(windows.groupBy("home", "salt", "win").agg(F.min("least").alias("least"), F.max("most").alias("most")), "windows")
    both = windows.groupBy("win").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last")
    confirmed = windows.join(both, "win").select("home", "salt", F.lit(2).alias("n_salts"), F.lit(0).alias("kind"), F.col("first").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("segment"), "win")
    rows = placed.select("home", "salt", "n_salts", F.lit(1).alias("kind"), "doc_id", "key", "at", "segment", F.lit(None).cast("long").alias("win")).unionByName(confirmed)
    rows = rows.withColumn("n_salts", F.least("n_salts", F.lit(2))).repartition(F.col("home"), F.col("salt")).sortWithinPartitions("n_salts", "home", "salt", "kind")
    return rows.mapInArrow(lean(_emit_spans), "doc_id long, key long, s int, e int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    spans = covered_spans(docs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = docs.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))
    return rows.mapInArrow(lean(_emit_kept), "doc_id long, n_words long, n_removed long, kept_sha256 string")
