"""Target-distribution importance resampling with prefix-CRC substrings.

A document's features are its runs of `low` to `high` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo the number of buckets. Each document is scanned once, with its separators normalised: the running CRC is stored
at every byte. CRC is linear over GF(2), so the CRC of the bytes from a to b is the running CRC at b xor the one at a shifted over
b - a zero bytes: the shift cancels all that came before a. Any n-gram takes two prefixes, whatever n is.

The buckets of each document are written as a table, so no later step reads a text. Buckets of the raw and the target texts are
counted (partial sums before the shuffle, at most `buckets` rows after it), the log ratio of their smoothed shares is a bucket's
gain, and a document's weight is the sum of its features' gains. With a Gumbel draw from a hash of the id added, the highest scores
are a sample without replacement in proportion to exp(weight / 1000). Ranks are exact over the whole table: scores are cut into ranges by quantiles,
a range's rows are numbered in its own task, and the counts of the ranges above are added. The Gumbel term spreads scores: no single
score holds more than about 1 / (1000 e) of the ids, so ranges stay even. Only ranges that may be drawn are shuffled.

Defined results: null, empty and wordless texts have no features and weight 0 and are never drawn; a null doc_id counts as the
text "null" in the draw and comes last among ties; repeated rows are documents of their own; n-grams don't cross documents, and a document with
fewer words than `low` has no features; an empty target leaves gains that favour rare buckets, as the smoothing has it; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.llm.normalised import joined
from offerscope.llm.shared import written
from offerscope.llm.words import lean, word_tables

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Documents of a range of scores, and the most ranges.
RANGE_ROWS, RANGES = 20_000, 10_000
#: Bytes between words: all ASCII but digits and small letters, after capitals are lowered.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
_ROW = 64  # bytes that are scanned one after another, for all rows of a text at once


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """CRC of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=64)
def _power(j: int) -> np.ndarray:
    """Tables, one for each byte of a CRC, of the shift over 2**j zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    parts = [byte << np.uint32(8 * k) for k in range(4)]
    if j == 0:
        return np.stack([_table()[p & 255] ^ (p >> 8) for p in parts])
    half = _power(j - 1)
    return np.stack([_through(half, _through(half, p)) for p in parts])  # two halves, one after the other


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.ascontiguousarray(crc).view(np.uint8).reshape(-1, 4)  # little-endian
    return tables[0].take(byte[:, 0]) ^ tables[1].take(byte[:, 1]) ^ tables[2].take(byte[:, 2]) ^ tables[3].take(byte[:, 3])


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC after so many zero bytes, by the binary digits of their number."""
    out = crc.copy()
    for j in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        on = np.flatnonzero((zeros >> j) & 1)
        out[on] = _through(_power(j), out[on])
    return out


def prefix_crcs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running CRC (from zero, not inverted) before each of the places `at`, after one scan of the bytes."""
    rows = len(data) // _ROW + 1
    grid = np.zeros(rows * _ROW, np.uint8)
    grid[: len(data)] = data
    grid = np.ascontiguousarray(grid.reshape(rows, _ROW).T)
    run = np.zeros((_ROW + 1, rows), np.uint32)
    table = _table()
    for k in range(_ROW):
        run[k + 1] = table.take((run[k].astype(np.uint8)) ^ grid[k]) ^ (run[k] >> 8)
    state, step, j = run[_ROW].copy(), 1, _ROW.bit_length() - 1
    while step < rows:  # what all rows before give, by doubling
        state[step:] ^= _through(_power(j), state[:-step])
        step, j = 2 * step, j + 1
    before = np.concatenate([np.zeros(1, np.uint32), state[:-1]])
    row, column = at // _ROW, at % _ROW
    return run[column, row] ^ shifted(before[row], column)


def gram_crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, CRC-32) of all runs of low..high words of normalised texts, by document."""
    head, tail = np.split(prefix_crcs(data, np.concatenate([begin, end])), 2)
    docs, crcs = [], []
    for n in range(low, high + 1):
        m = len(doc) - n + 1
        if m <= 0:
            break
        own = np.flatnonzero(doc[:m] == doc[n - 1 :])
        stop = own + n - 1
        crcs.append(tail[stop] ^ shifted(head[own] ^ _ONES, end[stop] - begin[own]) ^ _ONES)
        docs.append(doc[own])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    docs, crcs = np.concatenate(docs), np.concatenate(crcs)
    order = np.argsort(docs, kind="stable") if high > low else slice(None)
    return docs[order], crcs[order]


def _bucketed(low: int, high: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_tables(batch.column(1), lower=True, space=BREAKS):
                n = w.hi - w.lo
                j = joined(w)
                docs, crcs = gram_crcs(j.data, j.begin, j.end, j.doc, low, high)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32)), pa.array((crcs % np.uint32(buckets)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, n), pa.array(np.bincount(j.doc, minlength=n)), lists], names=["doc_id", "n_words", "buckets"])

    return run


def features(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, buckets (one entry a feature, repeats included) of each row; one scan, no shuffle."""
    if not 1 <= low <= high or not 1 <= buckets < 1 << 31:
        raise ValueError("1 <= low <= high and 1 <= buckets < 2**31")
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_bucketed(low, high, buckets)), "doc_id long, n_words long, buckets array<int>")


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket: floor of 1000 times the log ratio of its smoothed share in the target to that in the raw features.

    At most `buckets` rows reach the driver.
    """
    held = [dict(f.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()) for f in (raw, target)]
    s_all, t_all = (sum(h.values()) for h in held)
    s, t = held
    return [math.floor(1000 * math.log((float(t.get(b, 0)) + 1) * (float(s_all) + buckets) / ((float(s.get(b, 0)) + 1) * (float(t_all) + buckets)))) for b in range(buckets)]


def _weigher(gains) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            gain = gains.value[lists.values.to_numpy(zero_copy_only=False)] if len(lists.values) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(gain)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(feats: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of all features."""
    shared = feats.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))
    return feats.mapInArrow(lean(_weigher(shared)), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A standard Gumbel draw of a hash of the id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _ranged(cuts: np.ndarray, least_words: int) -> Callable:
    """Adds the range of a score: 0 above the highest cut, and so on; null for rows with too few words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = len(cuts) - np.searchsorted(cuts, batch.column("score").to_numpy(), "left")
            able = batch.column("n_words").to_numpy() >= least_words
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32), mask=~able)], names=[*batch.schema.names, "range"])

    return run


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank (1, 2, 3...) of the floor(percent * N / 100) highest scores of the N rows with enough words, null for all others.

    Ties go to the smaller doc_id. `scored` should be a written table, as it is read three times.
    """
    able = F.col("n_words") >= least_words
    n = scored.filter(able).count()
    limit = percent * n // 100
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = scored.filter(able).select(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 and limit else []
    spark = scored.sparkSession
    dealt = scored.mapInArrow(_ranged(np.array(sorted(set(cuts)), np.int64), least_words), "doc_id long, n_words long, n_features long, weight long, score long, range int")
    above, before = {}, 0
    for r, count in sorted(dealt.filter(able).groupBy("range").count().collect()):
        if before < limit:
            above[r] = before
        before += count
    first = F.broadcast(spark.createDataFrame(pa.table({"range": pa.array(list(above), pa.int32()), "above": pa.array(list(above.values()), pa.int64())})))
    by = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "n_words")
    rank = F.row_number().over(by) + F.col("above")
    ranked = dealt.join(first, "range").withColumn("rank", F.when(rank <= limit, rank))
    last = max(above, default=-1)
    rest = dealt.filter(F.col("range").isNull() | (F.col("range") > last)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every document."""
    raw = written(features(docs, low, high, buckets), "crc-features")
    gains = bucket_gains(raw, features(target, low, high, buckets, id_col=target_id), buckets)
    scored = written(weights(raw, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "crc-scores")
    return drawn(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
