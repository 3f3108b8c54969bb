"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document, in one pass without a shuffle: `ledger`
stores the measurements and one bit for each failed rule. Policies are versioned masks over
these bits, so a new policy or an ablation reads the ledger and not the texts. Ablations are
bitwise aggregates: rows whose failures lie within one rule's bit, and so on.

Defined results: null or empty text has no words (all measurements 0, fails `few_words`);
a null doc_id is kept as null; repeated rows are each judged alone; other columns of the
input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.words import lean, word_tables

#: Bit of each rule.
RULES = {
    "few_words": 0,  # fewer than 20 words
    "repeated_windows": 1,  # over 30 % of the words in 8-word windows found twice
    "symbol_words": 2,  # over a tenth as many symbols as words
    "odd_word_length": 3,  # mean word length outside 2 to 14 code points
    "repeated_lines": 4,  # over 30 % of the lines with a word repeat an earlier one
    "one_word_dominates": 5,  # over 30 % of the words are runs: equal to the word before
    "shouting": 6,  # over half of the ASCII letters are capitals
    "short_lines": 7,  # 3 lines or more with 4 words or fewer in the middle, and separators
}
BASE = 1 << RULES["few_words"] | 1 << RULES["repeated_windows"]
#: Versioned policies: a document is kept if it fails no rule of the mask.
POLICIES = {
    1: BASE,
    2: BASE | 1 << RULES["symbol_words"] | 1 << RULES["odd_word_length"],
    3: BASE | 1 << RULES["symbol_words"] | 1 << RULES["odd_word_length"] | 1 << RULES["one_word_dominates"] | 1 << RULES["shouting"] | 1 << RULES["short_lines"],
}
CURRENT = 3
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document: lines with a word that equal an earlier line, and lines with a word."""
    n = len(offsets) - 1
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    text = data.tobytes()
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        own = text[a:b].split(b"\n")
        if len(own) == 1:
            lines[i] = bool(own[0].strip(b" \t\n\v\f\r"))
            continue
        full = [x for x in own if x.strip(b" \t\n\v\f\r")]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    return dup, lines


def measure(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    for w in word_tables(column):
        n = w.hi - w.lo
        first = w.first()
        words = np.diff(first)
        lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
        per_word = lead[w.end] - lead[w.start]
        chars = np.bincount(w.doc, per_word, n).astype(np.int64)
        g, ok = w.grams(WINDOW)
        at = np.flatnonzero(ok)
        key = g[at] ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(w.start) + WINDOW + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        covered = np.cumsum(edge)[: len(w.start)] > 0
        dup, lines = _dup_lines(w.data, w.offsets, w.start)
        runs = np.zeros(len(w.hash), bool)
        runs[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        upper = _sums((w.data >= 65) & (w.data <= 90), w.offsets)
        letters = upper + _sums((w.data >= 97) & (w.data <= 122), w.offsets)
        bar = _sums(w.data == 124, w.offsets)
        m = {
            "n_words": words,
            "word_chars": chars,
            "n_symbols": _sums(_SYMBOL[w.data], w.offsets),
            "n_dup_lines": dup,
            "n_repeat_words": np.bincount(w.doc, covered, n).astype(np.int64),
        }
        failed = {
            "few_words": words < 20,
            "repeated_windows": 100 * m["n_repeat_words"] > 30 * words,
            "symbol_words": 10 * m["n_symbols"] > words,
            "odd_word_length": (chars < 2 * words) | (chars > 14 * words),
            "repeated_lines": 10 * dup > 3 * lines,
            "one_word_dominates": 10 * np.bincount(w.doc, runs, n) > 3 * words,
            "shouting": 2 * upper > letters,
            "short_lines": (5 * bar > words) & (lines >= 3),
        }
        m["failed_bits"] = sum((failed[k].astype(np.int64) << b for k, b in RULES.items()), np.zeros(n, np.int64))
        yield m


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for m in measure(batch.column(1)):
            n = len(m["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), *(pa.array(m[k], pa.int64()) for k in (*MEASURES, "failed_bits"))], names=["doc_id", *MEASURES, "failed_bits"])
            done += n


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_ledger), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed_bits long")


def keep_documents(docs: DataFrame, version: int = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that a policy keeps; one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [m["failed_bits"] for m in measure(batch.column(at))]
            if bits:
                yield batch.filter(pa.array(np.concatenate(bits) & (BASE | POLICIES[version]) == 0))

    return docs.mapInArrow(lean(run), docs.schema)


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a policy."""
    return rows.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(BASE | POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, and rows kept without it."""
    mask = POLICIES[version]
    bits = rows.groupBy("failed_bits").count()  # one row for each pattern of failures, whatever the corpus size
    rules = [(name, 1 << b) for name, b in RULES.items() if mask >> b & 1]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).cast("long").alias("bit")) for n, v in rules)))
    out = bits.select("failed_bits", "count", each.alias("r")).select("failed_bits", "count", "r.rule", "r.bit")
    own = F.col("failed_bits").bitwiseAND(F.lit(mask))
    return out.groupBy("rule").agg(
        F.sum(F.when(own.bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(own == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
        F.sum(F.when(own.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )
