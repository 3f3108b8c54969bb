"""Corpus curation: duplicates, versions, gates, template lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from offerscope.functions.text import content_digest


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the digest of the squeezed text and its length; rows with null text have neither."""
    return docs.withColumn("digest", content_digest(text)).withColumn("chars", F.length(text))


def exact_dedup(docs: DataFrame, order: list[Column | str], key: str = "digest") -> DataFrame:
    """First row of each digest in an explicit order. Only `key` and the order columns are grouped where the order is one id column."""
    if len(order) == 1 and isinstance(order[0], str):
        first = docs.groupBy(key).agg(F.min(order[0]).alias("first_id"))  # combined before the shuffle, so a hot digest is one row for each task
        return docs.join(first.select("first_id"), docs[order[0]] == F.col("first_id"), "left_semi")
    w = Window.partitionBy(key).orderBy(*order)
    return docs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def exclude_known(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates with neither a live digest nor a live key; whether their URL is live is flagged."""
    rows = candidates.join(live.select("digest").distinct(), "digest", "left_anti").join(live.select("record_key").distinct(), "record_key", "left_anti")
    return rows.join(live.select("url").distinct().withColumn("is_version", F.lit(True)), "url", "left").withColumn("is_version", F.coalesce("is_version", F.lit(False)))


def incremental_gate(candidates: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Rows whose key, digest and pipeline version aren't all in the state."""
    done = state.filter(F.col("version") == version).select("record_key", "digest").distinct()
    return candidates.join(done, ["record_key", "digest"], "left_anti")


def intake_action(incoming: DataFrame, current: DataFrame, allow_updates: bool = False) -> DataFrame:
    """One action for each incoming record (record_key, bank, digest, review), in order of priority.

    Known key and same digest: unchanged_skipped; unknown key and the bank has the digest:
    duplicate_content_skipped; classification in review: review_queued; known key, other digest and
    no updates allowed: changed_document_review_queued; else updated or inserted.
    """
    by_key = current.select("record_key", F.col("digest").alias("old_digest")).dropDuplicates(["record_key"])
    by_text = current.select("bank", "digest").distinct().withColumn("copy", F.lit(True))
    rows = incoming.join(by_key, "record_key", "left").join(by_text, ["bank", "digest"], "left")
    known = F.col("old_digest").isNotNull()
    action = (
        F.when(known & (F.col("old_digest") == F.col("digest")), "unchanged_skipped")
        .when(~known & F.col("copy").isNotNull(), "duplicate_content_skipped")
        .when(F.col("review"), "review_queued")
        .when(known & F.lit(not allow_updates), "changed_document_review_queued")
        .when(known, "updated")
        .otherwise("inserted")
    )
    return rows.select("record_key", "bank", "digest", action.alias("action"))


#: Characters of template lines of all banks that are broadcast.
TEMPLATE_CHARS = 8 << 20


def template_lines(docs: DataFrame, share: float = 0.6, most: int = 200, bank: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bank, line) of short lines on more than `share` of a bank's pages.

    The lines of a page are made distinct before they are exploded, so counting needs no distinct,
    and counts are combined before the shuffle.
    """
    lines = docs.select(F.col(bank).alias("bank"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), F.trim))).alias("line")).filter((F.col("line") != "") & (F.length("line") <= most))
    pages = docs.groupBy(F.col(bank).alias("bank")).agg(F.count("*").alias("pages"))
    return lines.groupBy("bank", "line").agg(F.count("*").alias("n")).join(pages, "bank").filter(F.col("n") > share * F.col("pages")).select("bank", "line", "n", "pages")


def drop_template_lines(docs: DataFrame, share: float = 0.6, most: int = 200, bank: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the template lines of the page's bank removed.

    A bank has at most 1 / share times the lines of an average page as template lines, so they are
    gathered to one array for each bank and filtered from the text in place: pages aren't exploded
    a second time.
    """
    gone = template_lines(docs, share, most, bank, key, text).groupBy("bank").agg(F.collect_list("line").alias("lines")).persist()
    size = gone.agg(F.sum(F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x)))).first()[0] or 0
    gone = F.broadcast(gone) if size <= TEMPLATE_CHARS else gone  # beyond it texts are joined on the bank
    rows = docs.join(gone, docs[bank] == gone["bank"], "left")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("lines", F.trim(x)))
    return rows.select(key, F.when(F.col("lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("text"))


def passage_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages (lines) of all documents, each text once, at its first document and place."""
    passages = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "passage")).filter(F.trim("passage") != "")
    first = passages.groupBy(F.sha2("passage", 256).alias("digest")).agg(F.min(F.struct(key, "at", "passage")).alias("first"), F.count("*").alias("copies"))
    return first.select(F.col(f"first.{key}").alias(key), F.col("first.at").alias("place"), "first.passage", "copies")


def select_snapshots(snaps: DataFrame, n: int, group: str = "page", day: str = "day", key: str = "snap_id") -> DataFrame:
    """At most n captures of each group, spread evenly over its order of days; one: the last."""
    w = Window.partitionBy(group)
    rows = snaps.withColumn("rn", F.row_number().over(w.orderBy(day, key)) - 1).withColumn("total", F.count("*").over(w))
    k = F.least(F.lit(n), F.col("total"))
    wanted = F.when(k == 1, F.array(F.col("total") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(1))), lambda i: F.bround(i * (F.col("total") - 1) / F.greatest(k - 1, F.lit(1))).cast("long")))
    return rows.filter(F.array_contains(wanted, F.col("rn").cast("long"))).drop("rn", "total")


def overlap_audit(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Per bank: rows, unique texts, and overlap with the live corpus by text."""
    marked = archive.join(live.select("digest").distinct().withColumn("live", F.lit(True)), "digest", "left")
    return marked.groupBy("bank").agg(F.count("*").alias("rows"), F.countDistinct("digest").alias("unique_texts"), F.count("live").alias("live_texts"))


#: Pages of candidate pairs whose ids are broadcast, if there are no more than so many; beyond that texts are joined on the id.
CANDIDATE_IDS = 1_000_000


def _banded(bands: int, width: int, seed: int = 5, most: int = 1 << 20) -> Callable:
    """Rows (u, own), of which those with shingles stay, as (u, n, bands): the number of shingles and the bands' hashes, `width` minima each, of some `most` shingles at a time."""
    rng = np.random.default_rng(seed)
    mask, odd = (rng.integers(0, 1 << 63, bands * width, np.uint64) for _ in range(2))
    odd = odd << np.uint64(1) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            if not batch.num_rows:
                continue
            own = batch.column(1)
            hashes, n = own.flatten().to_numpy().view(np.uint64), own.value_lengths()
            ends = np.cumsum(n.to_numpy().astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            out = np.zeros((batch.num_rows, bands), np.uint64)
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
                part, first = hashes[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
                for i in range(bands * width):
                    least = np.minimum.reduceat((part ^ mask[i]) * odd[i], first)
                    out[at:to, i // width] = (out[at:to, i // width] ^ least) * odd[i // width] + least
                at = to
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, bands, dtype=np.int32), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, lists], names=["u", "n", "bands"])

    return run


def near_dup_clusters(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", bands: int = 10, width: int = 4) -> DataFrame:
    """(key, cluster): near-identical pages by MinHash over word 5-shingles, clustered by least labels.

    Pages with equal text are one item. A band is `width` minima together, so boilerplate alone gives no candidates. In each
    band's bucket a page is compared with the bucket's least page, exactly on the shingles' hashes, so a bucket gives as many pairs as it
    has pages. Approximate: a pair of similarity s meets in a band with chance 1 - (1 - s^width)^bands (0.995 at
    0.8 with 10 bands of 4). The label rounds stop when nothing changes.
    """
    from pyspark.ml.feature import NGram, RegexTokenizer

    def sets(texts: DataFrame) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="words", pattern="\\s+").transform(texts)
        return NGram(n=5, inputCol="words", outputCol="grams").transform(words).select("u", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))).alias("own"))

    items = docs.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(key).alias("u"))
    owned = sets(docs.join(items, docs[key] == items["u"]).select("u", F.coalesce(text, F.lit("")).alias(text)))
    hashed = owned.mapInArrow(_banded(bands, width), StructType([owned.schema["u"], StructField("n", IntegerType()), StructField("bands", ArrayType(LongType()))])).checkpoint()
    rows = hashed.select("u", "n", F.posexplode("bands").alias("i", "h"))
    heads = rows.groupBy("i", "h").agg(F.min(F.struct("u", "n")).alias("head"), F.max("u").alias("last")).filter("head.u < last").select("i", "h", F.col("head.u").alias("v"), F.col("head.n").alias("m"))
    pairs = rows.join(heads, ["i", "h"]).filter(F.col("u") != F.col("v")).filter(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("u", "v").distinct().checkpoint()
    # only pages of a pair are read again, so neither all texts nor all shingles are written
    asked = pairs.select("u").union(pairs.select("v")).distinct()
    asked = F.broadcast(asked) if asked.limit(CANDIDATE_IDS + 1).count() <= CANDIDATE_IDS else asked
    own = sets(docs.join(asked, docs[key] == asked["u"]).select("u", text)).checkpoint()
    both = pairs.join(own, "u").join(own.select(F.col("u").alias("v"), F.col("own").alias("other")), "v")
    shared = F.size(F.array_intersect("own", "other"))
    labels = least_labels(both.filter(shared >= similarity * (F.size("own") + F.size("other") - shared)).select("u", "v"))
    named = docs.select(key, F.sha2(text, 256).alias("digest")).join(items, "digest", "left")
    return named.join(labels, named["u"] == labels["node"], "left").select(key, F.coalesce("label", "u", key).alias("cluster"))


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, label): least node of each component of edges (u, v), by rounds over checkpointed tables until no label changes."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("label")).checkpoint()
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        after = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = after.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = after.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")).checkpoint()
        labels = after.select("node", "label")
        if not after.filter("old <> label").limit(1).count():
            return labels


def _collapse(text: str, most: int = 8) -> str:
    lines = text.split("\n")
    for size in range(1, most + 1):
        out: list[str] = []
        i = 0
        while i < len(lines):
            block = lines[i : i + size]
            again = i + size
            while len(block) == size and any(x.strip() for x in block) and lines[again : again + size] == block:
                again += size
            if again > i + size:
                out += block
                i = again
            else:
                out.append(lines[i])
                i += 1
        lines = out
    return "\n".join(lines)


def collapse_repeated_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with immediately repeated blocks of 1 to 8 lines, smallest first, as one; sequential in a page, so an Arrow UDF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=batch["text"].map(lambda t: None if t is None else _collapse(t)))

    rows = docs.select(key, F.col(text).alias("text"))
    return rows.mapInPandas(run, rows.schema)
