"""Bounded samples of labelled rows, with the held-out fold left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, fold: int) -> Column:
    """crc32 of the id as text, modulo fold; a null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % fold


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, fold: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold, taken by hash of the id.

    Of several labels of a document the mean counts, 1 from 0.5 on; null labels count for nothing. Of several
    texts of a document the least counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(remainder(F.col("doc_id"), fold) != held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "label")


def one_text(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each doc_id and columns, with its least text, so that an id that repeats without bound gives one row."""
    return rows.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", "text", *columns)
