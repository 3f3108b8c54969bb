"""Views of the given tables in the roles of the knowledge base, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: publisher `bank`, product type, title, text, confidence and whether a reviewer confirmed them."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        "doc_id", F.col("source").alias("bank"), F.col("lang").alias("product"), F.substring_index("text", "\n", 1).alias("title"), "text",
        F.col("quality").cast("double").alias("confidence"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("verified"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of pages with the place in which they were found."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("fact_type"), F.format_string("%s %d", "l_linestatus", F.col("l_quantity").cast("int")).alias("fact_text"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("n"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated versions of pages: the group is a page, the status says whether it may be searched."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("snap_id"), F.col("o_custkey").alias("page"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("product"), (F.col("o_orderstatus") != "P").alias("searchable"), F.col("o_totalprice").alias("price"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


DOCS = """docs AS (SELECT d.doc_id, d.source AS bank, d.lang AS product, split_part(d.text, chr(10), 1) AS title, d.text, l.quality::DOUBLE AS confidence,
  coalesce(l.quality = 1 AND l.toxic = 0, false) AS verified FROM documents d LEFT JOIN labels l USING (doc_id))"""
FACTS = """facts AS (SELECT l_orderkey AS doc_id, l_returnflag AS fact_type, l_linestatus || ' ' || l_quantity::INT AS fact_text, l_quantity AS value, l_linenumber AS n FROM lineitem)"""
SNAPS = """snaps AS (SELECT o_orderkey AS snap_id, o_custkey AS page, o_orderdate::DATE AS day, o_orderpriority AS product, o_orderstatus <> 'P' AS searchable, o_totalprice AS price FROM orders)"""
