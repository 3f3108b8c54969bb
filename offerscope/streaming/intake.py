"""Intake of pages: each batch decides an action for every page, then replaces its documents, chunks and facts, once whatever is repeated.

The tables lie in a folder, each dealt by a hash of its key into buckets. A batch writes new files for the buckets that it touches and last
its manifest, which names the batch that wrote each bucket; that file's appearance is the commit. A batch that was killed has left
files that no manifest names, and is done again from the same tables; a committed batch that is repeated finds its number and does nothing. Readers take the
newest manifest, so they never see half a batch. What a batch reads and writes grows with its own pages and the buckets they fall in.

Actions, in this order: unchanged_skipped (known key, same digest and version), reprocessed as `updated` (an older version), duplicate_content_skipped (new key, its bank
has the digest, or a smaller new key of the batch brings it), review_queued, changed_document_review_queued (no updates allowed), updated, inserted.

Defined results: of several pages of a key in a batch the newest counts (then the greater digest); pages without key or text are left out; a null bank is a bank of
its own; null `review` counts as false; extra columns are ignored; empty batches only move the number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from offerscope.functions.text import content_digest
from offerscope.operators.chunk import chunk_documents
from offerscope.operators.facts import cap_facts, segments
from offerscope.operators.typed_rules import typed_rules

PAGE = "record_key string, bank string, title string, text string, product string, review boolean, ts timestamp"
#: table: (columns, key of its buckets)
TABLES = {
    "documents": ("record_key string, bank string, title string, text string, product string, digest string, version string, ts timestamp", ("record_key",)),
    "digests": ("record_key string, bank string, digest string", ("bank", "digest")),
    "chunks": ("record_key string, chunk_index int, section string, content string, n_words int", ("record_key",)),
    "facts": ("record_key string, at int, fact_type string, fact_text string, evidence string, confidence double, ordinal int", ("record_key",)),
    "reviews": ("record_key string, bank string, digest string, reason string, version string", ("record_key",)),
}
SAME, COPY, REVIEW, CHANGED, UPDATED, INSERTED = "unchanged_skipped", "duplicate_content_skipped", "review_queued", "changed_document_review_queued", "updated", "inserted"


def default_facts(docs: DataFrame) -> DataFrame:
    """Facts of documents (record_key, product, text) by the typed rules, capped."""
    rows = segments(docs, key="record_key").join(docs.select("record_key", "product"), "record_key")
    return cap_facts(typed_rules(rows, key="record_key"), key="record_key")


class Intake:
    """The tables of an intake folder, and the batches that change them.

    `version` names the pipeline; documents of another version are worked on again. `facts` turns documents into facts.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, buckets: int = 64, allow_updates: bool = True, facts: Callable[[DataFrame], DataFrame] = default_facts):
        self.spark, self.path, self.version, self.buckets, self.allow_updates, self.facts = spark, path.rstrip("/"), version, buckets, allow_updates, facts

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(k, F.lit("\0")) for k in key)), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[str, dict[int, int]]]:
        """The last committed batch and, for each table, the batch that wrote each bucket; at most a row for each table and bucket."""
        held: dict[str, dict[int, int]] = {t: {} for t in TABLES}
        try:
            all_ = self.spark.read.schema("name string, bucket int, written long, batch long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1, held
        last = all_.agg(F.max("batch")).first()[0]
        if last is None:
            return -1, held
        for r in all_.filter(F.col("batch") == last).collect():
            if r.name in held:
                held[r.name][r.bucket] = r.written
        return last, held

    def table(self, name: str, only: set[int] | None = None, held: dict[str, dict[int, int]] | None = None) -> DataFrame:
        """A table as of the last committed batch, or its buckets of `only`."""
        schema = TABLES[name][0]
        at = (held or self.manifest()[1])[name]
        paths = [f"{self.path}/{name}/batch={n}/bucket={b}" for b, n in sorted(at.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _stored(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        """Cuts lineage: a folder of this batch, which a repeat overwrites."""
        path = f"{self.path}/work/batch={number}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _touched(self, rows: DataFrame, name: str) -> set[int]:
        return {r[0] for r in rows.select(self.bucket(*TABLES[name][1])).distinct().collect()}

    def _replace(self, name: str, number: int, held: dict[str, dict[int, int]], touched: set[int], gone: DataFrame, on: list[str], new: DataFrame) -> None:
        """Writes the touched buckets without the rows of `gone` and with those of `new`."""
        if not touched:
            return
        columns = self.spark.createDataFrame([], TABLES[name][0]).columns
        old = self.table(name, touched, held).join(gone.select(*on).distinct(), on, "left_anti")
        rows = old.select(*columns).unionByName(new.select(*columns)).withColumn("bucket", self.bucket(*TABLES[name][1]))
        path = f"{self.path}/{name}/batch={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = {r[0] for r in self.spark.read.schema(TABLES[name][0] + ", bucket int").parquet(path).select("bucket").distinct().collect()}
        for b in touched:
            held[name].pop(b, None)
        held[name].update(dict.fromkeys(written, number))

    def apply(self, pages: DataFrame, number: int) -> None:
        """Does batch `number` once."""
        last, held = self.manifest()
        if last >= number:
            return
        given = [F.col(f.name) if f.name in pages.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], PAGE).schema]
        rows = pages.select(*given).filter(F.col("record_key").isNotNull() & (F.trim("text") != "")).withColumn("digest", content_digest("text"))
        newest = rows.groupBy("record_key").agg(F.max(F.struct("ts", "digest", "bank", "title", "text", "product", "review")).alias("p")).select("record_key", "p.*")
        incoming = self._stored(newest, "incoming", number)

        keys = self._touched(incoming, "documents")
        known = self.table("documents", keys, held).select("record_key", F.col("digest").alias("old_digest"), F.col("bank").alias("old_bank"), F.col("version").alias("old_version"))
        stored = self.table("digests", self._touched(incoming, "digests"), held).select(F.col("bank").alias("its_bank"), F.col("digest").alias("its_digest")).distinct().withColumn("copy", F.lit(True))
        joined = incoming.join(known, "record_key", "left").join(stored, F.col("bank").eqNullSafe(F.col("its_bank")) & (F.col("digest") == F.col("its_digest")), "left").drop("its_bank", "its_digest")
        old = F.col("old_digest").isNotNull()
        same = F.coalesce(F.col("old_digest") == F.col("digest"), F.lit(False))
        action = (
            F.when(same & (F.col("old_version") == self.version), SAME).when(~old & F.col("copy").isNotNull(), COPY).when(F.coalesce("review", F.lit(False)), REVIEW)
            .when(same, UPDATED).when(old & F.lit(not self.allow_updates), CHANGED).when(old, UPDATED).otherwise(INSERTED)
        )
        first = joined.withColumn("action", action)
        least = first.filter(F.col("action") == INSERTED).groupBy(F.col("bank").alias("its_bank"), F.col("digest").alias("its_digest")).agg(F.min("record_key").alias("least"))
        first = first.join(least, F.col("bank").eqNullSafe(F.col("its_bank")) & (F.col("digest") == F.col("its_digest")), "left").drop("its_bank", "its_digest")
        decided = self._stored(first.withColumn("action", F.when((F.col("action") == INSERTED) & (F.col("record_key") > F.col("least")), COPY).otherwise(F.col("action"))).drop("least", "copy"), "decided", number)
        decided.select("record_key", "bank", "digest", "action").write.mode("overwrite").parquet(f"{self.path}/actions/batch={number}")

        fresh = decided.filter(F.col("action").isin(INSERTED, UPDATED)).withColumn("version", F.lit(self.version))
        own = self._touched(fresh, "documents")
        before = fresh.filter(F.col("old_digest").isNotNull()).select("record_key", F.col("old_bank").alias("bank"), F.col("old_digest").alias("digest"))
        self._replace("documents", number, held, own, fresh, ["record_key"], fresh)
        self._replace("digests", number, held, self._touched(fresh, "digests") | self._touched(before, "digests"), before, ["record_key"], fresh)
        chunks = chunk_documents(fresh, key="record_key").withColumnRenamed("doc_id", "record_key")
        self._replace("chunks", number, held, own, fresh, ["record_key"], chunks)
        self._replace("facts", number, held, own, fresh, ["record_key"], self._stored(self.facts(fresh), "facts", number))
        queued = decided.filter(F.col("action").isin(REVIEW, CHANGED)).withColumns({"reason": F.when(F.col("action") == REVIEW, "classification_review").otherwise("existing_document_changed"), "version": F.lit(self.version)})
        self._replace("reviews", number, held, self._touched(queued, "reviews"), queued, ["record_key", "digest"], queued)

        rows = [(name, b, n) for name, at in held.items() for b, n in at.items()] or [("", 0, number)]
        self.spark.createDataFrame(rows, "name string, bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        work = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/work/batch={number}")
        work.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(work, True)

    def actions(self) -> DataFrame:
        """record_key, bank, digest, action, batch of the committed batches."""
        last, _ = self.manifest()
        return self.spark.read.schema("record_key string, bank string, digest string, action string, batch long").parquet(f"{self.path}/actions").filter(F.col("batch") <= last)


def intake_stream(pages: DataFrame, intake: Intake, checkpoint: str):
    """A stream of pages (PAGE; columns may lack) into an intake's tables, everything that is there and then stops."""
    return pages.writeStream.foreachBatch(intake.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
