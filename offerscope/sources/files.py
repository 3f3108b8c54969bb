"""Sources and sinks: page corpora, labelled passages, review sheets, keyed replacement."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the page corpus.
PAGE_SCHEMA = "kayit_id string, banka_key string, banka_adi string, kaynak_url string, arsiv_url string, sayfa_basligi string, ham_metin string, anlik_goruntu_tarihi string, toplanma_tarihi string, kategori_tahmini string, kampanya_mi boolean, guncel_mi boolean, _corrupt_record string"


def read_pages(spark: SparkSession, path: str, archive: bool = True) -> DataFrame:
    """JSON lines of pages: text and URL needed, key from the text's digest where missing; live rows (flag true or missing) go on the archive path."""
    rows = spark.read.schema(PAGE_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.filter("trim(ham_metin) <> '' and trim(kaynak_url) <> ''")
    if archive:
        rows = rows.filter("not coalesce(guncel_mi, true)")
    return rows.withColumn("kayit_id", F.coalesce(F.nullif(F.trim("kayit_id"), F.lit("")), F.concat(F.lit("archive-"), F.substring(F.sha2("ham_metin", 256), 1, 20))))


def read_review_csv(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """Review sheet with a byte order mark perhaps; answers trimmed and in capitals."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.withColumn(answer, F.upper(F.trim(answer)))


# Files and fields of the labelled dataset.
LABELLED = {
    "documents": ("ara/dokumanlar.jsonl", "kayit_id string, banka_key string, banka_adi string, kaynak_url string, sayfa_basligi string, ham_metin string, ozet_metin string, kampanya_turu_kod string, kampanya_turu string, guven double, kaynak string, gerekce string, dogrulandi boolean, otomatik_kabul boolean"),
    "passages": ("ara/pasajlar.jsonl", "pasaj_id string, kayit_id string, kampanya_turu_kod string, metin string, belge_ofseti long, dogrulandi boolean, otomatik_kabul boolean, spanlar array<struct<baslangic:int,bitis:int,etiket:string,metin:string,normal_deger:string,guven:double,kaynak:string>>"),
    "class_samples": ("final/siniflandirma/{split}.jsonl", "id string, metin string, etiket string, etiket_kod string, dogrulandi boolean"),
    "extraction_samples": ("final/bilgi_cikarim/{split}.jsonl", "id string, tokens array<string>, ner_tags array<string>, dogrulandi boolean"),
}
SPLITS = ("train", "val", "test")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that may begin with a byte order mark; blank lines are skipped, a line that isn't JSON fails the job."""
    lines = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit("\ufeff")).alias("value")).filter("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_labelled(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, passages, spans (with span_index from 0), class_samples and extraction_samples (with their split) of a dataset folder."""
    out = {}
    for name, (file, schema) in LABELLED.items():
        if "{split}" in file:
            out[name] = reduce(DataFrame.unionByName, (read_jsonl(spark, f"{path}/{file.format(split=s)}", schema).withColumn("split", F.lit(s)) for s in SPLITS))
        else:
            out[name] = read_jsonl(spark, f"{path}/{file}", schema)
        if "dogrulandi" in out[name].columns:
            out[name] = out[name].withColumn("dogrulandi", F.coalesce("dogrulandi", F.lit(False)))
    out["spans"] = out["passages"].select("pasaj_id", "dogrulandi", F.posexplode("spanlar").alias("span_index", "s")).select("pasaj_id", "span_index", "s.*", "dogrulandi")
    out["passages"] = out["passages"].drop("spanlar")
    return out


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_review_csv(rows: DataFrame, path: str, confidence: str, key: str, answers: list[str]) -> None:
    """Sheet in the order of confidence with blank answer columns, range-sorted over its files."""
    rows.select("*", *(F.lit("").alias(a) for a in answers)).orderBy(F.col(confidence).desc_nulls_last(), key).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_versioned(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replaces the buckets of the rows' keys: idempotent, other buckets stay."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
