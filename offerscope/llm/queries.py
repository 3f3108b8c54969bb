"""The registered queries op1_ to op13_, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerscope.llm import crc_resampling, decontaminate, hash_tree, jaccard_join, oracles, packing, periodic_runs, personal_data, quality_gbdt, quality_rules, secret_scan, substring_dedup, toxicity, warc
from offerscope.llm.shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.place(table(spark, sf_dir, "documents"), hash_tree.Tree(40))


def op3_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe() -> str:
    """Place of the tokenizer file; public_tokenizers comes with the installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), end_id=1)


def op5_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"), vocabulary=byte_bpe())


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.rewound(table(spark, sf_dir, "documents"))))


def op13_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find_personal(table(spark, sf_dir, "documents")))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the current policy: documents that fail it, that only it rejects, that stay without it."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_hash_tree_sharding": op2_hash_tree_sharding,
    "op3_quality_gbdt": op3_quality_gbdt,
    "op4_vector_packing": op4_vector_packing,
    "op5_zstd_warc": op5_zstd_warc,
    "op6_nnpu_toxicity": op6_nnpu_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_crc_resampling": op11_crc_resampling,
    "op12_recompression_runs": op12_recompression_runs,
    "op13_pii_boosting": op13_pii_boosting,
    "quality_rule_ablations": quality_rule_ablations,
}
ORACLES: dict[str, str] = oracles.ORACLES
