"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrade.llm import cover_tree, decontaminate, feistel, fingerprint_index, mixing, perspectives, pii, suffix_dedup, toxicity
from lexigrade.llm.jaccard_join import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_log_structured_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.deduplicated(_table(spark, sf_dir, "documents"))


def op3_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op4_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.sharded(_table(spark, sf_dir, "documents"))


def op6_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rendered(_table(spark, sf_dir, "conversations"))


def op8_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_log_structured_dedup": op2_log_structured_dedup,
    "op3_difference_cover_dedup": op3_difference_cover_dedup,
    "op4_boosted_personal_data": op4_boosted_personal_data,
    "op5_feistel_sharding": op5_feistel_sharding,
    "op6_cover_tree_near_dedup": op6_cover_tree_near_dedup,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_multiple_instance_toxicity": op8_multiple_instance_toxicity,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_log_structured_dedup": fingerprint_index.ORACLE_SQL,
    "op3_difference_cover_dedup": suffix_dedup.ORACLE_SQL,
    "op6_cover_tree_near_dedup": cover_tree.ORACLE_SQL,
    "op7_perspective_rotation": perspectives.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
}
