"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and reread as the next one's docs.  All but the last return the columns of documents; the
last adds each row's shard and slot.  ``run`` applies them to the documents of sf_dir.

Cases, the same for every stage: a null or empty text is kept, since no stage finds anything
in it; a null id is kept and never stands for another row; rows that are repeated are judged
alike, and the near-duplicate stage keeps one of them (of equal ids the first as stored); a
null source is a source of its own; extra columns pass through unchanged, and in the last
stage one named like a made column comes as that name with ``_before``; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrade.llm import decontaminate, feistel, mixing, toxicity
from lexigrade.llm.jaccard_join import one_of_each
from lexigrade.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by the model of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity of 0.8 or more."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to 1.5 times."""
    return mixing.mixed_documents(docs, repeat_limit=1.5)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; the columns of documents are kept."""
    return feistel.sharded(docs, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("temperature_mixing", mix_sources),
    ("feistel_sharding", shard),
]

#: Training, hashing and bisection aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = list(scratch.paths)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)  # what it was made of isn't read again
    return STAGES[-1][1](spark, docs, sf_dir)
