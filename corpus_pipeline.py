"""The corpus pipeline: quality, near duplicates, benchmark passages, source mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each result as Parquet in the
shared checkpoint folder and reads it again as the next stage's input.

In every stage a null text counts as an empty one and texts of any length are read whole; null ids,
languages and sources are values like others; repeated rows are rows of their own (the duplicate stage keeps one of
them); an empty table stays empty; columns of any other name are carried along, also ones named like what a stage adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import decontamination, jaccard, mixing, quality, sharding
from repolens.llm.common import read, saved, shared_folder, short_batches

SHARDS = 8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more), learnt from all labels of the documents.

    Null and empty texts are scored like others, by their statistics; equal texts have equal scores, and a score of exactly 0.5 is kept;
    a null id has no label. Without labels every score is 0.5, so all stay."""
    short_batches(spark)
    stats = saved(docs.select("doc_id", quality.stats_column("text").alias("stats")))
    model = quality.fit(stats, quality.labelled_stats(stats, read(spark, sf_dir, "labels", "doc_id", "quality")))
    return docs.where(quality.score_column(model, quality.stats_column("text")) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, Jaccard 0.8 or more.

    Texts without words have no shingles, are linked with nothing and all stay; of repeated rows and of ties one row stays."""
    short_batches(spark)
    return jaccard.representatives(docs, shingle=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.

    Null and empty texts have no words and stay; without benchmark items all documents stay."""
    short_batches(spark)
    added = max(docs.columns, key=len) + "_hit"  # longer than any name there is
    hit = decontamination.flagged(docs, read(spark, sf_dir, "benchmark"), added=added)
    return hit.where(F.size(F.col(f"{added}.hits")) == 0).drop(added)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson count towards equal bytes of every source, in shuffled order.

    A null source is a source of its own; a null or empty text has one byte; repeated rows have equal counts."""
    return mixing.mix(docs, added=False)


def shard_assignment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot.

    Nulls and texts of any length take part in the row's hash; repeated rows get a place each; a column named like an added
    one comes back as ``<name>_input``."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shard_assignment),
]

#: SQL expresses neither the classifier nor the hashes of the permutation; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
