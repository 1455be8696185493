"""File facts and per-repository statistics.

``file_facts`` is the one projection that reads ``content``: every regex
measure is evaluated in the same pass and ``content`` is dropped before any
shuffle, so the aggregations below move a handful of integers per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import paths as P
from repolens.functions import text as X
from repolens.operators.stack import MANIFESTS
from repolens.sources.corpus import repo_files


def file_facts(files: DataFrame, **more: Column) -> DataFrame:
    """One row per file: walk flags plus the content measures (no content), and the columns ``more`` of the input."""
    path, content = F.col("path"), F.col("content")
    ext = P.extension(path)
    df = files.select(
        "repo_id", "path", "size",
        F.when(path.isin(*MANIFESTS), content).alias("manifest_text"),
        P.is_kept(path).alias("kept"),
        ext.alias("ext"),
        P.is_test_walk(path).alias("is_test"),
        P.is_test_complexity(path).alias("is_test_cx"),
        P.is_css_module_candidate(path).alias("css_module"),
        content,
        *[c.alias(n) for n, c in more.items()],
    )
    ext = F.col("ext")
    readable = (F.col("kept") & P.is_code_ext(ext) & content.isNotNull()
                & (F.col("size") <= P.MAX_FILE_SIZE))
    return df.select(
        "repo_id", "path", "size", "kept", "ext", "is_test", "is_test_cx", "css_module", "manifest_text",
        P.is_config_ext(ext).alias("is_config"),
        P.is_code_ext(ext).alias("is_code"),
        readable.alias("readable"),
        F.when(readable, X.line_count(content)).alias("lines"),
        F.when(readable & ext.isin(*X.COMPONENT_EXTENSIONS), X.component_count(content))
         .when(readable, F.lit(0).cast("bigint")).alias("components"),
        F.when(readable, X.route_count(content)).alias("routes"),
        F.when(readable, (X.decision_count(content) + 1)).alias("complexity"),
        F.when(readable, X.function_count(content)).alias("functions"),
        *more,
    )


def corpus_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_facts(repo_files(spark, sf_dir))


def repo_stats(facts: DataFrame) -> DataFrame:
    """Per repository file, component, route, line, test and config counts.

    Grouping keeps every repository, also one whose files are all pruned.
    Partial aggregation runs map-side, so a huge repository costs one row per
    task before the shuffle.
    """
    kept = F.col("kept")
    return facts.groupBy("repo_id").agg(
        F.count_if(kept).cast("bigint").alias("file_count"),
        F.coalesce(F.sum(F.when(kept, F.col("components"))), F.lit(0)).cast("bigint").alias("component_count"),
        F.coalesce(F.sum(F.when(kept, F.col("routes"))), F.lit(0)).cast("bigint").alias("api_route_count"),
        F.coalesce(F.sum(F.when(kept, F.col("lines"))), F.lit(0)).cast("bigint").alias("line_count"),
        F.count_if(kept & F.col("is_test")).cast("bigint").alias("test_file_count"),
        F.count_if(kept & F.col("is_config")).cast("bigint").alias("config_file_count"),
    )


def files_by_extension(facts: DataFrame) -> DataFrame:
    """E2, long form: (repo_id, ext, file_count) over walked files."""
    return (facts.where("kept").groupBy("repo_id", "ext")
            .agg(F.count(F.lit(1)).cast("bigint").alias("file_count")))


def files_by_extension_map(facts: DataFrame) -> DataFrame:
    """E2 as the reference's record: one ``MAP<ext, count>`` per repository.

    The map has one entry per distinct extension, so its size is bounded by
    the number of extensions, not by the number of files.
    """
    return (files_by_extension(facts).groupBy("repo_id")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "file_count"))))
                 .alias("files_by_extension")))
