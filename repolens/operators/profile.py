"""The wide per-repository profile: statistics, complexity and stack in one pass.

One scan of the corpus feeds a two-level aggregation:

1. ``groupBy(repo_id, bucket)`` where ``bucket`` is the duplication line
   bucket of production code files (NULL for every other file) - all
   aggregates are decomposable (sum, count, max, bool_or);
2. ``groupBy(repo_id)`` re-aggregates those partial rows and takes the
   largest bucket count.

So the regex pass over file content runs once, content never crosses a
shuffle (only root manifest texts do), and a huge repository is flattened
by map-side partial aggregation before either shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators import complexity as CX
from repolens.operators import stack as ST


def repo_profile(facts: DataFrame) -> DataFrame:
    kept, readable = F.col("kept"), F.col("readable")
    prod = readable & ~F.col("is_test_cx")
    bucket = F.when(prod, (F.floor(F.col("lines") / CX.DUP_BUCKET_LINES + 0.5) * CX.DUP_BUCKET_LINES)
                    .cast("bigint"))
    level1 = facts.groupBy("repo_id", bucket.alias("bucket")).agg(
        F.count_if(kept).alias("file_count"),
        F.sum(F.when(kept, F.col("components"))).alias("component_count"),
        F.sum(F.when(kept, F.col("routes"))).alias("api_route_count"),
        F.sum(F.when(kept, F.col("lines"))).alias("line_count"),
        F.count_if(kept & F.col("is_test")).alias("test_file_count"),
        F.count_if(kept & F.col("is_config")).alias("config_file_count"),
        F.count_if(prod).alias("n"),
        F.sum(F.when(prod, F.col("complexity"))).alias("total_complexity"),
        F.max(F.when(prod, F.col("complexity"))).alias("max_c"),
        F.sum(F.when(prod, F.col("functions"))).alias("total_f"),
        F.sum(F.when(prod, F.col("lines"))).alias("total_lines"),
        F.count_if(readable & F.col("is_test_cx")).alias("test_files_excluded"),
        *ST.marker_aggregates(),
    )
    sums = ["file_count", "component_count", "api_route_count", "line_count", "test_file_count",
            "config_file_count", "n", "total_complexity", "total_f", "total_lines", "test_files_excluded"]
    marker_cols = [c for c in level1.columns if c.startswith(("m_", "d_", "t_"))] + ["has_css_modules"]
    level2 = level1.groupBy("repo_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
        F.max("max_c").alias("max_c"),
        F.max(F.when(F.col("bucket").isNotNull(), F.col("n"))).alias("max_bucket"),
        *[F.max(c).alias(c) for c in marker_cols if not c.startswith("t_")],
        *[F.flatten(F.collect_list(c)).alias(c) for c in marker_cols if c.startswith("t_")],
    )
    level2 = ST.first_manifest(level2)
    n = F.col("n")
    ratio = F.col("max_bucket").cast("double") / n
    with_cx = level2.select(
        "*",
        F.when(n > 0, F.floor(F.col("total_complexity").cast("double") / n * 10 + 0.5) / 10)
         .otherwise(F.lit(0.0)).alias("average_complexity"),
        F.coalesce(F.col("max_c"), F.lit(0)).cast("bigint").alias("max_complexity"),
        F.col("total_f").alias("total_functions"),
        F.when(F.col("total_f") > 0, F.floor(F.col("total_lines").cast("double") / F.col("total_f") + 0.5))
         .otherwise(F.lit(0)).cast("bigint").alias("lines_per_function"),
        F.when(n == 0, F.lit("low")).when(ratio > CX.DUP_HIGH, F.lit("high"))
         .when(ratio > CX.DUP_MEDIUM, F.lit("medium")).otherwise(F.lit("low")).alias("duplication_risk"),
    )
    keep = ["file_count", "component_count", "api_route_count", "line_count", "test_file_count",
            "config_file_count", "average_complexity", "max_complexity", "total_functions",
            "lines_per_function", "duplication_risk", "test_files_excluded"]
    return ST.stack_profile(with_cx, passthrough=keep)
