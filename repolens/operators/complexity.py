"""Code complexity per repository (operators B7, C4, C5, E6-E8).

The per-file measures come from ``file_facts`` (one regex pass). Here only
small integer columns are aggregated; the duplication bucket needs a second
aggregation level, which runs over (repo, bucket) counts, not over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
HIGH_COMPLEXITY = 15
HIGH_COMPLEXITY_TOP = 10
DUP_BUCKET_LINES = 50
DUP_HIGH, DUP_MEDIUM = 0.3, 0.15


def _round_half_up(x, digits: int = 0):
    scale = 10 ** digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def analysed(facts: DataFrame) -> DataFrame:
    """Code files that the complexity pass reads (walked, code, under the cap)."""
    return facts.where(F.col("readable"))


def repo_complexity(facts: DataFrame) -> DataFrame:
    """E6 + E8: averages, max, totals, lines per function, duplication risk.

    Every repository gets a row; one without analysable code files gets the
    all-zero ``low`` record.
    """
    a = facts
    prod = F.col("readable") & ~F.col("is_test_cx")
    per_repo = a.groupBy("repo_id").agg(
        F.count_if(prod).cast("bigint").alias("n"),
        F.sum(F.when(prod, F.col("complexity"))).alias("total_complexity"),
        F.max(F.when(prod, F.col("complexity"))).alias("max_c"),
        F.sum(F.when(prod, F.col("functions"))).alias("total_f"),
        F.sum(F.when(prod, F.col("lines"))).alias("total_lines"),
        F.count_if(F.col("readable") & F.col("is_test_cx")).cast("bigint").alias("test_files_excluded"),
    )
    bucket = (_round_half_up(F.col("lines") / DUP_BUCKET_LINES) * DUP_BUCKET_LINES).cast("bigint")
    dup = (a.where(prod).groupBy("repo_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
           .groupBy("repo_id").agg(F.max("c").alias("max_bucket")))
    n = F.col("n")
    ratio = F.col("max_bucket").cast("double") / n
    return per_repo.join(dup, "repo_id", "left").select(
        "repo_id",
        F.when(n > 0, _round_half_up(F.col("total_complexity").cast("double") / n, 1))
         .otherwise(F.lit(0.0)).alias("average_complexity"),
        F.coalesce(F.col("max_c"), F.lit(0)).cast("bigint").alias("max_complexity"),
        F.coalesce(F.col("total_f"), F.lit(0)).cast("bigint").alias("total_functions"),
        F.when(F.col("total_f") > 0,
               _round_half_up(F.col("total_lines").cast("double") / F.col("total_f")))
         .otherwise(F.lit(0)).cast("bigint").alias("lines_per_function"),
        F.when(n == 0, F.lit("low")).when(ratio > DUP_HIGH, F.lit("high"))
         .when(ratio > DUP_MEDIUM, F.lit("medium")).otherwise(F.lit("low")).alias("duplication_risk"),
        "test_files_excluded",
    )


def high_complexity_files(facts: DataFrame, top: int = HIGH_COMPLEXITY_TOP) -> DataFrame:
    """Complexity > 15, highest first, at most ``top`` per repository.

    The rank filter lets Catalyst insert a window-group limit before the
    shuffle, so each task forwards at most ``top`` rows per repository.
    """
    w = Window.partitionBy("repo_id").orderBy(F.col("complexity").desc(), F.col("path"))
    return (analysed(facts).where(~F.col("is_test_cx") & (F.col("complexity") > HIGH_COMPLEXITY))
            .select("repo_id", "path", "complexity", "functions", F.row_number().over(w).alias("rank"))
            .where(F.col("rank") <= top)
            .select("repo_id", F.col("rank").cast("bigint").alias("rank"), "path", "complexity", "functions"))
