"""Quarantine of bad input rows (A2, A3, B10): one pass writes accepted and rejected rows to two sinks.

The pass counts what it reads and what it sends to either sink (``observe``); the counts have to add up, and to
agree with what the sinks hold afterwards, or the input counts as not loaded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ACCEPTED, REJECTED = "accepted", "rejected"


def quarantine(rows: DataFrame, reason: Column, path: str) -> dict[str, int]:
    """Write ``rows`` under ``path``, rejected ones (with a non-null ``reason``) with ``reject_reason``; the counts of both sinks."""
    seen = Observation("quarantine")
    marked = rows.withColumn("reject_reason", reason).withColumn("sink", F.when(F.col("reject_reason").isNull(), ACCEPTED).otherwise(REJECTED))
    marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sink") == ACCEPTED).alias(ACCEPTED),
                   F.count_if(F.col("sink") == REJECTED).alias(REJECTED)).write.mode("overwrite").partitionBy("sink").parquet(path)
    counts = seen.get
    spark = rows.sparkSession
    held = {s: read(spark, path, s, rows.schema).count() for s in (ACCEPTED, REJECTED)}
    if held != {s: counts[s] for s in held} or counts["rows"] != sum(held.values()):
        raise RuntimeError(f"{path}: read {counts}, written {held}")
    return held


def read(spark: SparkSession, path: str, sink: str, schema) -> DataFrame:
    """One sink's rows, of the schema of the input and ``reject_reason``; a sink without rows is empty."""
    whole = StructType([*schema.fields, StructField("reject_reason", StringType()), StructField("sink", StringType())])
    return spark.read.schema(whole).parquet(path).where(F.col("sink") == sink).drop("sink")
