"""Driver table access: parquet scans with explicit column lists.

Selecting the columns at the scan keeps ``ReadSchema`` minimal, so a query
that needs ``doc_id`` never reads ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one driver table, pruned to ``columns``; its splits are what the files give, whatever their size."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
