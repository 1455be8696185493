"""The facts store: what reports and requests read, computed once and written.

``files`` holds the measures of every file, ``secrets`` the findings, each from one pass
over the contents. Both may hold a third of their rows in one repository, so they are plain
files in the checkpoint folder, aggregated map-side by what reads them. ``profile`` has
one row a repository; it is a table bucketed and sorted by ``repo_id``, which joins on
``repo_id`` read without an exchange.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators import files as FF
from repolens.operators import profile as PR
from repolens.operators import secrets as SC
from repolens.session import checkpointed, ensure_checkpoint_dir


@dataclass
class FactsStore:
    files: DataFrame
    secrets: DataFrame
    profile: DataFrame
    table: str

    def scanned(self) -> DataFrame:
        """Per repository, how many files the secret scan read."""
        return self.files.groupBy("repo_id").agg(F.count_if("scanned").cast("bigint").alias("files_scanned"))


def persist(repo_files: DataFrame, name: str | None = None, buckets: int | None = None) -> FactsStore:
    """Write the store of a table of files (repo_id, path, size, content); ``name`` of the profile's table, ``buckets`` of it."""
    spark = repo_files.sparkSession
    table = name or f"repolens_profile_{uuid.uuid4().hex}"
    files = checkpointed(FF.file_facts(repo_files, scanned=SC.is_scanned()))
    secrets = checkpointed(SC.scan_secrets(repo_files))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    PR.repo_profile(files).repartition(buckets, "repo_id").write.mode("overwrite").bucketBy(buckets, "repo_id").sortBy("repo_id") \
        .option("path", f"{ensure_checkpoint_dir(spark)}/{table}").saveAsTable(table)
    return FactsStore(files, secrets, spark.table(table), table)
