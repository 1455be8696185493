"""Technology detection in long form (D1-D8): dependencies joined with a catalogue table.

``stack.stack_profile`` keeps one wide row a repository. Here a dependency is a row
and the catalogue is a table that the caller may extend or replace, so it works on
any dependency inventory, whatever it was read from. The catalogue is broadcast only if
it has at most ``SMALL_CATALOG`` rows; a larger one is joined by shuffle. Labels are made
distinct before anything else is joined, so a repository with a third of all
dependencies is flattened in the tasks that read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.operators import stack as ST

SMALL_CATALOG = 100_000
CATALOG = "ord int, facet string, label string, dependency string, dev_only boolean, suppressed_by string"


def node_catalog_rows() -> list[tuple]:
    """The built-in catalogue, a row for each dependency of a label."""
    rows, place = [], 0
    for facet, labels in ST.NODE_CATALOG.items():
        for label, any_scope, dev_scope in labels:
            place += 1
            by = ST.REACT_SUPPRESSED_BY if label == "React" else None
            rows += [(place, facet, label, d, False, by) for d in any_scope] + [(place, facet, label, d, True, by) for d in dev_scope]
    return rows


def node_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(node_catalog_rows(), CATALOG)


def manifest_dependencies(files: DataFrame, path: str = "package.json") -> DataFrame:
    """(repo_id, dependency, dev) of every root manifest of ``files``; one that can't be parsed has none."""
    doc = F.try_parse_json("content")
    keys = lambda field: F.map_keys(F.try_variant_get("doc", f"$.{field}", "map<string,variant>"))
    docs = files.where(F.col("path") == path).select("repo_id", doc.alias("doc"))
    scoped = lambda field, dev: docs.select("repo_id", F.explode(keys(field)).alias("dependency"), F.lit(dev).alias("dev"))
    return scoped("dependencies", False).unionByName(scoped("devDependencies", True))


def detect(dependencies: DataFrame, catalog: DataFrame, small: int = SMALL_CATALOG) -> DataFrame:
    """(repo_id, facet, ord, label): labels of every repository, without those whose ``suppressed_by`` it depends on, too."""
    few = catalog.limit(small + 1).count() <= small
    table = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    hits = dependencies.join(table(catalog), "dependency").where(F.col("dev") | ~F.col("dev_only"))
    labels = hits.select("repo_id", "facet", "ord", "label", "suppressed_by").distinct()
    stronger = catalog.select(F.col("suppressed_by").alias("dependency")).where("dependency is not null").distinct()
    held = dependencies.join(table(stronger), "dependency", "left_semi").select("repo_id", F.col("dependency").alias("suppressed_by")).distinct()
    return labels.join(held, ["repo_id", "suppressed_by"], "left_anti").select("repo_id", "facet", "ord", "label").distinct()
