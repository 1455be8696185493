"""Dependency-audit reports.

Source: ``audit_reports(repo_id, audit_json)``, one JSON document per
repository as written by the package auditor. For the driver data the
reports are derived from ``lineitem`` x ``part`` (an order is a repository,
each line item a vulnerable package), serialised to JSON by Spark and parsed
back, so the parse path runs over data that grows with the tables.

Parsing keeps the documents' key order (``from_json`` into maps) and the JSON
types of ``via`` elements (``VARIANT``), so "first object element" is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.sources.tables import read_table

# Fixed values of the reference: severity buckets; anything else counts as low.
BUCKETS = ["critical", "high", "moderate"]
DEFAULT_SEVERITY = "low"

AUDIT_SCHEMA = ("struct<vulnerabilities: map<string, struct<severity: string, via: array<variant>>>, "
                "advisories: map<string, struct<module_name: string, severity: string, title: string, url: string>>>")

# Derivation parameters for the driver data (ours).
SEVERITY_BY_LINE = ["critical", "high", "moderate", "low", "info", None]
V6_EVERY, BOTH_EVERY, BROKEN_EVERY = 5, 7, 11
ADVISORY_URL = "https://advisories.example/"


def _json_text(c):
    """``c`` as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substr(quoted, F.lit(3), F.length(quoted) - 4))


def derive_audit_reports(spark: SparkSession, sf_dir: str, audited: DataFrame | None = None) -> DataFrame:
    """One JSON report per order (of ``audited`` by ``repo_id``, if given); entry ``k`` is the k-th line item by (line number, part, flag).

    Each entry's JSON is built per line item with plain column expressions;
    the per-order list that is then concatenated is bounded by one order's
    line items.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])
    # names are escaped once a part, not once a line item; of a concatenation the escaped text is that of its parts
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select("p_partkey", _json_text(F.col("p_name")).alias("name"))
    if audited is not None:
        li = li.join(audited.select(F.col("repo_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    j = li.join(part, li.l_partkey == part.p_partkey)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    j = j.select("*", F.row_number().over(w).alias("k"))
    pos, rid, name = F.col("k").cast("string"), F.col("l_orderkey"), F.col("name")
    broken, both, old = rid % BROKEN_EVERY == 0, rid % BOTH_EVERY == 0, rid % V6_EVERY == 0
    sev = F.element_at(F.array(*[F.lit(None if s is None else f'"severity":"{s}"') for s in SEVERITY_BY_LINE]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    title = F.concat(F.lit('"title":"Advisory for '), name, F.lit('"'))
    url = F.concat(F.lit(f'"url":"{ADVISORY_URL}'), F.col("l_partkey").cast("string"), F.lit('"'))
    via = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("[{"), title, F.lit(","), url, F.lit("}]")))
           .when(F.col("l_returnflag") == "A", F.concat(F.lit('["dep-'), F.col("l_partkey").cast("string"), F.lit('"]')))
           .otherwise(F.lit('["dep", {"severity": "low"}]')))
    v7 = F.concat(F.lit('"'), name, F.lit("#"), pos, F.lit('": {'), F.concat_ws(", ", F.replace(sev, F.lit(":"), F.lit(": ")), F.concat(F.lit('"via": '), via)), F.lit("}"))
    v6 = F.concat(F.lit('"'), pos, F.lit('": {'), F.concat_ws(",", F.concat(F.lit('"module_name":"'), name, F.lit('"')), sev, title, url), F.lit("}"))
    # a row has the JSON of its order's formats only; the document is part of the aggregate, so a filter on it doesn't build it again
    v7 = F.when(broken, F.lit(None)).when(both, v7).when(old, F.lit(None)).otherwise(v7)
    v6 = F.when(broken, F.lit(None)).when(both | old, v6)
    e = F.array_sort(F.collect_list(F.struct("k", v7.alias("v7"), v6.alias("v6"))))
    v7_doc = F.concat(F.lit('"vulnerabilities": {'), F.array_join(e["v7"], ", "), F.lit("}"))
    v6_doc = F.concat(F.lit('"advisories": {'), F.array_join(e["v6"], ", "), F.lit("}"))
    doc = (F.when(broken, F.lit("npm ERR! audit endpoint returned an error"))
           .when(both, F.concat(F.lit("{"), v6_doc, F.lit(", "), v7_doc, F.lit("}")))
           .when(old, F.concat(F.lit("{"), v6_doc, F.lit("}")))
           .otherwise(F.concat(F.lit("{"), v7_doc, F.lit("}"))))
    return j.groupBy("l_orderkey").agg(doc.alias("audit_json")).withColumnRenamed("l_orderkey", "repo_id")


def parse_audit(reports: DataFrame) -> DataFrame:
    """Valid reports only (unparsable ones are skipped, as in the reference)."""
    ok = reports.where(F.try_parse_json("audit_json").isNotNull())
    return ok.select("repo_id", F.from_json("audit_json", AUDIT_SCHEMA).alias("a"))


ENTRY_TYPE = "array<struct<name:string,severity:string,title:string,url:string,via:array<variant>>>"


def _entries(parsed: DataFrame) -> DataFrame:
    """One row per package entry of whichever format wins (v7 over v6), exploded once; what a step refers to more than once is a column of the step before."""
    v7, v6 = F.col("a.vulnerabilities"), F.col("a.advisories")
    entries = (F.when(v7.isNotNull(), F.transform(F.map_entries(v7), lambda e: F.struct(
                   e["key"].alias("name"), e["value"]["severity"].alias("severity"), F.lit(None).cast("string").alias("title"),
                   F.lit(None).cast("string").alias("url"), e["value"]["via"].alias("via"))))
               .when(v6.isNotNull(), F.transform(F.map_values(v6), lambda a: F.struct(
                   F.coalesce(a["module_name"], F.lit("")).alias("name"), a["severity"].alias("severity"), a["title"].alias("title"), a["url"].alias("url"),
                   F.lit(None).cast("array<variant>").alias("via"))))
               .otherwise(F.array().cast(ENTRY_TYPE)))
    fmt = F.when(v7.isNotNull(), F.lit("v7")).when(v6.isNotNull(), F.lit("v6"))
    e = parsed.select("repo_id", fmt.alias("format"), F.posexplode(entries).alias("pos", "e")).select("repo_id", "format", "pos", "e.*")
    adv = F.get(F.filter(F.coalesce("via", F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT")), 0)
    e = e.select("repo_id", "format", "pos", "name", "severity", "title", "url", F.when(F.col("format") == "v7", adv).alias("adv"))
    new = F.col("format") == "v7"
    e = e.select("repo_id", "format", "pos", "name", "severity", (~new | F.col("adv").isNotNull()).alias("has_advisory"),
                 *[F.when(new, F.try_variant_get("adv", f"$.{c}", "string")).otherwise(F.col(c)).alias(c) for c in ("title", "url")])
    return e.select("repo_id", "format", "pos", "name", F.coalesce(F.nullif("severity", F.lit("")), F.lit(DEFAULT_SEVERITY)).alias("severity"), "has_advisory",
                    F.coalesce(F.nullif("title", F.lit("")), F.when(new, F.col("name")).otherwise(F.lit(""))).alias("title"),
                    F.coalesce(F.nullif("url", F.lit("")), F.lit("")).alias("url"))


def audit_rollup(parsed: DataFrame) -> DataFrame:
    """Severity buckets per report (v7 wins over v6); no entries -> zeros.

    A report is one row, so the buckets are array expressions on that row:
    no shuffle and no join.
    """
    def sevs(m):
        return F.transform(F.map_values(m), lambda v: F.coalesce(F.nullif(v["severity"], F.lit("")),
                                                                 F.lit(DEFAULT_SEVERITY)))
    v7, v6 = F.col("a.vulnerabilities"), F.col("a.advisories")
    all_sev = (F.when(v7.isNotNull(), sevs(v7)).when(v6.isNotNull(), sevs(v6))
               .otherwise(F.array().cast("array<string>")))
    df = parsed.select("repo_id", all_sev.alias("sev"))

    def n(pred):
        return F.size(F.filter("sev", pred)).cast("bigint")

    def is_(b):
        return lambda x: x == b
    return df.select("repo_id", *[n(is_(b)).alias(b) for b in BUCKETS],
                     n(lambda x: ~x.isin(*BUCKETS)).alias("low"), F.size("sev").cast("bigint").alias("total"))


def audit_advisories(parsed: DataFrame) -> DataFrame:
    """Advisory rows in document order (one per package at most)."""
    e = _entries(parsed).where("has_advisory")
    return e.select("repo_id", (F.col("pos") + 1).cast("int").alias("pos"), "name", "severity", "title", "url")
