"""Reports, per-section top-N, comparison and report sinks.

A report is one nested row per repository assembled by joins on
``repo_id`` of already-aggregated tables (one row per repository each), so
the joins move a few columns per repository, never file contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.operators import architecture as AR

# ---------------------------------------------------------------------------
# Fixed values of the reference: section limits and compare rows.
# ---------------------------------------------------------------------------
TOP_N = {  # section -> (terminal limit, markdown limit)
    "advisories": (5, 10),
    "secrets": (10, 20),
    "complex_files": (5, 10),
}
MODES = {  # mode -> AI sections present besides the sections of every report
    "stack": [],
    "security": ["security"],
    "deployment": ["deployment"],
    "codebase": ["security", "deployment"],
}
REPORT_FOOTER = "*Generated by repolens*"
# ---------------------------------------------------------------------------


def _listed(c: str, none: str = "None") -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit(none))


def _yes(c: str) -> Column:
    return F.when(F.col(c), F.lit("Yes")).otherwise(F.lit("No"))


def compare_values() -> list[tuple[str, Column]]:
    """(attribute, value) rows of the side-by-side comparison, in display order."""
    return [
        ("Language", F.col("language")), ("Project Type", F.col("project_type")),
        ("Frontend", _listed("frontend")), ("Backend", _listed("backend")), ("Database", _listed("databases")),
        ("Styling", _listed("styling")), ("TypeScript", _yes("has_typescript")), ("Docker", _yes("has_docker")),
        ("CI/CD", _yes("has_ci")),
        ("Files", F.col("file_count").cast("string")), ("Lines of Code", F.format_number("line_count", 0)),
        ("Components", F.col("component_count").cast("string")),
        ("API Routes", F.col("api_route_count").cast("string")),
        ("Test Files", F.col("test_file_count").cast("string")),
    ]


def compare_repos(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """I4: for each (repo_a, repo_b) pair, one row per attribute with both values and a differ flag."""
    vals = profile.select("repo_id", F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("attribute"),
                                                        v.alias("value"))
                                               for i, (a, v) in enumerate(compare_values())]).alias("vals"))
    a = vals.select(F.col("repo_id").alias("repo_a"), F.col("vals").alias("va"))
    b = vals.select(F.col("repo_id").alias("repo_b"), F.col("vals").alias("vb"))
    j = pairs.join(a, "repo_a").join(b, "repo_b")
    z = j.select("repo_a", "repo_b", F.explode(F.arrays_zip("va", "vb")).alias("z"))
    return z.select("repo_a", "repo_b", F.col("z.va.ord").alias("ord"), F.col("z.va.attribute").alias("attribute"),
                    F.col("z.va.value").alias("value_a"), F.col("z.vb.value").alias("value_b"),
                    (F.col("z.va.value") != F.col("z.vb.value")).alias("differs"))


def adjacent_pairs(repo_ids: DataFrame) -> DataFrame:
    """Pairs (r, r + 1) for even r - a pairs table derived from the corpus."""
    r = repo_ids.select("repo_id")
    return r.where(F.col("repo_id") % 2 == 0).select(F.col("repo_id").alias("repo_a"),
                                                     (F.col("repo_id") + 1).alias("repo_b")) \
        .join(r.select(F.col("repo_id").alias("repo_b")), "repo_b", "left_semi")


def top_n(items: DataFrame, key: str, order: list, n: int, section: str, label: Column) -> DataFrame:
    """First ``n`` items per key and the overflow count ("... and k more")."""
    whole = Window.partitionBy(key)
    ranked = items.select(key, label.alias("item"), F.row_number().over(whole.orderBy(*order)).alias("rank"),
                          F.count(F.lit(1)).over(whole).alias("n"))  # one pass over the items for rank and total
    return ranked.where(F.col("rank") <= n).select(
        F.lit(section).alias("section"), F.col(key).cast("bigint").alias("repo_id"),
        F.col("rank").cast("bigint").alias("rank"), "item",
        F.greatest(F.col("n") - n, F.lit(0)).cast("bigint").alias("overflow"))


def report_top_n(secrets: DataFrame, complex_files: DataFrame, advisories: DataFrame, markdown: bool = True) -> DataFrame:
    k = 1 if markdown else 0
    s = top_n(secrets, "repo_id", ["path", "line", "pattern_ord"], TOP_N["secrets"][k], "secrets",
              F.format_string("%s (%s) %s:%d %s", "type", "severity", "path", "line", "match"))
    c = top_n(complex_files, "repo_id", [F.col("complexity").desc(), "path"], TOP_N["complex_files"][k],
              "complex_files", F.format_string("%s complexity: %d", "path", "complexity"))
    a = top_n(advisories, "repo_id", ["pos"], TOP_N["advisories"][k], "advisories",
              F.concat("name", F.lit(" ("), "severity", F.lit("): "), "title"))  # none is null; cheaper than a format
    return s.unionByName(c).unionByName(a)


def report_parts(files_by_ext: DataFrame, audit: DataFrame, advisories: DataFrame, secrets: DataFrame, scanned: DataFrame,
                 complex_files: DataFrame) -> DataFrame:
    """Per repository the list-valued statistics of a report: one row each, lists in their order of display."""
    def listed(df, order, *fields):
        rows = df.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *fields))).alias("l"))
        return rows.select("repo_id", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("l"))

    adv = listed(advisories, ["pos"], "name", "severity", "title", "url").withColumnRenamed("l", "advisories")
    found = listed(secrets, ["path", "line", "pattern_ord"], "type", "severity", "path", "line", "match").withColumnRenamed("l", "secret_findings")
    top = listed(complex_files, ["rank"], "path", "complexity").withColumnRenamed("l", "high_complexity_files")
    vulns = audit.join(adv, "repo_id", "left").select("repo_id", F.struct(
        "critical", "high", "moderate", "low", "total", F.coalesce("advisories", F.array().cast(adv.schema["advisories"].dataType)).alias("advisories"))
        .alias("vulnerabilities"))
    return (files_by_ext.join(vulns, "repo_id", "full").join(scanned, "repo_id", "full").join(found, "repo_id", "full")
            .join(top, "repo_id", "full"))


def repo_report(profile: DataFrame, parts: DataFrame, rule_results: DataFrame, merged: DataFrame, ai: dict[str, DataFrame],
                analyzed_at: str) -> DataFrame:
    """One nested record per repository and scan with every section; ``merged`` has a row for each, ``ai`` (repo_id, scan_id, reasoning / security / deployment).

    ``for_mode`` (I2) takes the sections of a mode from it.
    """
    arch = AR.architecture_columns()
    def empty(name):
        return F.coalesce(F.col(name), F.array().cast(parts.schema[name].dataType))
    base = profile.join(parts, "repo_id", "left").select(
        "repo_id", F.lit(analyzed_at).alias("analyzed_at"),
        F.struct("language", "project_type", "frontend", "backend", "databases", "styling", "testing", "build_tools",
                 "package_manager", "dependencies", "dev_dependencies", "has_docker", "has_ci", "has_typescript").alias("stack"),
        F.struct("file_count", "component_count", "api_route_count", "line_count", "test_file_count", "config_file_count",
                 "files_by_extension", "vulnerabilities",
                 F.struct(empty("secret_findings").alias("findings"), F.coalesce("files_scanned", F.lit(0)).alias("files_scanned")).alias("secrets"),
                 F.struct("average_complexity", "max_complexity", "total_functions", "lines_per_function", "duplication_risk",
                          "test_files_excluded", empty("high_complexity_files").alias("high_complexity_files")).alias("complexity")).alias("stats"),
        F.struct(*[c.alias(n) for n, c in arch.items()]).alias("architecture"))
    base = base.join(rule_results.select("repo_id", F.struct("findings", "total_findings", "critical_count", "warning_count",
                                                               "info_count").alias("rules")), "repo_id", "left")
    base = base.join(merged.select("repo_id", "scan_id", "merged"), "repo_id", "left")
    for name in ("reasoning", "security", "deployment"):
        base = base.join(ai[name].select("repo_id", "scan_id", name), ["repo_id", "scan_id"], "left")
    return base


def for_mode(report: DataFrame, mode: str | Column) -> DataFrame:
    """The report with the AI sections of its mode (a name or a column of names); others are null."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    shown = [F.when(mode.isin([m for m, has in MODES.items() if name in has]), F.col(name)).alias(name) for name in ("security", "deployment")]
    return report.select(*[c for c in report.columns if c not in ("security", "deployment", "mode")], *shown, mode.alias("mode"))


def all_modes(report: DataFrame) -> DataFrame:
    """Every repository's report in every mode, from one pass over the reports."""
    rows = report.select("*", F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    return for_mode(rows, F.col("mode"))


def report_json(report: DataFrame) -> DataFrame:
    """A5: the report document as indented JSON text (one per repository and scan)."""
    keys = [c for c in ("repo_id", "scan_id", "mode") if c in report.columns]
    return report.select(*keys, F.to_json(F.struct(*[c for c in report.columns]), {"pretty": "true"}).alias("report_json"))


def write_report_json(report: DataFrame, path: str, buckets: int = 64) -> None:
    """A5 sink: JSON lines, partitioned by a repository bucket (not one folder per repository)."""
    report_json(report).select((F.col("repo_id") % buckets).alias("repo_bucket"), "repo_id", "report_json") \
        .write.mode("overwrite").partitionBy("repo_bucket").json(path)


def js_number(c: Column) -> Column:
    """A number as JavaScript prints it: whole numbers without a point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


# ---------------------------------------------------------------------------
# Fixed values of the reference: headings and labels of the Markdown report.
# ---------------------------------------------------------------------------
STACK_ROWS = [("Frontend", "frontend"), ("Backend", "backend"), ("Database", "databases"), ("Styling", "styling"), ("Testing", "testing")]
SEVERITY_ROWS = [("Critical", "critical"), ("High", "high"), ("Moderate", "moderate"), ("Low", "low")]
SCORE_ROWS = [("Overall", "overall"), ("Performance", "performance"), ("Developer Experience", "developerExperience"),
              ("Maintainability", "maintainability"), ("Scalability", "scalability")]
FINDING_LINES = [("Severity", "severity"), ("Category", "category"), ("Effort", "effort")]
FINDING_TEXTS = [("Description", "description"), ("Recommendation", "recommendation"), ("References", "references")]
RECOMMENDATION_LINES = [("Priority", "priority"), ("Category", "category"), ("Effort", "effort")]
RECOMMENDATION_TEXTS = [("Description", "description"), ("Implementation", "implementation"), ("Impact", "impact")]
# ---------------------------------------------------------------------------


def _lines(*lines) -> Column:
    """Lines joined; null lines are left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _row(*cells) -> Column:
    return F.concat(F.lit("| "), *[x for i, c in enumerate(cells) for x in ((F.lit(" | "),) if i else ()) + (F.lit(c) if isinstance(c, str) else c.cast("string"),)],
                    F.lit(" |"))


def _each(items: Column, line) -> Column:
    """A line for every item; null when there are none."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n"))


def _ai_section(title: str, record: str, items: str, heads, bodies) -> Column:
    """A scored AI section: summary, numbered items, strengths; null without a record."""
    r = F.col(record)

    def item(x, i):
        *always, last = bodies
        return _lines(F.format_string("### %d. %s", i + 1, x["title"]), "", *[F.concat(F.lit(f"- **{n}:** "), x[f]) for n, f in heads], "",
                      F.concat(F.lit(f"**{always[0][0]}:** "), x[always[0][1]]), "", F.concat(F.lit(f"**{always[1][0]}:** "), x[always[1][1]]),
                      F.when(x[last[1]] != "", F.concat(F.lit(f"\n**{last[0]}:** "), x[last[1]])), "")
    numbered = F.when(F.size(r[items]) > 0, F.array_join(F.transform(r[items], item), "\n"))
    strengths = F.when(F.size(r["strengths"]) > 0, _lines(f"### {title} Strengths", "", _each(r["strengths"], lambda s: F.concat(F.lit("- "), s)), ""))
    return F.when(r.isNotNull(), _lines(f"## {title} Analysis", "", F.format_string(f"**{title} Score:** %.1f/10", r["score"]), "",
                                        F.when(r["summary"] != "", F.concat(r["summary"], F.lit("\n"))), numbered, strengths))


def report_markdown(report: DataFrame) -> DataFrame:
    """Sectioned Markdown of each report; optional rows and sections are left out when empty."""
    stack, stats, cx = F.col("stack"), F.col("stats"), F.col("stats.complexity")
    vulns, secrets, top = F.col("stats.vulnerabilities"), F.col("stats.secrets.findings"), F.col("stats.complexity.high_complexity_files")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    detected = _lines("## Detected Stack", "", _row("Property", "Value"), "|---|---|", _row("Language", stack["language"]),
                      _row("Project Type", stack["project_type"]),
                      *[F.when(F.size(stack[f]) > 0, _row(n, F.array_join(stack[f], ", "))) for n, f in STACK_ROWS],
                      _row("Architecture", F.array_join("architecture.patterns", ", ")), _row("Docker", yes(stack["has_docker"])),
                      _row("CI/CD", yes(stack["has_ci"])), "")
    counts = _lines("## Repository Stats", "", _row("Metric", "Value"), "|---|---|", _row("Files", stats["file_count"]),
                    _row("Lines of Code", F.format_number(stats["line_count"], 0)), _row("Components", stats["component_count"]),
                    _row("API Routes", stats["api_route_count"]), _row("Test Files", stats["test_file_count"]), "")
    adv = _each(F.slice(vulns["advisories"], 1, TOP_N["advisories"][1]), lambda x: F.format_string("- **%s** (%s): %s", x["name"], x["severity"], x["title"]))
    vuln = F.when(vulns["total"] > 0, _lines(
        "## Dependency Vulnerabilities", "", _row("Severity", "Count"), "|---|---|",
        *[F.when(vulns[f] > 0, _row(n, vulns[f])) for n, f in SEVERITY_ROWS], "", F.concat(adv, F.lit("\n"))))
    most = TOP_N["secrets"][1]
    secret = F.when(F.size(secrets) > 0, _lines(
        "## Secrets Found", "", F.format_string("> %d potential secret(s) detected", F.size(secrets)), "",
        _each(F.slice(secrets, 1, most), lambda x: F.format_string("- **%s** (%s) — `%s:%d` — %s", x["type"], x["severity"], x["path"], x["line"], x["match"])),
        F.when(F.size(secrets) > most, F.format_string("- ... and %d more", F.size(secrets) - most)), ""))
    complexity = _lines(
        "## Code Complexity", "", _row("Metric", "Value"), "|---|---|", _row("Average Complexity", js_number(cx["average_complexity"])),
        _row("Max Complexity", cx["max_complexity"]), _row("Total Functions", cx["total_functions"]),
        _row("Avg Lines/Function", F.when(cx["lines_per_function"] > 0, js_number(cx["lines_per_function"])).otherwise("N/A")),
        _row("Duplication Risk", cx["duplication_risk"]),
        F.when(cx["test_files_excluded"] > 0, F.format_string("\n> Note: %d test file(s) excluded from complexity metrics.", cx["test_files_excluded"])),
        F.when(F.size(top) > 0, _lines("", "**High complexity files:**", _each(
            F.slice(top, 1, TOP_N["complex_files"][1]), lambda x: F.format_string("- `%s` — complexity: %d", x["path"], x["complexity"])))), "")
    now, then = F.col("reasoning.scores.current"), F.col("reasoning.scores.optimized")
    out_of = lambda c: F.concat(js_number(c), F.lit("/10"))
    scores = F.when(F.col("reasoning").isNotNull(), _lines(
        "## Stack Scores", "", _row("Dimension", "Current", "Optimized"), "|---|---|---|", *[_row(n, out_of(now[f]), out_of(then[f])) for n, f in SCORE_ROWS], ""))

    def item(x, i):
        return _lines(F.format_string("### %d. %s", i + 1, x["category"]), "",
                      *[F.concat(F.lit(f"- **{n}:** "), x[n.lower()]) for n in ("Current", "Suggested", "Priority", "Effort", "Source")],
                      F.when(F.size(F.coalesce(x["evidence"], F.array().cast("array<string>"))) > 0, F.concat(F.lit("- **Evidence:** "), F.array_join(x["evidence"], "; "))),
                      "", F.concat(F.lit("**Reason:** "), x["reason"]), "", F.concat(F.lit("**Benefit:** "), x["benefit"]),
                      F.when(F.coalesce(x["tradeoffs"], F.lit("")) != "", F.concat(F.lit("\n**Tradeoffs:** "), x["tradeoffs"])),
                      F.when(F.coalesce(x["migrationNotes"], F.lit("")) != "", F.concat(F.lit("\n**Getting started:** "), x["migrationNotes"])), "")
    merged = F.when(F.size("merged") > 0, _lines("## Suggested Improvements", "", F.array_join(F.transform("merged", item), "\n")))
    summary = F.when(F.col("reasoning.summary") != "", _lines("## AI Analysis Summary", "", F.col("reasoning.summary"), ""))
    doc = _lines(F.format_string("# Repository Report — %s", F.col("repo_id").cast("string")), F.concat(F.lit("> Generated at "), F.col("analyzed_at")), "",
                 detected, counts, vuln, secret, complexity, scores, merged, summary,
                 _ai_section("Security", "security", "findings", FINDING_LINES, FINDING_TEXTS),
                 _ai_section("Deployment", "deployment", "recommendations", RECOMMENDATION_LINES, RECOMMENDATION_TEXTS), "---", REPORT_FOOTER)
    return report.select("repo_id", "scan_id", doc.alias("markdown"))


def write_report_markdown(md: DataFrame, path: str, buckets: int = 64) -> None:
    """A6 sink: Markdown documents as text lines, partitioned by repository bucket."""
    md.select((F.col("repo_id") % buckets).alias("repo_bucket"),
              F.concat(F.lit("<!-- repo "), F.col("repo_id").cast("string"), F.lit(" -->\n"), F.col("markdown"))
              .alias("value")).write.mode("overwrite").partitionBy("repo_bucket").text(path)
