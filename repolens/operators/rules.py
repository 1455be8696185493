"""Declarative rule engine (operators G1-G17, E9).

A rule is a Column predicate over the wide repository profile plus fixed
labels. All rules of a repository are evaluated in one projection into an
array of finding structs, sorted by (severity, rule order) and exploded: no
join, no window, no Python per row. ``register_rule`` adds user rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2}
PRIORITY_ORDER = {"high": 0, "medium": 1, "low": 2}
NO_FINDINGS_TEXT = "No rule-based findings."


@dataclass
class Rule:
    rule_id: str
    category: str
    severity: str
    current: str
    suggested: str
    effort: str
    priority: str
    tags: list[str]
    when: str | Callable[[], Column]  # Spark SQL predicate (built-ins) or a Column builder
    reason: str                      # printf-style template
    benefit: str
    reason_arg: str | None = None    # profile column filling the template's %d
    evidence: list[str] | None = field(default=None)  # SQL expressions; default by category

    def reason_col(self) -> Column:
        if self.reason_arg is None:
            return F.lit(self.reason)
        return F.format_string(self.reason, F.col(self.reason_arg))


def _lst(arr: str) -> str:
    """Join labels with ', ' or say 'none detected'."""
    return f"CASE WHEN size({arr}) > 0 THEN array_join({arr}, ', ') ELSE 'none detected' END"


def _yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"


# Evidence lines per category (fixed output formats), as Spark SQL expressions.
EVIDENCE: dict[str, list[str]] = {
    "Testing": ["'Test files detected: ' || test_file_count", f"'Testing frameworks detected: ' || {_lst('testing')}"],
    "CI/CD": [f"'CI/CD configuration detected: ' || {_yes('has_ci')}"],
    "Infrastructure": [f"'Docker configuration detected: ' || {_yes('has_docker')}",
                       f"'Backend frameworks detected: ' || {_lst('backend')}"],
    "Backend Framework": [f"'Backend frameworks detected: ' || {_lst('backend')}",
                          "'API routes detected: ' || api_route_count",
                          f"'TypeScript detected: ' || {_yes('has_typescript')}"],
    "Database Access": [f"'Database and ORM libraries detected: ' || {_lst('databases')}"],
    "Styling System": [f"'Styling systems detected: ' || {_lst('styling')}",
                       "'Components detected: ' || component_count"],
    "Build Tool": [f"'Build tools detected: ' || {_lst('build_tools')}"],
    "Package Manager": ["'Package manager detected: ' || coalesce(package_manager, 'none detected')",
                        "'Development dependencies detected: ' || size(dev_dependencies)"],
    "Frontend Framework": [f"'Frontend frameworks detected: ' || {_lst('frontend')}",
                           f"'Dependencies detected: ' || {_lst('dependencies')}"],
    "Language": ["'Primary language detected: ' || language", f"'TypeScript detected: ' || {_yes('has_typescript')}",
                 "'Files detected: ' || file_count"],
}
DEFAULT_EVIDENCE = ["'Project type: ' || project_type", "'Primary language: ' || language"]


ORM_LABELS = ["Prisma ORM", "Drizzle ORM", "TypeORM", "Sequelize", "GORM", "SQLAlchemy", "Hibernate ORM"]

# Rule list in evaluation order (ids, categories, severities, labels, effort,
# priority and tags are fixed values; reason/benefit prose is our own).
RULES: list[Rule] = [
    Rule("BACKEND_001", "Backend Framework", "warning", "Express", "Fastify", "medium", "high",
         ["performance", "scalability"],
         "array_contains(backend, 'Express') AND api_route_count > 150",
         "%d API routes run on Express; a schema-driven framework serves them with less "
         "per-request overhead.",
         "Higher request throughput and validated payloads.", reason_arg="api_route_count"),
    Rule("BACKEND_002", "Backend Framework", "info", "Express", "Hono or Fastify", "medium", "medium",
         ["developer-experience", "typescript"],
         "array_contains(backend, 'Express') AND has_typescript",
         "The project is typed, but Express ships no first-class types for handlers.",
         "Typed routes and fewer runtime surprises."),
    Rule("DATABASE_001", "Database Access", "warning", "Raw SQL queries", "Prisma or Drizzle ORM", "medium", "high",
         ["security", "maintainability", "developer-experience"],
         "(array_contains(databases, 'PostgreSQL') OR array_contains(databases, 'MySQL')) AND NOT arrays_overlap("
         "databases, array(" + ", ".join(f"'{x}'" for x in ORM_LABELS) + "))",
         "A relational database is used without any ORM or query builder.",
         "Typed queries, managed migrations and parameterised SQL."),
    Rule("STYLING_001", "Styling System", "warning", "CSS Modules", "Tailwind CSS", "high", "medium",
         ["developer-experience", "performance", "maintainability"],
         "array_contains(styling, 'CSS Modules') AND component_count > 100",
         "%d components each carry their own CSS module.",
         "Shared design tokens and a smaller stylesheet.", reason_arg="component_count"),
    Rule("STYLING_002", "Styling System", "warning", "Plain CSS", "Tailwind CSS or CSS Modules", "medium", "medium",
         ["maintainability", "scalability"],
         "array_contains(styling, 'Plain CSS') AND component_count > 50",
         "%d components share global stylesheets.",
         "Scoped styles without selector clashes.", reason_arg="component_count"),
    Rule("TESTING_001", "Testing", "critical", "No test framework detected", "Vitest (frontend) + Supertest (backend)",
         "medium", "high", ["quality", "reliability"],
         "size(testing) = 0 AND test_file_count = 0",
         "Neither a test framework nor any test file was found.",
         "Regressions are caught before release."),
    Rule("TESTING_002", "Testing", "info", "Jest", "Vitest", "low", "medium",
         ["developer-experience", "performance"],
         "array_contains(testing, 'Jest') AND (array_contains(frontend, 'Next.js') OR array_contains(build_tools, 'Vite'))",
         "Jest runs beside a Vite/Next.js toolchain that has a native runner.",
         "Faster test start-up with the same API."),
    Rule("BUILD_001", "Build Tool", "warning", "Webpack", "Vite", "medium", "medium",
         ["developer-experience", "performance"],
         "array_contains(build_tools, 'Webpack') AND NOT array_contains(build_tools, 'Vite')",
         "Webpack bundles on every change during development.",
         "Quicker dev server start and hot reload."),
    Rule("PKG_001", "Package Manager", "info", "npm", "pnpm", "low", "low",
         ["developer-experience", "performance"],
         "package_manager = 'npm' AND size(dev_dependencies) > 20",
         "Many development dependencies are installed with npm.",
         "Shared package store and faster installs."),
    Rule("INFRA_001", "Infrastructure", "warning", "No Docker configuration", "Docker + Docker Compose", "low",
         "medium", ["devops", "reliability"],
         "NOT has_docker AND (size(backend) > 0 OR size(databases) > 0)",
         "Services run without a container definition.",
         "Reproducible environments from laptop to production."),
    Rule("INFRA_002", "CI/CD", "critical", "No CI/CD pipeline detected", "GitHub Actions or GitLab CI", "low", "high",
         ["devops", "quality", "reliability"],
         "NOT has_ci",
         "No continuous-integration configuration was found.",
         "Every change is built and tested automatically."),
    Rule("FRONTEND_001", "Frontend Framework", "critical", "Create React App (CRA)", "Vite + React or Next.js",
         "medium", "high", ["maintainability", "performance", "developer-experience"],
         "array_contains(frontend, 'React') AND NOT array_contains(frontend, 'Next.js') AND (array_contains(dev_dependencies, 'react-scripts') OR array_contains(dependencies, 'react-scripts'))",
         "react-scripts is unmaintained and slow to build.",
         "Maintained tooling and faster builds."),
    Rule("PYTHON_001", "Backend Framework", "info", "Flask", "FastAPI", "medium", "medium",
         ["performance", "developer-experience", "scalability"],
         "array_contains(backend, 'Flask') AND language = 'Python'",
         "Flask lacks built-in async handling and request validation.",
         "Async endpoints with generated API documentation."),
    Rule("LANG_001", "Language", "warning", "JavaScript", "TypeScript", "high", "high",
         ["quality", "maintainability", "developer-experience"],
         "language = 'JavaScript/TypeScript' AND NOT has_typescript AND file_count > 50",
         "%d files of untyped JavaScript.",
         "Type errors surface at compile time.", reason_arg="file_count"),
]


def register_rule(rule: Rule) -> None:
    """Append a user rule; it is evaluated after the built-in ones."""
    RULES.append(rule)


def _q(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _finding_sql(ordinal: int, rule: Rule) -> str:
    evidence = "array(" + ", ".join(rule.evidence or EVIDENCE.get(rule.category, DEFAULT_EVIDENCE)) + ")"
    reason = _q(rule.reason) if rule.reason_arg is None else f"format_string({_q(rule.reason)}, {rule.reason_arg})"
    tags = "array(" + ", ".join(_q(t) for t in rule.tags) + ")"
    return (f"named_struct('sev_ord', {SEVERITY_ORDER[rule.severity]}, 'rule_ord', {ordinal}, "
            f"'rule_id', {_q(rule.rule_id)}, 'category', {_q(rule.category)}, 'severity', {_q(rule.severity)}, "
            f"'current', {_q(rule.current)}, 'suggested', {_q(rule.suggested)}, 'reason', {reason}, "
            f"'benefit', {_q(rule.benefit)}, 'effort', {_q(rule.effort)}, 'priority', {_q(rule.priority)}, "
            f"'tags', {tags}, 'evidence', {evidence})")


def findings_array(rules: list[Rule] | None = None) -> Column:
    """Fired findings of one repository, sorted by severity then rule order.

    Built-in rules are one SQL expression (parsed once in the JVM); a rule
    registered with a Column predicate contributes a ``CASE`` over that Column.
    """
    rules = RULES if rules is None else rules
    parts = []
    for i, r in enumerate(rules):
        if isinstance(r.when, str):
            parts.append(F.expr(f"CASE WHEN {r.when} THEN {_finding_sql(i + 1, r)} END"))
        else:
            parts.append(F.when(r.when(), F.expr(_finding_sql(i + 1, r))))
    if all(isinstance(r.when, str) for r in rules):
        sql = ", ".join(f"CASE WHEN {r.when} THEN {_finding_sql(i + 1, r)} END" for i, r in enumerate(rules))
        return F.expr(f"array_sort(array_compact(array({sql})))")
    return F.array_sort(F.array_compact(F.array(*parts)))


def with_counts(df: DataFrame) -> DataFrame:
    """Total / critical / warning / info counts of a ``findings`` array column."""
    def sev(s):
        return F.size(F.filter("findings", lambda x: x["severity"] == s)).cast("bigint")
    return df.select("*", F.size("findings").cast("bigint").alias("total_findings"),
                     sev("critical").alias("critical_count"), sev("warning").alias("warning_count"),
                     sev("info").alias("info_count"))


def rule_results(profile: DataFrame) -> DataFrame:
    """One row per repository with the sorted finding array and the E9 counts."""
    return with_counts(profile.select("repo_id", findings_array().alias("findings")))


def rule_findings(results: DataFrame) -> DataFrame:
    """Findings exploded with their rank (1 = most severe, ties by rule order)."""
    return results.select("repo_id", F.posexplode("findings").alias("pos", "f")).select(
        "repo_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "f.rule_ord", "f.rule_id", "f.category",
        "f.severity", "f.current", "f.suggested", "f.reason", "f.benefit", "f.effort", "f.priority", "f.tags",
        "f.evidence")


def findings_text(results: DataFrame) -> DataFrame:
    """One text block per repository for downstream prompts."""
    block = F.transform("findings", lambda f: F.concat(
        F.lit("["), F.upper(f["severity"]), F.lit("] "), f["category"], F.lit(": "), f["current"], F.lit(" -> "),
        f["suggested"], F.lit("\nEvidence: "), F.array_join(f["evidence"], "; "),
        F.lit("\nReason: "), f["reason"], F.lit("\nBenefit: "), f["benefit"]))
    return results.select("repo_id", F.when(F.size("findings") == 0, F.lit(NO_FINDINGS_TEXT))
                          .otherwise(F.array_join(block, "\n\n")).alias("rule_text"))
