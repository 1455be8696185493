"""DuckDB spelling of the profile, architecture and rule findings (F*, G*, E9)."""

from __future__ import annotations

from repolens.functions.text import sql_str
from repolens.operators import architecture as A
from repolens.operators import rules as R
from repolens.oracle import fragments as O
from repolens.oracle import stack_sql as OS


def profile_ctes() -> str:
    return f"""{O.file_facts_cte()}, {O.repo_stats_cte()}, {O.complexity_cte()},
{OS.markers_cte()}, {OS.stack_cte()},
profile AS (
  SELECT s.*, t.file_count, t.component_count, t.api_route_count, t.line_count, t.test_file_count,
         t.config_file_count, c.average_complexity, c.max_complexity, c.total_functions, c.lines_per_function,
         c.duplication_risk, c.test_files_excluded
  FROM stack s JOIN repo_stats t ON s.repo_id = t.repo_id JOIN repo_complexity c ON s.repo_id = c.repo_id)"""


def _list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]::VARCHAR[]"


def architecture_cte() -> str:
    scal_sql = {
        "Docker containerization": "has_docker", "Monorepo structure": "has_monorepo_setup",
        "Redis caching layer": "list_contains(databases, 'Redis')",
        "Serverless deployment": "has_serverless_config",
        "Modular NestJS architecture": "list_contains(backend, 'NestJS')",
        "Turborepo build caching": "list_contains(build_tools, 'Turborepo')",
    }
    scal = ", ".join(f"CASE WHEN {scal_sql[label]} THEN {sql_str(label)} END" for label, _ in A.SCALABILITY)
    return f"""arch0 AS (
  SELECT *, list_filter([
      CASE WHEN has_monorepo_setup THEN 'Monorepo' END,
      CASE WHEN has_serverless_config THEN 'Serverless' END,
      CASE WHEN list_has_any(frontend, {_list(A.SSR_FRAMEWORKS)}) THEN 'Full-Stack SSR'
           WHEN len(frontend) > 0 AND len(backend) = 0 THEN CASE WHEN has_serverless_config THEN 'JAMstack' ELSE 'SPA' END
           WHEN len(frontend) = 0 AND len(backend) > 0 THEN 'API-First'
           WHEN len(frontend) > 0 AND len(backend) > 0 THEN
                CASE WHEN has_src_modules THEN 'Clean Architecture' ELSE 'Monolith' END END]::VARCHAR[],
      lambda x: x IS NOT NULL) AS found
  FROM profile),
architecture AS (
  SELECT repo_id,
    CASE WHEN len(found) > 0 THEN found
         ELSE [CASE WHEN language IN ('Go', 'Rust') THEN 'CLI Tool' ELSE 'Library/Package' END] END AS patterns,
    has_monorepo_setup, has_serverless_config, api_route_count > 0 AS has_api_layer,
    len(frontend) > 0 AS has_frontend_layer, len(backend) > 0 AS has_backend_layer,
    len(databases) > 0 AS has_database_layer,
    CAST((len(frontend) > 0)::INT + (len(backend) > 0)::INT + (len(databases) > 0)::INT AS BIGINT) AS layer_count,
    list_filter([{scal}]::VARCHAR[], lambda x: x IS NOT NULL) AS scalability_signals,
    list_filter([
      CASE WHEN file_count > {A.LARGE_CODEBASE_FILES} THEN printf('Large codebase (%d files)', file_count) END,
      CASE WHEN api_route_count > {A.HIGH_API_ROUTES} THEN printf('High API surface (%d routes)', api_route_count) END,
      CASE WHEN len(dependencies) > {A.MANY_DEPENDENCIES} THEN printf('Many dependencies (%d)', len(dependencies)) END,
      CASE WHEN test_file_count = 0 THEN 'No test coverage detected' END,
      CASE WHEN NOT has_ci THEN 'No CI/CD pipeline' END]::VARCHAR[], lambda x: x IS NOT NULL) AS complexity_signals,
    language, line_count
  FROM arch0),
architecture_flat AS (
  SELECT repo_id, array_to_string(patterns, ', ') AS patterns, has_monorepo_setup, has_serverless_config,
    has_api_layer, has_frontend_layer, has_backend_layer, has_database_layer, layer_count,
    array_to_string(scalability_signals, '; ') AS scalability_signals,
    array_to_string(complexity_signals, '; ') AS complexity_signals,
    concat_ws(', ', array_to_string(patterns, ' + '),
              CASE WHEN language <> 'Unknown' THEN 'written in ' || language END,
              CASE WHEN line_count > 0 THEN 'with ~' || format('{{:,}}', line_count) || ' lines of code' END)
      AS description
  FROM architecture)"""


def _lst(arr: str) -> str:
    return f"CASE WHEN len({arr}) > 0 THEN array_to_string({arr}, ', ') ELSE 'none detected' END"


def _yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"


EVIDENCE_SQL = {
    "Testing": [f"'Test files detected: ' || test_file_count", f"'Testing frameworks detected: ' || {_lst('testing')}"],
    "CI/CD": [f"'CI/CD configuration detected: ' || {_yes('has_ci')}"],
    "Infrastructure": [f"'Docker configuration detected: ' || {_yes('has_docker')}",
                       f"'Backend frameworks detected: ' || {_lst('backend')}"],
    "Backend Framework": [f"'Backend frameworks detected: ' || {_lst('backend')}",
                          "'API routes detected: ' || api_route_count",
                          f"'TypeScript detected: ' || {_yes('has_typescript')}"],
    "Database Access": [f"'Database and ORM libraries detected: ' || {_lst('databases')}"],
    "Styling System": [f"'Styling systems detected: ' || {_lst('styling')}", "'Components detected: ' || component_count"],
    "Build Tool": [f"'Build tools detected: ' || {_lst('build_tools')}"],
    "Package Manager": ["'Package manager detected: ' || coalesce(package_manager, 'none detected')",
                        "'Development dependencies detected: ' || len(dev_dependencies)"],
    "Frontend Framework": [f"'Frontend frameworks detected: ' || {_lst('frontend')}",
                           f"'Dependencies detected: ' || {_lst('dependencies')}"],
    "Language": ["'Primary language detected: ' || language", f"'TypeScript detected: ' || {_yes('has_typescript')}",
                 "'Files detected: ' || file_count"],
}

ORMS = _list(R.ORM_LABELS)
RULE_SQL = {
    "BACKEND_001": "list_contains(backend, 'Express') AND api_route_count > 150",
    "BACKEND_002": "list_contains(backend, 'Express') AND has_typescript",
    "DATABASE_001": f"(list_contains(databases, 'PostgreSQL') OR list_contains(databases, 'MySQL')) "
                    f"AND NOT list_has_any(databases, {ORMS})",
    "STYLING_001": "list_contains(styling, 'CSS Modules') AND component_count > 100",
    "STYLING_002": "list_contains(styling, 'Plain CSS') AND component_count > 50",
    "TESTING_001": "len(testing) = 0 AND test_file_count = 0",
    "TESTING_002": "list_contains(testing, 'Jest') AND (list_contains(frontend, 'Next.js') "
                   "OR list_contains(build_tools, 'Vite'))",
    "BUILD_001": "list_contains(build_tools, 'Webpack') AND NOT list_contains(build_tools, 'Vite')",
    "PKG_001": "package_manager = 'npm' AND len(dev_dependencies) > 20",
    "INFRA_001": "NOT has_docker AND (len(backend) > 0 OR len(databases) > 0)",
    "INFRA_002": "NOT has_ci",
    "FRONTEND_001": "list_contains(frontend, 'React') AND NOT list_contains(frontend, 'Next.js') AND "
                    "(list_contains(dev_dependencies, 'react-scripts') OR list_contains(dependencies, 'react-scripts'))",
    "PYTHON_001": "list_contains(backend, 'Flask') AND language = 'Python'",
    "LANG_001": "language = 'JavaScript/TypeScript' AND NOT has_typescript AND file_count > 50",
}


def findings_cte() -> str:
    parts = []
    for i, r in enumerate(R.RULES[:len(RULE_SQL)]):
        reason = sql_str(r.reason) if r.reason_arg is None else f"printf({sql_str(r.reason)}, {r.reason_arg})"
        ev = EVIDENCE_SQL.get(r.category, ["'Project type: ' || project_type", "'Primary language: ' || language"])
        parts.append(
            f"SELECT repo_id, {R.SEVERITY_ORDER[r.severity]} AS sev_ord, {i + 1} AS rule_ord, "
            f"{sql_str(r.rule_id)} AS rule_id, {sql_str(r.category)} AS category, {sql_str(r.severity)} AS severity, "
            f"{sql_str(r.current)} AS current, {sql_str(r.suggested)} AS suggested, {reason} AS reason, "
            f"{sql_str(r.benefit)} AS benefit, {sql_str(r.effort)} AS effort, {sql_str(r.priority)} AS priority, "
            f"{sql_str(','.join(r.tags))} AS tags, concat_ws('; ', {', '.join(ev)}) AS evidence "
            f"FROM profile WHERE {RULE_SQL[r.rule_id]}")
    union = "\nUNION ALL\n".join(parts)
    return f"""findings0 AS (
{union}),
findings AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY sev_ord, rule_ord) AS BIGINT) AS rank
  FROM findings0)"""
