"""DuckDB spelling of the stack record (oracle for D1-D18, F1-F5)."""

from __future__ import annotations

from repolens.functions.text import sql_str
from repolens.operators import stack as S


def _list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]::VARCHAR[]"


def _catalog(facet: str) -> str:
    items = []
    for label, any_scope, dev_scope in S.NODE_CATALOG[facet]:
        conds = []
        if any_scope:
            conds.append(f"list_has_any(all_deps, {_list(any_scope)})")
        if dev_scope:
            conds.append(f"list_has_any(dev_dependencies, {_list(dev_scope)})")
        cond = " OR ".join(conds)
        if label == "React":
            cond = f"({cond}) AND NOT list_contains(all_deps, {sql_str(S.REACT_SUPPRESSED_BY)})"
        items.append(f"CASE WHEN {cond} THEN {sql_str(label)} END")
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def _needles(manifest: str, facet: str, text: str) -> str:
    items = []
    for m, f, label, needles in S.NEEDLES:
        if m == manifest and f == facet:
            cond = " OR ".join(f"contains({text}, {sql_str(n)})" for n in needles)
            items.append(f"CASE WHEN {cond} THEN {sql_str(label)} END")
    if not items:
        return "[]::VARCHAR[]"
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def _m(name: str) -> str:
    return S.marker_col(name)


def markers_cte() -> str:
    parts = [f"bool_or(path = {sql_str(m)}) AS {_m(m)}" for m in S.MARKER_FILES]
    parts += [f"bool_or(starts_with(path, {sql_str(d + '/')})) AS {S.dir_col(d)}" for d in S.MARKER_DIRS]
    parts += [f"max(CASE WHEN path = {sql_str(m)} THEN content END) AS {S.manifest_col(m)}" for m in S.MANIFESTS]
    parts.append("bool_or(css_module) AS has_css_modules")
    return ("markers AS (SELECT f.repo_id, " + ",\n  ".join(parts)
            + "\nFROM ff0 f GROUP BY f.repo_id)")


def stack_cte() -> str:
    raw_pkg = S.manifest_col("package.json")
    pkg = "pkgj"
    req = f"lower(coalesce({S.manifest_col('requirements.txt')}, ''))"
    go = f"coalesce({S.manifest_col('go.mod')}, '')"
    cargo = f"coalesce({S.manifest_col('Cargo.toml')}, '')"
    pom = f"coalesce({S.manifest_col('pom.xml')}, '')"
    py = f"({_m('requirements.txt')} OR {_m('pyproject.toml')})"
    facets = []
    for facet in S.FACETS:
        parts = [f"CASE WHEN node THEN {_catalog(facet)} ELSE []::VARCHAR[] END",
                 f"CASE WHEN {_m('requirements.txt')} THEN {_needles('requirements.txt', facet, req)} ELSE []::VARCHAR[] END",
                 f"CASE WHEN {_m('go.mod')} THEN {_needles('go.mod', facet, go)} ELSE []::VARCHAR[] END",
                 f"CASE WHEN {_m('Cargo.toml')} THEN {_needles('Cargo.toml', facet, cargo)} ELSE []::VARCHAR[] END",
                 f"CASE WHEN {_m('pom.xml')} THEN {_needles('pom.xml', facet, pom)} ELSE []::VARCHAR[] END"]
        expr = "list_concat(" + ", ".join(parts) + ")"
        facets.append((facet, expr))
    facet_sql = ",\n  ".join(f"{e} AS {f}_raw" for f, e in facets)
    pm = "NULL"
    for marker, label in reversed(S.LOCKFILES):
        pm = f"CASE WHEN {_m(marker)} THEN {sql_str(label)} ELSE {pm} END"
    vscode = " OR ".join([f"list_has_any(all_deps, {_list(S.VSCODE_DEPS)})",
                          "coalesce(json_type(" + pkg + ", '$.engines.vscode') = 'VARCHAR', FALSE)"])
    bin_t = f"json_type({pkg}, '$.bin')"
    bin_truthy = (f"CASE WHEN {bin_t} = 'VARCHAR' THEN json_extract_string({pkg}, '$.bin') <> '' "
                  f"WHEN {bin_t} = 'BOOLEAN' THEN json_extract_string({pkg}, '$.bin') = 'true' "
                  f"WHEN {bin_t} IN ('OBJECT', 'ARRAY') THEN TRUE "
                  f"WHEN {bin_t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string({pkg}, '$.bin') AS DOUBLE) <> 0 "
                  f"ELSE FALSE END")
    mani = S.manifest_col("manifest.json")
    browser = (f"({_m('manifest.json')} AND coalesce(json_type(CASE WHEN json_valid({mani}) THEN {mani} END, "
               f"'$.manifest_version') IN ('BIGINT', 'UBIGINT', 'DOUBLE'), FALSE))")
    specialized = (f"CASE WHEN {vscode} THEN 'VS Code Extension' "
                   f"WHEN {_m('action.yml')} OR {_m('action.yaml')} THEN 'GitHub Action' "
                   f"WHEN {_m('wrangler.toml')} OR list_has_any(all_deps, {_list(S.WORKER_DEPS)}) THEN 'Cloudflare Worker' "
                   f"WHEN {browser} THEN 'Browser Extension' "
                   f"WHEN ({bin_truthy}) AND NOT list_has_any(all_deps, {_list(S.CLI_EXCLUDED_FRONTEND)}) "
                   f"AND NOT list_has_any(all_deps, {_list(S.CLI_EXCLUDED_BACKEND)}) THEN 'CLI Tool' END")
    nf, nb = _catalog("frontend"), _catalog("backend")
    inferred = (f"CASE WHEN list_contains({nf}, 'Next.js') THEN 'Full-Stack Web App (Next.js)' "
                f"WHEN len({nf}) > 0 AND len({nb}) > 0 THEN 'Full-Stack Web App' "
                f"WHEN len({nf}) > 0 THEN 'Frontend Web App' WHEN len({nb}) > 0 THEN 'Backend API' "
                f"ELSE 'Node.js Application' END")
    py_backend = (f"list_concat(CASE WHEN node THEN {nb} ELSE []::VARCHAR[] END, "
                  f"CASE WHEN {_m('requirements.txt')} THEN {_needles('requirements.txt', 'backend', req)} "
                  f"ELSE []::VARCHAR[] END)")
    has_ts = f"(node AND (list_contains(all_deps, 'typescript') OR {_m('tsconfig.json')}))"
    docker = " OR ".join(_m(m) for m in S.DOCKER_FILES)
    ci = f"{S.dir_col('.github/workflows')} OR {_m('.github/workflows')} OR {_m('.gitlab-ci.yml')} OR {_m('Jenkinsfile')}"
    mono = " OR ".join([_m(m) for m in S.MONOREPO_FILES] + [S.dir_col(d) for d in S.MONOREPO_DIRS])
    srv = " OR ".join(_m(m) for m in S.SERVERLESS_FILES)
    return f"""node0 AS (
  SELECT *, ({raw_pkg} IS NOT NULL AND json_valid({raw_pkg})) AS node_parsed,
         ({raw_pkg} IS NOT NULL AND json_valid({raw_pkg}) AND json_type(CASE WHEN json_valid({raw_pkg}) THEN {raw_pkg} END) <> 'NULL') AS node,
         CASE WHEN json_valid({raw_pkg}) THEN {raw_pkg} END AS pkgj
  FROM markers),
node1 AS (
  SELECT *,
    CASE WHEN node THEN coalesce(json_keys({pkg}, '$.dependencies'), []::VARCHAR[]) ELSE []::VARCHAR[] END AS dependencies,
    CASE WHEN node THEN coalesce(json_keys({pkg}, '$.devDependencies'), []::VARCHAR[]) ELSE []::VARCHAR[] END AS dev_dependencies
  FROM node0),
node2 AS (SELECT *, list_concat(dependencies, dev_dependencies) AS all_deps FROM node1),
stack0 AS (
  SELECT *, {facet_sql},
    {has_ts} AS has_typescript,
    CASE WHEN node THEN {pm} END AS package_manager,
    CASE WHEN node THEN coalesce({specialized}, {inferred}) END AS node_type,
    len({py_backend}) > 0 AS py_has_backend
  FROM node2),
stack AS (
  SELECT repo_id,
    CASE WHEN {_m('pom.xml')} THEN 'Java' WHEN {_m('Cargo.toml')} THEN 'Rust' WHEN {_m('go.mod')} THEN 'Go'
         WHEN {py} THEN 'Python' WHEN has_typescript THEN 'TypeScript'
         WHEN node_parsed THEN 'JavaScript/TypeScript' ELSE 'Unknown' END AS language,
    CASE WHEN {_m('pom.xml')} THEN 'Java Application' WHEN {_m('Cargo.toml')} THEN 'Rust Application'
         WHEN {_m('go.mod')} THEN 'Go Application'
         WHEN {py} THEN CASE WHEN py_has_backend THEN 'Python Web App' ELSE 'Python Application' END
         WHEN node THEN node_type ELSE 'Unknown' END AS project_type,
    frontend_raw AS frontend, backend_raw AS backend, databases_raw AS databases,
    CASE WHEN node AND len(styling_raw) = 0 THEN
         [CASE WHEN has_css_modules THEN 'CSS Modules' ELSE 'Plain CSS' END]
         ELSE styling_raw END AS styling,
    testing_raw AS testing, build_tools_raw AS build_tools, package_manager,
    dependencies, dev_dependencies,
    ({docker}) AS has_docker, ({ci}) AS has_ci, has_typescript,
    ({mono}) AS has_monorepo_setup, ({srv}) AS has_serverless_config,
    ({S.dir_col('src')} AND {S.dir_col('src/modules')}) AS has_src_modules
  FROM stack0)"""


def flat_stack_select() -> str:
    facets = ", ".join(f"array_to_string({f}, ', ') AS {f}" for f in S.FACETS)
    return (f"SELECT repo_id, language, project_type, {facets}, package_manager, "
            f"array_to_string(dependencies, ' ') AS dependencies, "
            f"array_to_string(dev_dependencies, ' ') AS dev_dependencies, has_docker, has_ci, has_typescript "
            f"FROM stack")
