"""Technology-stack detection (operators B8, B9, D1-D18).

One aggregation per repository gathers the root markers (from the unpruned
listing, so hidden names such as ``.github/workflows`` are visible) and the
root manifest texts; everything after that is a narrow projection of that one
row. Dictionary lookups are ``filter`` over fixed literal arrays, so no join
and no Python runs per row, and the per-repo arrays are bounded by the size of
the dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, dependency names,
# substring needles, marker file names), in the reference's push order.
# ---------------------------------------------------------------------------
# Node dependency catalog: facet -> [(label, deps in any scope, deps in dev scope only)]
NODE_CATALOG = {
    "frontend": [("Next.js", ["next"], []), ("React", ["react"], []), ("Vue", ["vue"], []),
                 ("Angular", ["@angular/core"], []), ("Svelte", ["svelte"], []),
                 ("SolidJS", ["solid-js"], []), ("Remix", ["remix"], []), ("Gatsby", ["gatsby"], [])],
    "backend": [("Express", ["express"], []), ("Fastify", ["fastify"], []), ("NestJS", ["@nestjs/core"], []),
                ("Koa", ["koa"], []), ("Hono", ["hono"], []), ("tRPC", ["@trpc/server"], [])],
    "databases": [("MongoDB", ["mongoose", "mongodb"], []),
                  ("PostgreSQL", ["pg", "postgres", "@neondatabase/serverless"], []),
                  ("MySQL", ["mysql", "mysql2"], []), ("Redis", ["ioredis", "redis"], []),
                  ("SQLite", ["better-sqlite3", "@libsql/client"], []),
                  ("Prisma ORM", ["@prisma/client"], ["prisma"]), ("Drizzle ORM", ["drizzle-orm"], []),
                  ("TypeORM", ["typeorm"], []), ("Sequelize", ["sequelize"], [])],
    "styling": [("Tailwind CSS", ["tailwindcss"], []), ("Styled Components", ["styled-components"], []),
                ("Emotion", ["@emotion/react"], []), ("SASS", ["sass", "node-sass"], []),
                ("Stitches", ["@stitches/react"], [])],
    "testing": [("Jest", ["jest"], []), ("Vitest", ["vitest"], []), ("Playwright", ["@playwright/test"], []),
                ("Cypress", ["cypress"], [])],
    "build_tools": [("Vite", ["vite"], []), ("Webpack", ["webpack"], []), ("esbuild", ["esbuild"], []),
                    ("Rollup", ["rollup"], []), ("Turborepo", ["turbo"], [])],
}
REACT_SUPPRESSED_BY = "next"
# Substring needles per root manifest: (manifest, facet, label, needles), in push order.
NEEDLES = [
    ("requirements.txt", "backend", "Django", ["django"]),
    ("requirements.txt", "backend", "Flask", ["flask"]),
    ("requirements.txt", "backend", "FastAPI", ["fastapi"]),
    ("requirements.txt", "backend", "Tornado", ["tornado"]),
    ("requirements.txt", "backend", "aiohttp", ["aiohttp"]),
    ("requirements.txt", "databases", "SQLAlchemy", ["sqlalchemy"]),
    ("requirements.txt", "databases", "PostgreSQL", ["psycopg2", "asyncpg"]),
    ("requirements.txt", "databases", "MongoDB", ["pymongo"]),
    ("requirements.txt", "databases", "Redis", ["redis"]),
    ("requirements.txt", "testing", "pytest", ["pytest"]),
    ("requirements.txt", "backend", "Celery", ["celery"]),
    ("go.mod", "backend", "Gin", ["gin-gonic/gin"]),
    ("go.mod", "backend", "Fiber", ["gofiber/fiber"]),
    ("go.mod", "backend", "Echo", ["labstack/echo"]),
    ("go.mod", "backend", "Chi", ["go-chi/chi"]),
    ("go.mod", "databases", "PostgreSQL", ["jackc/pgx", "lib/pq"]),
    ("go.mod", "databases", "Redis", ["go-redis"]),
    ("go.mod", "databases", "GORM", ["gorm.io"]),
    ("Cargo.toml", "backend", "Actix Web", ["actix-web"]),
    ("Cargo.toml", "backend", "Axum", ["axum"]),
    ("Cargo.toml", "backend", "Rocket", ["rocket"]),
    ("pom.xml", "backend", "Spring Boot", ["spring-boot"]),
    ("pom.xml", "backend", "Spring MVC", ["spring-web"]),
    ("pom.xml", "databases", "Hibernate ORM", ["hibernate"]),
]
LOCKFILES = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"),
             ("package-lock.json", "npm")]
VSCODE_DEPS = ["vsce", "@vscode/vsce"]
WORKER_DEPS = ["@cloudflare/workers-types", "wrangler"]
CLI_EXCLUDED_FRONTEND = ["react", "vue", "@angular/core", "svelte", "next", "remix", "gatsby", "solid-js"]
CLI_EXCLUDED_BACKEND = ["express", "fastify", "@nestjs/core", "koa", "hono"]
DOCKER_FILES = ["Dockerfile", "docker-compose.yml"]
CI_PATHS = [".github/workflows", ".gitlab-ci.yml", "Jenkinsfile"]
MONOREPO_FILES = ["pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json"]
MONOREPO_DIRS = ["packages", "apps"]
SERVERLESS_FILES = ["serverless.yml", "serverless.yaml", "netlify.toml", "vercel.json", "amplify.yml"]
ACTION_FILES = ["action.yml", "action.yaml"]
LANG_NODE, LANG_TS = "JavaScript/TypeScript", "TypeScript"
# ---------------------------------------------------------------------------

FACETS = ["frontend", "backend", "databases", "styling", "testing", "build_tools"]
MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml",
             "manifest.json", "tsconfig.json"]
MARKER_FILES = sorted(set(
    [m for m, _ in LOCKFILES] + DOCKER_FILES + CI_PATHS + MONOREPO_FILES + SERVERLESS_FILES + ACTION_FILES
    + ["wrangler.toml"] + MANIFESTS))
MARKER_DIRS = sorted(set(MONOREPO_DIRS + ["src", "src/modules", ".github/workflows"]))


def marker_col(name: str) -> str:
    return "m_" + "".join(c if c.isalnum() else "_" for c in name)


def dir_col(name: str) -> str:
    return "d_" + "".join(c if c.isalnum() else "_" for c in name)


def manifest_col(name: str) -> str:
    return "t_" + "".join(c if c.isalnum() else "_" for c in name)


def marker_aggregates() -> list:
    """Aggregate expressions of the marker probes (usable inside a larger ``agg``)."""
    aggs = [F.expr(f"max(path = {sq(m)})").alias(marker_col(m)) for m in MARKER_FILES]
    aggs += [F.expr(f"max(startswith(path, {sq(d + '/')}))").alias(dir_col(d)) for d in MARKER_DIRS]
    # at most one root manifest of each name per repository; collect_list keeps the
    # aggregation hash-based (a string max() would force a sort-based aggregate)
    aggs += [F.expr(f"collect_list(CASE WHEN path = {sq(m)} THEN manifest_text END)").alias(manifest_col(m))
             for m in MANIFESTS]
    aggs.append(F.max("css_module").alias("has_css_modules"))
    return aggs


def first_manifest(df: DataFrame) -> DataFrame:
    """Turn the collected manifest lists into single (nullable) strings."""
    return df.select(*[F.get(F.flatten(F.col(c)) if dict(df.dtypes)[c].startswith("array<array")
                             else F.col(c), 0).alias(c)
                       if c in {manifest_col(m) for m in MANIFESTS} else F.col(c) for c in df.columns])


def repo_markers(files: DataFrame) -> DataFrame:
    """Root-marker existence and root manifest texts, one row per repository.

    Only manifest rows contribute a non-null string, so file bodies other than
    root manifests never cross the shuffle.
    """
    return first_manifest(files.groupBy("repo_id").agg(*marker_aggregates()))


def _exists(name: str) -> Column:
    return F.col(marker_col(name))


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _contains_any(arr: Column, values) -> Column:
    return F.arrays_overlap(arr, _lit_array(values))


def sq(v: str) -> str:
    """Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _arr_sql(values) -> str:
    return "array(" + ", ".join(sq(v) for v in values) + ")"


def catalog_labels_sql(facet: str, all_deps: str = "_all_deps", dev_deps: str = "dev_dependencies") -> str:
    """Node labels of one facet in catalog order, as one SQL expression (parsed once in the JVM)."""
    items = []
    for label, any_scope, dev_scope in NODE_CATALOG[facet]:
        conds = []
        if any_scope:
            conds.append(f"arrays_overlap({all_deps}, {_arr_sql(any_scope)})")
        if dev_scope:
            conds.append(f"arrays_overlap({dev_deps}, {_arr_sql(dev_scope)})")
        cond = "(" + " OR ".join(conds) + ")"
        if label == "React":
            cond = f"({cond} AND NOT array_contains({all_deps}, {sq(REACT_SUPPRESSED_BY)}))"
        items.append(f"CASE WHEN {cond} THEN {sq(label)} END")
    return "array_compact(array(" + ", ".join(items) + "))"


def needle_labels_sql(manifest: str, facet: str, text_sql: str) -> str:
    items = []
    for m, f, label, needles in NEEDLES:
        if m == manifest and f == facet:
            cond = " OR ".join(f"contains({text_sql}, {sq(n)})" for n in needles)
            items.append(f"CASE WHEN {cond} THEN {sq(label)} END")
    if not items:
        return "CAST(array() AS array<string>)"
    return "array_compact(array(" + ", ".join(items) + "))"


def _json_keys(doc: Column, field: str, v: Column) -> Column:
    """Keys in the order of the text; of a repeated field the last one's, which the parsed document ``v`` holds."""
    text = F.json_object_keys(F.get_json_object(doc, f"$.{field}"))
    last = F.map_keys(F.try_variant_get(v, f"$.{field}", "map<string,variant>"))
    return F.coalesce(F.when(F.size(F.array_except(last, text)) == 0, F.array_intersect(text, last)), last, F.array().cast("array<string>"))


def stack_profile(markers: DataFrame, passthrough=()) -> DataFrame:
    """The detected-stack record per repository (arrays keep push order).

    ``passthrough`` names columns of ``markers`` carried to the output unchanged.
    """
    pkg = F.col(manifest_col("package.json"))
    v = F.try_parse_json(pkg)
    node_parsed = pkg.isNotNull() & v.isNotNull()
    json_null = F.schema_of_variant(v) == F.lit("VOID")
    node = node_parsed & ~json_null           # the Node branch ran to completion
    deps = F.when(node, _json_keys(pkg, "dependencies", v)).otherwise(F.array().cast("array<string>"))
    dev = F.when(node, _json_keys(pkg, "devDependencies", v)).otherwise(F.array().cast("array<string>"))
    all_deps = F.concat(deps, dev)
    df = markers.select("*", node_parsed.alias("node_parsed"), node.alias("node"),
                        deps.alias("dependencies"), dev.alias("dev_dependencies"), v.alias("_pkg_v"))
    df = df.select("*", F.concat(F.col("dependencies"), F.col("dev_dependencies")).alias("_all_deps"))
    node, all_deps, dev = F.col("node"), F.col("_all_deps"), F.col("dev_dependencies")

    py_exists = _exists("requirements.txt") | _exists("pyproject.toml")
    go, rust, java = _exists("go.mod"), _exists("Cargo.toml"), _exists("pom.xml")

    # Node-branch labels per facet, materialised once (reused by facets and type inference)
    empty_sql = "CAST(array() AS array<string>)"
    df = df.select("*", *[F.expr(f"CASE WHEN node THEN {catalog_labels_sql(f)} ELSE {empty_sql} END").alias(f"_node_{f}")
                          for f in FACETS])
    texts = {"requirements.txt": f"lower(coalesce({manifest_col('requirements.txt')}, ''))",
             "go.mod": f"coalesce({manifest_col('go.mod')}, '')",
             "Cargo.toml": f"coalesce({manifest_col('Cargo.toml')}, '')",
             "pom.xml": f"coalesce({manifest_col('pom.xml')}, '')"}
    guards = {"requirements.txt": marker_col("requirements.txt"), "go.mod": marker_col("go.mod"),
              "Cargo.toml": marker_col("Cargo.toml"), "pom.xml": marker_col("pom.xml")}
    facet_cols = {}
    for facet in FACETS:
        parts = [f"_node_{facet}"] + [
            f"CASE WHEN {guards[m]} THEN {needle_labels_sql(m, facet, texts[m])} ELSE {empty_sql} END"
            for m in ("requirements.txt", "go.mod", "Cargo.toml", "pom.xml")]
        facet_cols[facet] = F.expr("concat(" + ", ".join(parts) + ")")
    # styling default (Node branch only): CSS Modules probe, else Plain CSS
    node_styling = facet_cols["styling"]
    facet_cols["styling"] = F.when(node & (F.size(node_styling) == 0),
                                   F.array(F.when(F.col("has_css_modules"), F.lit("CSS Modules"))
                                           .otherwise(F.lit("Plain CSS")))).otherwise(node_styling)
    df = df.select("*", *[c.alias(f) for f, c in facet_cols.items()])

    has_ts = node & (F.array_contains(all_deps, "typescript") | _exists("tsconfig.json"))
    pm = F.lit(None).cast("string")
    for marker, label in reversed(LOCKFILES):
        pm = F.when(_exists(marker), F.lit(label)).otherwise(pm)
    pm = F.when(node, pm)

    pv = F.col("_pkg_v")
    engines_vscode = F.schema_of_variant(F.variant_get(pv, "$.engines.vscode", "variant")) == F.lit("STRING")
    bin_v = F.variant_get(pv, "$.bin", "variant")
    bin_type = F.schema_of_variant(bin_v)
    bin_truthy = (F.when(bin_type == "STRING", F.try_variant_get(pv, "$.bin", "string") != "")
                  .when(bin_type == "BOOLEAN", F.try_variant_get(pv, "$.bin", "boolean"))
                  .when(bin_type.startswith("OBJECT") | bin_type.startswith("ARRAY"), F.lit(True))
                  .when(bin_type.isin("VOID"), F.lit(False))
                  .when(bin_type.isNotNull(), F.try_variant_get(pv, "$.bin", "double") != 0)
                  .otherwise(F.lit(False)))
    manifest_v = F.try_parse_json(F.col(manifest_col("manifest.json")))
    mv_type = F.schema_of_variant(F.variant_get(manifest_v, "$.manifest_version", "variant"))
    browser_ext = _exists("manifest.json") & (mv_type.startswith("BIGINT") | mv_type.startswith("DECIMAL")
                                             | mv_type.startswith("DOUBLE") | mv_type.startswith("INT"))
    specialized = (
        F.when(engines_vscode | _contains_any(all_deps, VSCODE_DEPS), F.lit("VS Code Extension"))
        .when(_exists("action.yml") | _exists("action.yaml"), F.lit("GitHub Action"))
        .when(_exists("wrangler.toml") | _contains_any(all_deps, WORKER_DEPS), F.lit("Cloudflare Worker"))
        .when(F.coalesce(browser_ext, F.lit(False)), F.lit("Browser Extension"))
        .when(F.coalesce(bin_truthy, F.lit(False)) & ~_contains_any(all_deps, CLI_EXCLUDED_FRONTEND)
              & ~_contains_any(all_deps, CLI_EXCLUDED_BACKEND), F.lit("CLI Tool")))
    node_front, node_back = F.col("_node_frontend"), F.col("_node_backend")
    inferred = (F.when(F.array_contains(node_front, "Next.js"), F.lit("Full-Stack Web App (Next.js)"))
                .when((F.size(node_front) > 0) & (F.size(node_back) > 0), F.lit("Full-Stack Web App"))
                .when(F.size(node_front) > 0, F.lit("Frontend Web App"))
                .when(F.size(node_back) > 0, F.lit("Backend API"))
                .otherwise(F.lit("Node.js Application")))
    # backend marks present when the Python branch runs: Node + Python ones
    py_backend = F.expr(f"concat(_node_backend, CASE WHEN {guards['requirements.txt']} THEN "
                        f"{needle_labels_sql('requirements.txt', 'backend', texts['requirements.txt'])} "
                        f"ELSE {empty_sql} END)")
    project_type = (F.when(java, F.lit("Java Application"))
                    .when(rust, F.lit("Rust Application"))
                    .when(go, F.lit("Go Application"))
                    .when(py_exists, F.when(F.size(py_backend) > 0, F.lit("Python Web App"))
                          .otherwise(F.lit("Python Application")))
                    .when(node, F.coalesce(specialized, inferred))
                    .otherwise(F.lit("Unknown")))
    language = (F.when(java, F.lit("Java")).when(rust, F.lit("Rust")).when(go, F.lit("Go"))
                .when(py_exists, F.lit("Python"))
                .when(has_ts, F.lit(LANG_TS))
                .when(F.col("node_parsed"), F.lit(LANG_NODE))
                .otherwise(F.lit("Unknown")))
    has_docker = F.lit(False)
    for m in DOCKER_FILES:
        has_docker = has_docker | _exists(m)
    has_ci = F.col(dir_col(".github/workflows")) | _exists(".github/workflows") | _exists(".gitlab-ci.yml") \
        | _exists("Jenkinsfile")
    monorepo = F.lit(False)
    for m in MONOREPO_FILES:
        monorepo = monorepo | _exists(m)
    for d in MONOREPO_DIRS:
        monorepo = monorepo | F.col(dir_col(d))
    serverless = F.lit(False)
    for m in SERVERLESS_FILES:
        serverless = serverless | _exists(m)
    return df.select(
        "repo_id", language.alias("language"), project_type.alias("project_type"),
        *FACETS, pm.alias("package_manager"), "dependencies", "dev_dependencies",
        has_docker.alias("has_docker"), has_ci.alias("has_ci"), has_ts.alias("has_typescript"),
        monorepo.alias("has_monorepo_setup"), serverless.alias("has_serverless_config"),
        (F.col(dir_col("src")) & F.col(dir_col("src/modules"))).alias("has_src_modules"),
        *passthrough,
    )


def flatten_profile(profile: DataFrame) -> DataFrame:
    """Scalar form of the stack record (arrays joined with ', ')."""
    cols = [F.array_join(F.col(f), ", ").alias(f) for f in FACETS]
    return profile.select(
        "repo_id", "language", "project_type", *cols, "package_manager",
        F.array_join("dependencies", " ").alias("dependencies"),
        F.array_join("dev_dependencies", " ").alias("dev_dependencies"),
        "has_docker", "has_ci", "has_typescript")
