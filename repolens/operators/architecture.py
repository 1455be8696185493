"""Architecture mapping (operators F1-F5): narrow projections of the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels and message formats).
# ---------------------------------------------------------------------------
SSR_FRAMEWORKS = ["Next.js", "Remix"]
CLI_LANGUAGES = ["Go", "Rust"]
LARGE_CODEBASE_FILES = 500
HIGH_API_ROUTES = 100
MANY_DEPENDENCIES = 50
SCALABILITY = [  # (label, predicate builder)
    ("Docker containerization", lambda: F.col("has_docker")),
    ("Monorepo structure", lambda: F.col("has_monorepo_setup")),
    ("Redis caching layer", lambda: F.array_contains("databases", "Redis")),
    ("Serverless deployment", lambda: F.col("has_serverless_config")),
    ("Modular NestJS architecture", lambda: F.array_contains("backend", "NestJS")),
    ("Turborepo build caching", lambda: F.array_contains("build_tools", "Turborepo")),
]
# ---------------------------------------------------------------------------


def _nonempty(c: str) -> Column:
    return F.size(F.col(c)) > 0


def architecture_columns() -> dict[str, Column]:
    """F1-F5 as column expressions over a profile row (no join, no shuffle)."""
    front, back, db = _nonempty("frontend"), _nonempty("backend"), _nonempty("databases")
    mono, srv = F.col("has_monorepo_setup"), F.col("has_serverless_config")
    ssr = F.arrays_overlap(F.col("frontend"), F.array(*[F.lit(x) for x in SSR_FRAMEWORKS]))
    shape = (F.when(ssr, F.lit("Full-Stack SSR"))
             .when(front & ~back, F.when(srv, F.lit("JAMstack")).otherwise(F.lit("SPA")))
             .when(~front & back, F.lit("API-First"))
             .when(front & back, F.when(F.col("has_src_modules"), F.lit("Clean Architecture"))
                   .otherwise(F.lit("Monolith"))))
    found = F.array_compact(F.array(F.when(mono, F.lit("Monorepo")), F.when(srv, F.lit("Serverless")), shape))
    fallback = F.when(F.col("language").isin(*CLI_LANGUAGES), F.lit("CLI Tool")).otherwise(F.lit("Library/Package"))
    patterns = F.when(F.size(found) > 0, found).otherwise(F.array(fallback))
    scal = F.array_compact(F.array(*[F.when(pred(), F.lit(label)) for label, pred in SCALABILITY]))
    n_deps = F.size("dependencies")
    cplx = F.array_compact(F.array(
        F.when(F.col("file_count") > LARGE_CODEBASE_FILES,
               F.format_string("Large codebase (%d files)", F.col("file_count"))),
        F.when(F.col("api_route_count") > HIGH_API_ROUTES,
               F.format_string("High API surface (%d routes)", F.col("api_route_count"))),
        F.when(n_deps > MANY_DEPENDENCIES, F.format_string("Many dependencies (%d)", n_deps)),
        F.when(F.col("test_file_count") == 0, F.lit("No test coverage detected")),
        F.when(~F.col("has_ci"), F.lit("No CI/CD pipeline")),
    ))
    layers = front.cast("int") + back.cast("int") + db.cast("int")
    desc = F.concat_ws(", ",
                       F.array_join(patterns, " + "),
                       F.when(F.col("language") != "Unknown", F.concat(F.lit("written in "), F.col("language"))),
                       F.when(F.col("line_count") > 0,
                              F.concat(F.lit("with ~"), F.format_number(F.col("line_count"), 0),
                                       F.lit(" lines of code"))))
    return {
        "patterns": patterns, "has_monorepo_setup": mono, "has_serverless_config": srv,
        "has_api_layer": F.col("api_route_count") > 0, "has_frontend_layer": front,
        "has_backend_layer": back, "has_database_layer": db, "layer_count": layers.cast("bigint"),
        "scalability_signals": scal, "complexity_signals": cplx, "description": desc,
    }


def architecture(profile: DataFrame) -> DataFrame:
    return profile.select("repo_id", *[c.alias(n) for n, c in architecture_columns().items()])


def flatten_architecture(arch: DataFrame) -> DataFrame:
    return arch.select(
        "repo_id", F.array_join("patterns", ", ").alias("patterns"),
        "has_monorepo_setup", "has_serverless_config", "has_api_layer", "has_frontend_layer",
        "has_backend_layer", "has_database_layer", "layer_count",
        F.array_join("scalability_signals", "; ").alias("scalability_signals"),
        F.array_join("complexity_signals", "; ").alias("complexity_signals"),
        "description")
