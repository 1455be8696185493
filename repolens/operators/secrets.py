"""Secret and risky-sink scanning (C6) plus input validators.

``scan_secrets`` explodes only files whose content matches at least one
pattern (a whole-file ``rlike`` pre-filter), then tests every line of those
files against the fixed pattern list inside one projection - the pattern
list is a literal array, so there is no join and nothing to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths as P
from repolens.functions import text as X

# ---------------------------------------------------------------------------
# Pattern set: type, severity, pattern (JavaScript syntax). The first two
# types and the risky-sink label are fixed by the reference's tests; the rest
# of the set is ours.
# ---------------------------------------------------------------------------
SECRET_PATTERNS = [
    ("AWS Access Key", "critical", r"AKIA[0-9A-Z]{16}"),
    ("OpenAI API Key", "critical", r"sk-[A-Za-z0-9]{20,}"),
    ("Groq API Key", "critical", r"gsk_[A-Za-z0-9]{20,}"),
    ("Private Key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("Hardcoded Token", "high",
     r"(?i)(?:token|secret|password|api_?key)\s*[:=]\s*[" + "\"'" + r"][A-Za-z0-9_\-]{16,}[" + "\"'" + r"]"),
    ("eval() usage", "medium", r"\beval\s*\("),
]
COMMENT_LINE = r"^\s*(//|#)"
REGEX_DEFINITION_LINE = r"(?i)(regex|pattern)\s*[:=]|new\s+RegExp\s*\("
REDACTED_SUFFIX = "...[REDACTED]"
REDACTED_KEEP = 4
# ---------------------------------------------------------------------------

ANY_PATTERN = "|".join(f"(?:{X.spark_pattern(p)})" for _, _, p in SECRET_PATTERNS)


def redact(match: Column) -> Column:
    return F.concat(F.substring(match, 1, REDACTED_KEEP), F.lit(REDACTED_SUFFIX))


def line_findings(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """Per line, one row per matching pattern: type, severity, redacted match."""
    line = F.col(text_col)
    hits = F.array_compact(F.array(*[
        F.when(line.rlike(X.spark_pattern(p)),
               F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(s).alias("severity"),
                        redact(F.regexp_extract(line, X.spark_pattern(p), 0)).alias("match")))
        for i, (t, s, p) in enumerate(SECRET_PATTERNS)]))
    live = ~line.rlike(COMMENT_LINE) & ~line.rlike(REGEX_DEFINITION_LINE)
    cols = [c for c in lines.columns if c != text_col]
    return (lines.where(live & line.rlike(ANY_PATTERN))
            .select(*cols, F.explode(hits).alias("h"))
            .select(*cols, "h.type", "h.severity", "h.match", F.col("h.ord").alias("pattern_ord")))


def is_scanned() -> Column:
    """Files that the secret scan reads: walked, no test by either predicate, read and not over the size cap."""
    path = F.col("path")
    return (P.is_kept(path) & ~P.is_test_walk(path) & ~P.is_test_complexity(path)
            & F.col("content").isNotNull() & (F.col("size") <= P.MAX_FILE_SIZE))


def scan_secrets(files: DataFrame) -> DataFrame:
    """C6 over the walked files: ``(repo_id, path, line, type, severity, match)``.

    Test files (either test predicate), files over the size cap and unreadable
    files are skipped, as are comment lines and scanner-definition lines.
    """
    scanned = files.where(is_scanned() & F.col("content").rlike(ANY_PATTERN))
    lines = scanned.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    lines = lines.select("repo_id", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")
    return line_findings(lines).withColumnRenamed("line_no", "line")


def files_scanned(files: DataFrame) -> DataFrame:
    """Per repository, how many files the secret scan read."""
    return files.groupBy("repo_id").agg(F.count_if(is_scanned()).cast("bigint").alias("files_scanned"))


# ---------------------------------------------------------------------------
# Validators (B10-B12). Fixed values of the reference.
# ---------------------------------------------------------------------------
SAFE_GIT_URL = (r"^https://[a-zA-Z0-9._\-/]+(?:\.git)?\z|^git@[a-zA-Z0-9._\-]+:[a-zA-Z0-9._\-/]+(?:\.git)?\z")
SAFE_MODEL_ID = r"^[a-zA-Z0-9._\-/]{3,80}\z"
SHELL_METACHARS = r"[;&|`$<>(){}'" + '"' + r"\\\n\r]"
BLOCKED_PREFIXES = ["/etc", "/usr", "/bin", "/sbin", "/boot", "/proc", "/sys",
                    "C:\\Windows", "C:\\System32", "C:\\Program Files"]
NON_HTTP_TYPES = ["CLI Tool", "VS Code Extension", "Library/Package", "GitHub Action", "Browser Extension",
                  "npm Package"]
NON_HTTP_RE = r"(?i)cli tool|plugin|extension|library|package|github action"
# ---------------------------------------------------------------------------


def target_verdict(target: Column, base_dir: str = "/work") -> Column:
    """NULL when valid, else the first failing reason.

    Local paths are resolved (against ``base_dir`` when relative; repeated
    slashes and ``.`` parts go) before the blocked-prefix test.
    """
    norm = F.regexp_replace(target, r"\\", "/")
    traversal = F.exists(F.split(norm, "/"), lambda s: s == "..")
    resolved = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), target))
    resolved = F.regexp_replace(resolved, r"/+(?:\.(?:/+|\z))*", "/")
    blocked = F.lit(False)
    for p in BLOCKED_PREFIXES:
        blocked = blocked | resolved.startswith(p)
    remote = target.startswith("https://") | target.startswith("git@") | target.startswith("git://")
    return (F.when(target.isNull() | (X.js_trim(target) == ""), F.lit("empty"))
            .when(target.contains("\u0000"), F.lit("null_byte"))
            .when(target.startswith("http://"), F.lit("insecure_http"))
            .when(remote, F.when(~target.rlike(SAFE_GIT_URL), F.lit("invalid_url")))
            .when(target.rlike(SHELL_METACHARS), F.lit("shell_metachar"))
            .when(traversal, F.lit("path_traversal"))
            .when(blocked, F.lit("restricted_dir")))


def model_id_ok(model: Column) -> Column:
    """B11."""
    return F.coalesce(model.rlike(SAFE_MODEL_ID), F.lit(False))


def is_non_http(project_type: Column) -> Column:
    """Project types that serve no HTTP traffic."""
    return project_type.isin(*NON_HTTP_TYPES) | project_type.rlike(NON_HTTP_RE)
