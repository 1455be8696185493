"""Text measures over file content (operators C1-C5, C7, C8).

All measures are built-in JVM expressions (``regexp_count``, ``regexp_replace``),
so they stay inside whole-stage codegen; no Python runs per row.

Regex dialects: the reference's patterns use ``\\b`` with ASCII word
characters. Java's ``\\b`` is Unicode-aware, so in Spark every ``\\b`` is
rewritten to an ASCII look-around; the DuckDB oracle (RE2) keeps ``\\b``,
which is ASCII there already.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Patterns are written in the reference's (JavaScript) syntax.
# ---------------------------------------------------------------------------
DECISION_POINTS = (r"\bif\b|\belse\s+if\b|\bfor\b|\bwhile\b|\bdo\b|\bswitch\b|\bcase\b|"
                   r"\bcatch\b|&&|\|\||\?\?|\s\?\s")
FUNCTIONS = r"\bfunction\b|=>|\basync\b"
ROUTE_PATTERNS = (
    r"(?i)\.(?:get|post|put|patch|delete|all)\s*\(\s*['" + '"' + r"` ]",
    r"\bRoute\s*\(",
    r"@(?:Get|Post|Put|Patch|Delete)\s*\(",
)
COMPONENT_PATTERNS = (
    r"export\s+(?:default\s+)?function\s+[A-Z][a-zA-Z]+",
    r"export\s+(?:default\s+)?const\s+[A-Z][a-zA-Z]+\s*[=:]",
    r"class\s+[A-Z][a-zA-Z]+\s+extends\s+(?:React\.Component|Component|PureComponent)",
)
COMPONENT_EXTENSIONS = (".tsx", ".jsx", ".vue")
# scrub order: (pattern, replacement)
SCRUB_RULES = (
    (r"gsk_[A-Za-z0-9]{20,}", "[GROQ_KEY_REDACTED]"),
    (r"Bearer\s+[A-Za-z0-9._\-]{20,}", "Bearer [REDACTED]"),
    (r"sk-[A-Za-z0-9]{20,}", "[API_KEY_REDACTED]"),
)
MASK_TAG = "[REDACTED]"
MASK_MIN_LENGTH = 12
MASK_HEAD, MASK_TAIL = 7, 4
# ---------------------------------------------------------------------------

_WORD = "A-Za-z0-9_"


def ascii_boundaries(pattern: str) -> str:
    """Rewrite ``\\b`` into ASCII look-arounds for Java's regex engine."""
    out = re.sub(r"\\b(?=[A-Za-z0-9_(\[])", f"(?<![{_WORD}])", pattern)
    return out.replace(r"\b", f"(?![{_WORD}])")


def spark_pattern(pattern: str) -> str:
    return ascii_boundaries(pattern)


def count_matches(col: Column, pattern: str) -> Column:
    """Number of non-overlapping matches, like ``String.match(/.../g).length``."""
    return F.regexp_count(col, F.lit(spark_pattern(pattern))).cast("bigint")


def count_any(col: Column, patterns) -> Column:
    total = None
    for p in patterns:
        c = count_matches(col, p)
        total = c if total is None else total + c
    return total


def line_count(col: Column) -> Column:
    """``content.split('\\n').length``: one more than the newline count."""
    return (F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def decision_count(col: Column) -> Column:
    return count_matches(col, DECISION_POINTS)


def function_count(col: Column) -> Column:
    return count_matches(col, FUNCTIONS)


def route_count(col: Column) -> Column:
    return count_any(col, ROUTE_PATTERNS)


def component_count(col: Column) -> Column:
    return count_any(col, COMPONENT_PATTERNS)


def scrub_secrets(col: Column) -> Column:
    """Three ordered replacements."""
    out = col
    for pattern, repl in SCRUB_RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(repl))
    return out


def mask_secret(col: Column) -> Column:
    """Short or empty -> fixed tag, else first 7 + '...' + last 4."""
    return F.when(col.isNull() | (F.length(col) < MASK_MIN_LENGTH), F.lit(MASK_TAG)) \
        .otherwise(F.concat(F.substring(col, 1, MASK_HEAD), F.lit("..."), F.right(col, F.lit(MASK_TAIL))))


def js_trim(col: Column) -> Column:
    """JavaScript ``trim``: all white space, not blanks alone."""
    return F.regexp_replace(col, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+\z", "")


# ---- DuckDB (oracle) spellings of the same measures -------------------------

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {sql_str(pattern)})) AS BIGINT)"


def sql_count_any(expr: str, patterns) -> str:
    return "(" + " + ".join(sql_count(expr, p) for p in patterns) + ")"


def sql_line_count(expr: str) -> str:
    return f"CAST(length({expr}) - length(replace({expr}, chr(10), '')) + 1 AS BIGINT)"


def sql_scrub(expr: str) -> str:
    out = expr
    for pattern, repl in SCRUB_RULES:
        out = f"regexp_replace({out}, {sql_str(pattern)}, {sql_str(repl)}, 'g')"
    return out


def sql_mask(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR length({expr}) < {MASK_MIN_LENGTH} THEN {sql_str(MASK_TAG)} "
            f"ELSE substr({expr}, 1, {MASK_HEAD}) || '...' || right({expr}, {MASK_TAIL}) END")
