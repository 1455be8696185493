"""Path predicates on repository files (operators B1-B9).

Paths are repository-relative with ``/`` separators. Every predicate is a
built-in string or regex expression; ``ext``/``depth`` are cheap projections,
so on a stored listing they could be materialised and pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.text import sql_str

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
IGNORED_NAMES = ("node_modules", ".git", "dist", "build", ".next", ".nuxt", "__pycache__",
                 ".pytest_cache", "target", "vendor", ".venv", "venv", "env", "coverage",
                 ".nyc_output", "out")
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java",
                   ".kt", ".cs", ".rb", ".php", ".swift", ".vue", ".svelte")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml", ".ini")
MAX_FILE_SIZE = 524288
MAX_DEPTH = 15
CSS_MODULE_MAX_DEPTH = 3
# ---------------------------------------------------------------------------

IGNORED_RE = "(^|/)(" + "|".join(n.replace(".", r"\.") for n in IGNORED_NAMES) + ")(/|$)"
HIDDEN_DIR_RE = r"(^|/)\.[^/]*/"
EXT_RE = r"^.+(\.[^.]*)$"
TEST_COMPLEXITY_NAME_RE = r"\.(test|spec)\.(ts|js|tsx|jsx)$"


def depth(path: Column) -> Column:
    """Number of directory components."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """B2: lower-cased ``path.extname`` of the base name ('' for dotfiles)."""
    return F.regexp_extract(F.lower(file_name(path)), EXT_RE, 1)


def is_kept(path: Column) -> Column:
    """B1: survives the walk (no hidden directory, no ignored name, depth <= 15)."""
    return (~path.rlike(HIDDEN_DIR_RE)) & (~path.rlike(IGNORED_RE)) & (depth(path) <= MAX_DEPTH)


def is_test_walk(path: Column) -> Column:
    """Test-file predicate of the file walk."""
    name, d = file_name(path), F.concat(F.lit("/"), dir_name(path))
    return (name.contains(".test.") | name.contains(".spec.") | d.contains("__tests__")
            | d.contains("/test/") | d.contains("/tests/"))


def is_test_complexity(path: Column) -> Column:
    """The complexity analyser's (different) test predicate."""
    p = F.concat(F.lit("/"), path)
    return (path.rlike(TEST_COMPLEXITY_NAME_RE) | p.contains("/__tests__/") | p.contains("/test/")
            | p.contains("/tests/"))


def is_config_ext(ext: Column) -> Column:
    return ext.isin(*CONFIG_EXTENSIONS)


def is_code_ext(ext: Column) -> Column:
    return ext.isin(*CODE_EXTENSIONS)


def is_css_module_candidate(path: Column) -> Column:
    """``*.module.css`` within 3 directory levels, no dot entry, no node_modules."""
    return (file_name(path).endswith(".module.css") & (depth(path) <= CSS_MODULE_MAX_DEPTH)
            & ~path.rlike(r"(^|/)\.") & ~path.rlike(r"(^|/)node_modules(/|$)"))


# ---- DuckDB spellings ---------------------------------------------------------

def sql_depth(p: str) -> str:
    return f"(length({p}) - length(replace({p}, '/', '')))"


def sql_file_name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def sql_dir_name(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def sql_extension(p: str) -> str:
    return f"regexp_extract(lower({sql_file_name(p)}), {sql_str(EXT_RE)}, 1)"


def sql_is_kept(p: str) -> str:
    return (f"(NOT regexp_matches({p}, {sql_str(HIDDEN_DIR_RE)}) AND NOT regexp_matches({p}, {sql_str(IGNORED_RE)})"
            f" AND {sql_depth(p)} <= {MAX_DEPTH})")


def sql_is_test_walk(p: str) -> str:
    n, d = sql_file_name(p), f"('/' || {sql_dir_name(p)})"
    return (f"(contains({n}, '.test.') OR contains({n}, '.spec.') OR contains({d}, '__tests__')"
            f" OR contains({d}, '/test/') OR contains({d}, '/tests/'))")


def sql_is_test_complexity(p: str) -> str:
    q = f"('/' || {p})"
    return (f"(regexp_matches({p}, {sql_str(TEST_COMPLEXITY_NAME_RE)}) OR contains({q}, '/__tests__/')"
            f" OR contains({q}, '/test/') OR contains({q}, '/tests/'))")


def sql_in(expr: str, values) -> str:
    return f"{expr} IN (" + ", ".join(sql_str(v) for v in values) + ")"


def sql_is_css_module_candidate(p: str) -> str:
    return (f"(ends_with({sql_file_name(p)}, '.module.css') AND {sql_depth(p)} <= {CSS_MODULE_MAX_DEPTH}"
            f" AND NOT regexp_matches({p}, '(^|/)\\.') AND NOT regexp_matches({p}, '(^|/)node_modules(/|$)'))")
