"""DuckDB spelling of the secret scan and validators."""

from __future__ import annotations

from repolens.functions import paths as P
from repolens.functions.text import sql_str
from repolens.operators import secrets as SC

ANY = "|".join(f"(?:{p})" for _, _, p in SC.SECRET_PATTERNS)


def line_hits(lines: str, keys: str) -> str:
    parts = []
    for i, (t, s, p) in enumerate(SC.SECRET_PATTERNS):
        parts.append(
            f"SELECT {keys}, {sql_str(t)} AS type, {sql_str(s)} AS severity, "
            f"substr(regexp_extract(text, {sql_str(p)}, 0), 1, {SC.REDACTED_KEEP}) || {sql_str(SC.REDACTED_SUFFIX)} AS match, "
            f"{i} AS pattern_ord FROM {lines} WHERE NOT regexp_matches(text, {sql_str(SC.COMMENT_LINE)}) "
            f"AND NOT regexp_matches(text, {sql_str(SC.REGEX_DEFINITION_LINE)}) AND regexp_matches(text, {sql_str(p)})")
    return "\nUNION ALL\n".join(parts)


def secrets_cte() -> str:
    return f"""scanned AS (
  SELECT repo_id, path, content FROM ff0
  WHERE kept AND NOT is_test AND NOT is_test_cx AND content IS NOT NULL AND size <= {P.MAX_FILE_SIZE}
    AND regexp_matches(content, {sql_str(ANY)})),
scan_lines AS (
  SELECT repo_id, path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line,
         unnest(string_split(content, chr(10))) AS text FROM scanned),
secret_findings AS (
{line_hits('scan_lines', 'repo_id, path, line')})"""


def target_verdict_sql(t: str, base_dir: str = "/work") -> str:
    resolved = f"CASE WHEN starts_with({t}, '/') THEN {t} ELSE {sql_str(base_dir.rstrip('/') + '/')} || {t} END"
    resolved = f"regexp_replace({resolved}, '/+(?:[.](?:/+|$))*', '/', 'g')"
    blocked = " OR ".join(f"starts_with({resolved}, {sql_str(p)})" for p in SC.BLOCKED_PREFIXES)
    traversal = f"list_contains(string_split(replace({t}, chr(92), '/'), '/'), '..')"
    remote = f"(starts_with({t}, 'https://') OR starts_with({t}, 'git@') OR starts_with({t}, 'git://'))"
    return (f"CASE WHEN {t} IS NULL OR regexp_replace({t}, '\\s+', '', 'g') = '' THEN 'empty' "
            f"WHEN contains({t}, chr(0)) THEN 'null_byte' "
            f"WHEN starts_with({t}, 'http://') THEN 'insecure_http' "
            f"WHEN {remote} THEN CASE WHEN NOT regexp_matches({t}, {sql_str(SC.SAFE_GIT_URL)}) THEN 'invalid_url' END "
            f"WHEN regexp_matches({t}, {sql_str(SC.SHELL_METACHARS)}) THEN 'shell_metachar' "
            f"WHEN {traversal} THEN 'path_traversal' WHEN {blocked} THEN 'restricted_dir' END")
