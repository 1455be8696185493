"""DuckDB spellings of the shared derived views, used by ``oracle_sql()``.

The oracle re-derives the corpus and the per-file facts from the same
literal tables as the Spark side, then each query adds its own SELECT.
"""

from __future__ import annotations

from repolens.functions import paths as P
from repolens.functions import text as X
from repolens.sources.corpus import FILES_PER_REPO, VARIANTS, slot_rows


def _values(rows) -> str:
    out = []
    for row in rows:
        cells = []
        for v in row:
            if isinstance(v, bool):
                cells.append("TRUE" if v else "FALSE")
            elif isinstance(v, (int, float)):
                cells.append(str(v))
            elif v is None:
                cells.append("NULL")
            else:
                cells.append(X.sql_str(v))
        out.append("(" + ", ".join(cells) + ")")
    return ",\n".join(out)


def corpus_cte() -> str:
    return f"""corpus_slots(variant, slot, path, body, append_text) AS (VALUES
{_values(slot_rows())}),
docs AS (
  SELECT doc_id, text, doc_id // {FILES_PER_REPO} AS repo_id, doc_id % {FILES_PER_REPO} AS slot,
         (doc_id // {FILES_PER_REPO}) % {VARIANTS} AS variant
  FROM documents),
repo_files AS (
  SELECT d.repo_id, s.path,
         CASE WHEN s.append_text THEN s.body || chr(10) || d.text ELSE s.body END AS content
  FROM docs d JOIN corpus_slots s ON s.variant = d.variant AND s.slot = d.slot),
repo_list AS (SELECT DISTINCT doc_id // {FILES_PER_REPO} AS repo_id FROM documents)"""


def file_facts_cte() -> str:
    ext = P.sql_extension("path")
    return f"""{corpus_cte()},
ff0 AS (
  SELECT repo_id, path, CAST(strlen(content) AS BIGINT) AS size, content,
         {P.sql_is_kept('path')} AS kept,
         {ext} AS ext,
         {P.sql_is_test_walk('path')} AS is_test,
         {P.sql_is_test_complexity('path')} AS is_test_cx,
         {P.sql_is_css_module_candidate('path')} AS css_module
  FROM repo_files),
ff1 AS (
  SELECT *, {P.sql_in('ext', P.CONFIG_EXTENSIONS)} AS is_config,
         {P.sql_in('ext', P.CODE_EXTENSIONS)} AS is_code,
         (kept AND {P.sql_in('ext', P.CODE_EXTENSIONS)} AND content IS NOT NULL
          AND size <= {P.MAX_FILE_SIZE}) AS readable
  FROM ff0),
file_facts AS (
  SELECT repo_id, path, size, kept, ext, is_test, is_test_cx, css_module, is_config, is_code, readable,
         CASE WHEN readable THEN {X.sql_line_count('content')} END AS lines,
         CASE WHEN readable AND {P.sql_in('ext', X.COMPONENT_EXTENSIONS)}
              THEN {X.sql_count_any('content', X.COMPONENT_PATTERNS)}
              WHEN readable THEN CAST(0 AS BIGINT) END AS components,
         CASE WHEN readable THEN {X.sql_count_any('content', X.ROUTE_PATTERNS)} END AS routes,
         CASE WHEN readable THEN {X.sql_count('content', X.DECISION_POINTS)} + 1 END AS complexity,
         CASE WHEN readable THEN {X.sql_count('content', X.FUNCTIONS)} END AS functions
  FROM ff1)"""


def repo_stats_cte() -> str:
    return """repo_stats AS (
  SELECT repo_id,
         CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS file_count,
         CAST(coalesce(sum(CASE WHEN kept THEN components END), 0) AS BIGINT) AS component_count,
         CAST(coalesce(sum(CASE WHEN kept THEN routes END), 0) AS BIGINT) AS api_route_count,
         CAST(coalesce(sum(CASE WHEN kept THEN lines END), 0) AS BIGINT) AS line_count,
         CAST(count(*) FILTER (WHERE kept AND is_test) AS BIGINT) AS test_file_count,
         CAST(count(*) FILTER (WHERE kept AND is_config) AS BIGINT) AS config_file_count
  FROM file_facts GROUP BY repo_id)"""


def complexity_cte() -> str:
    return """cx_base AS (
  SELECT repo_id,
         CAST(count(*) FILTER (WHERE readable AND NOT is_test_cx) AS BIGINT) AS n,
         sum(CASE WHEN readable AND NOT is_test_cx THEN complexity END) AS total_complexity,
         max(CASE WHEN readable AND NOT is_test_cx THEN complexity END) AS max_c,
         sum(CASE WHEN readable AND NOT is_test_cx THEN functions END) AS total_f,
         sum(CASE WHEN readable AND NOT is_test_cx THEN lines END) AS total_lines,
         CAST(count(*) FILTER (WHERE readable AND is_test_cx) AS BIGINT) AS test_files_excluded
  FROM file_facts GROUP BY repo_id),
cx_dup AS (
  SELECT repo_id, max(c) AS max_bucket FROM (
    SELECT repo_id, CAST(floor(lines / 50.0 + 0.5) * 50 AS BIGINT) AS bucket, count(*) AS c
    FROM file_facts WHERE readable AND NOT is_test_cx GROUP BY 1, 2) GROUP BY repo_id),
repo_complexity AS (
  SELECT b.repo_id,
    CASE WHEN n > 0 THEN floor(CAST(total_complexity AS DOUBLE) / n * 10 + 0.5) / 10 ELSE 0.0 END AS average_complexity,
    CAST(coalesce(max_c, 0) AS BIGINT) AS max_complexity,
    CAST(coalesce(total_f, 0) AS BIGINT) AS total_functions,
    CAST(CASE WHEN total_f > 0 THEN floor(CAST(total_lines AS DOUBLE) / total_f + 0.5) ELSE 0 END AS BIGINT) AS lines_per_function,
    CASE WHEN n = 0 THEN 'low' WHEN CAST(max_bucket AS DOUBLE) / n > 0.3 THEN 'high'
         WHEN CAST(max_bucket AS DOUBLE) / n > 0.15 THEN 'medium' ELSE 'low' END AS duplication_risk,
    test_files_excluded
  FROM cx_base b LEFT JOIN cx_dup d ON b.repo_id = d.repo_id)"""
