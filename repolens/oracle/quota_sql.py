"""DuckDB spelling of the request-log replay (oracle for J1-J4, J6-J11).

The sequential folds are recursive CTEs over per-(key, second) rows.
"""

from __future__ import annotations

from repolens.functions.text import sql_str
from repolens.operators import quota as Q
from repolens.sources import request_log as RL


def _in(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def version_ok_sql(v: str, minimum: str = Q.MIN_VERSION) -> str:
    mma, mmi, mpa = [float(x) for x in minimum.split(".")[:3]]
    ma, mi, pa = (f"TRY_CAST(split_part({v}, '.', {i}) AS DOUBLE)" for i in (1, 2, 3))
    return (f"coalesce(regexp_matches({v}, '^\\d+\\.\\d+\\.\\d+') AND (CASE WHEN {ma} <> {mma} THEN {ma} > {mma} "
            f"WHEN {mi} <> {mmi} THEN {mi} > {mmi} ELSE coalesce({pa} >= {mpa}, FALSE) END), FALSE)")


def slide_ctes(window_s: int, limit: int) -> str:
    """Sliding windows over ``limited (token, sec)`` as a recursion over seconds."""
    return f"""lim_secs AS (
  SELECT token, sec, count(*) AS n, row_number() OVER (PARTITION BY token ORDER BY sec) AS rn
  FROM limited GROUP BY token, sec),
slide AS (
  SELECT token, rn, sec, n, adm,
    CASE WHEN adm > 0 THEN [{{'s': sec, 'c': adm}}] ELSE [] END AS win,
    CASE WHEN n > adm AND adm > 0 THEN greatest(1, {window_s}) END AS retry
  FROM (SELECT token, rn, sec, n, greatest(0, least(n, {limit})) AS adm FROM lim_secs WHERE rn = 1)
  UNION ALL
  SELECT token, rn, sec, n, adm,
    CASE WHEN adm > 0 THEN list_append(pw, {{'s': sec, 'c': adm}}) ELSE pw END AS win,
    CASE WHEN n > adm AND (len(pw) > 0 OR adm > 0)
         THEN greatest(1, (CASE WHEN len(pw) > 0 THEN pw[1].s ELSE sec END) + {window_s} - sec) END AS retry
  FROM (
    SELECT s.token, s.rn, s.sec, s.n, list_filter(r.win, lambda x: x.s > s.sec - {window_s}) AS pw,
      greatest(0, least(s.n, {limit} - coalesce(list_sum(list_transform(
        list_filter(r.win, lambda x: x.s > s.sec - {window_s}), lambda x: x.c)), 0))) AS adm
    FROM slide r JOIN lim_secs s ON s.token = r.token AND s.rn = r.rn + 1))"""


def gate_ctes(window_s: int, limit: int, daily: int, max_body: int = Q.MAX_BODY_BYTES,
              allowed=None, configured=("groq",)) -> str:
    allowed = allowed or Q.allowed_models()
    browser = " OR ".join(f"contains(user_agent, {sql_str(a)})" for a in Q.BROWSER_AGENTS)
    return f"""{RL.request_log_cte()},
g0 AS (
  SELECT *, starts_with(auth_header, 'Bearer ') AS bearer,
    CASE WHEN starts_with(auth_header, 'Bearer ') THEN substr(auth_header, 8) END AS bearer_token,
    TRY_CAST(regexp_extract(client_ts, '^\\s*([+-]?\\d+)', 1) AS BIGINT) AS parsed_ts
  FROM request_log),
g1 AS (
  SELECT *,
    CASE WHEN client_ts = '' OR signature = '' THEN 'missing_signature'
         WHEN parsed_ts IS NULL THEN 'invalid_timestamp'
         WHEN abs(sec - parsed_ts) > {Q.MAX_CLOCK_SKEW_SECONDS} THEN 'timestamp_expired'
         WHEN NOT sig_ok THEN 'invalid_signature' END AS sig_reason
  FROM g0),
g2 AS (
  SELECT *,
    CASE WHEN method <> 'POST' OR route <> '/v1/compute' THEN 404 WHEN {browser} THEN 403
         WHEN NOT bearer THEN 401 WHEN NOT {version_ok_sql('version')} THEN 426
         WHEN sig_reason IS NOT NULL THEN 401 END AS pre_status,
    CASE WHEN NOT (starts_with(bearer_token, '{Q.TOKEN_PREFIX}') AND length(bearer_token) >= {Q.TOKEN_MIN_LENGTH})
              THEN 'invalid_token_format'
         WHEN NOT (length(machine_id) = 64 AND regexp_matches(machine_id, '^[0-9a-f]+$'))
              THEN 'invalid_machine_format' END AS fmt_reason
  FROM g1),
g3 AS (SELECT g2.*, t.state FROM g2 LEFT JOIN token_states t ON t.token = g2.bearer_token),
binding AS (
  SELECT bearer_token, first(machine_id ORDER BY ts, event_id) AS bound FROM g3
  WHERE pre_status IS NULL AND fmt_reason IS NULL AND state = 'unbound' GROUP BY bearer_token),
g4 AS (
  SELECT g3.*,
    CASE WHEN fmt_reason IS NOT NULL THEN fmt_reason WHEN state IS NULL THEN 'token_not_found'
         WHEN state = 'any' THEN NULL
         WHEN (CASE WHEN state = 'unbound' THEN b.bound ELSE state END) <> machine_id THEN 'machine_mismatch'
    END AS auth_reason
  FROM g3 LEFT JOIN binding b ON b.bearer_token = g3.bearer_token),
limited AS (SELECT event_id, bearer_token AS token, sec, ts, ts_ms FROM g4 WHERE pre_status IS NULL AND auth_reason IS NULL),
{slide_ctes(window_s, limit)},
slide_day AS (
  SELECT token, sec, adm, retry,
    coalesce(sum(adm) OVER (PARTITION BY token, sec // 86400 ORDER BY sec
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_before
  FROM slide),
quota AS (
  SELECT l.event_id, r <= adm AS slide_ok, CASE WHEN r > adm THEN retry END AS slide_retry,
    r <= adm AND day_before + r <= {daily} AS daily_ok,
    CASE WHEN r <= adm AND day_before + r > {daily}
         THEN greatest({Q.DAILY_RETRY_MIN_SECONDS}, ceil(((ts_ms - ts_ms % 86400000 + 86400000) - ts_ms) / 1000.0)) END
      AS daily_retry
  FROM (SELECT *, row_number() OVER (PARTITION BY token, sec ORDER BY ts, event_id) AS r FROM limited) l
  JOIN slide_day d ON d.token = l.token AND d.sec = l.sec),
gate AS (
  SELECT g.event_id,
    CAST(CASE WHEN pre_status IS NOT NULL THEN pre_status WHEN auth_reason IS NOT NULL THEN 401
         WHEN NOT slide_ok THEN 429 WHEN NOT daily_ok THEN 429 WHEN body_bytes > {max_body} THEN 413
         WHEN NOT body_json_ok THEN 400 WHEN model = '' OR model NOT IN {_in(allowed)} THEN 400
         WHEN provider NOT IN {_in(Q.SUPPORTED_PROVIDERS)} THEN 400
         WHEN provider NOT IN {_in(configured)} THEN 503 ELSE 200 END AS INTEGER) AS status,
    CASE WHEN pre_status = 404 THEN 'not_found' WHEN pre_status = 403 THEN 'browser'
         WHEN pre_status = 401 THEN coalesce(CASE WHEN NOT bearer THEN 'no_bearer' END, sig_reason)
         WHEN pre_status = 426 THEN 'outdated_client' WHEN auth_reason IS NOT NULL THEN auth_reason
         WHEN NOT slide_ok THEN 'rate_limited' WHEN NOT daily_ok THEN 'daily_limit'
         WHEN body_bytes > {max_body} THEN 'body_too_large' WHEN NOT body_json_ok THEN 'invalid_json'
         WHEN model = '' OR model NOT IN {_in(allowed)} THEN 'model_not_allowed'
         WHEN provider NOT IN {_in(Q.SUPPORTED_PROVIDERS)} THEN 'unsupported_provider'
         WHEN provider NOT IN {_in(configured)} THEN 'provider_not_configured' ELSE 'forwarded' END AS reason,
    CAST(CASE WHEN pre_status IS NULL AND auth_reason IS NULL AND NOT slide_ok THEN slide_retry
              WHEN pre_status IS NULL AND auth_reason IS NULL AND NOT daily_ok THEN daily_retry END AS BIGINT)
      AS retry_after
  FROM g4 g LEFT JOIN quota q ON q.event_id = g.event_id)"""


def fixed_window_sql(rpm: int, rpd: int) -> str:
    return f"""{RL.request_log_cte()},
fw AS (SELECT event_id, ts, ts_ms, model, ts_ms - ts_ms % 60000 AS minute, ts_ms - ts_ms % 86400000 AS day
       FROM request_log),
per_min AS (
  SELECT model, day, minute, count(*) AS n FROM fw GROUP BY ALL),
caps AS (
  SELECT model, minute, greatest(0, least({rpm}, {rpd} - least({rpd}, coalesce(sum(least(n, {rpm})) OVER (
    PARTITION BY model, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS cap
  FROM per_min),
fixed_window AS (
  SELECT f.event_id, f.model, r <= cap AS allowed,
    CASE WHEN r <= cap THEN NULL WHEN cap = {rpm} THEN 'rpm' ELSE 'rpd' END AS reason,
    CAST(CASE WHEN r <= cap THEN NULL WHEN cap = {rpm} THEN f.minute + 60000 - ts_ms
              ELSE f.day + 86400000 - ts_ms END AS BIGINT) AS retry_after_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY model, minute ORDER BY ts, event_id) AS r FROM fw) f
  JOIN caps c ON c.model = f.model AND c.minute = f.minute)"""


def cache_sql(ttl_ms: int = Q.CACHE_TTL_MS) -> str:
    return f"""{RL.request_log_cte()},
lookups AS (
  SELECT event_id, ts, 'analysis:' || event_type || ':' || CAST(user_id % {RL.CACHE_KEY_BUCKETS} AS VARCHAR) AS key, ts_ms AS sec,
    CASE WHEN ts >= TIMESTAMP '{RL.CACHE_UPGRADE_AT}' THEN '2' ELSE '1' END AS version
  FROM request_log),
cache_secs AS (
  SELECT key, sec, first(version ORDER BY ts, event_id) AS version, row_number() OVER (PARTITION BY key ORDER BY sec) AS rn
  FROM lookups GROUP BY key, sec),
cache AS (
  SELECT key, rn, sec, FALSE AS first_hit, sec AS created, version AS ver FROM cache_secs WHERE rn = 1
  UNION ALL
  SELECT key, rn, sec, hit, CASE WHEN hit THEN created ELSE sec END, CASE WHEN hit THEN ver ELSE version END
  FROM (SELECT s.key, s.rn, s.sec, s.version, c.created, c.ver,
               (s.version = c.ver AND s.sec - c.created <= {ttl_ms}) AS hit
        FROM cache c JOIN cache_secs s ON s.key = c.key AND s.rn = c.rn + 1)),
cache_replay AS (
  SELECT l.event_id, l.key, CASE WHEN r = 1 THEN c.first_hit ELSE TRUE END AS hit
  FROM (SELECT *, row_number() OVER (PARTITION BY key, sec ORDER BY ts, event_id) AS r FROM lookups) l
  JOIN cache c ON c.key = l.key AND c.sec = l.sec)"""
