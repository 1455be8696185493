"""Registered queries (one per operator family of the survey's inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repolens.operators import files as FF
from repolens.oracle import fragments as O
from repolens.plans.registry import ORACLE, register

# --------------------------------------------------------------------------- files


@register("file_facts", lambda: f"""WITH {O.file_facts_cte()}
SELECT repo_id, path, size, kept, ext, is_test, is_test_cx, css_module, is_config, is_code, readable,
       lines, components, routes, complexity, functions FROM file_facts""")
def q_file_facts(spark, sf_dir):
    return FF.corpus_facts(spark, sf_dir).drop("manifest_text")


@register("repo_stats", lambda: f"""WITH {O.file_facts_cte()}, {O.repo_stats_cte()}
SELECT * FROM repo_stats""")
def q_repo_stats(spark, sf_dir):
    return FF.repo_stats(FF.corpus_facts(spark, sf_dir))


@register("files_by_extension", lambda: f"""WITH {O.file_facts_cte()}
SELECT repo_id, ext, CAST(count(*) AS BIGINT) AS file_count FROM file_facts WHERE kept GROUP BY repo_id, ext""")
def q_files_by_extension(spark, sf_dir):
    return FF.files_by_extension(FF.corpus_facts(spark, sf_dir))

# --------------------------------------------------------------------------- complexity
from repolens.operators import complexity as CX  # noqa: E402


@register("repo_complexity", lambda: f"""WITH {O.file_facts_cte()}, {O.complexity_cte()}
SELECT * FROM repo_complexity""")
def q_repo_complexity(spark, sf_dir):
    return CX.repo_complexity(FF.corpus_facts(spark, sf_dir))


@register("high_complexity_files", lambda: f"""WITH {O.file_facts_cte()}
SELECT repo_id, rank, path, complexity, functions FROM (
  SELECT repo_id, path, complexity, functions,
         CAST(row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, path) AS BIGINT) AS rank
  FROM file_facts WHERE readable AND NOT is_test_cx AND complexity > 15) WHERE rank <= 10""")
def q_high_complexity_files(spark, sf_dir):
    return CX.high_complexity_files(FF.corpus_facts(spark, sf_dir))


# --------------------------------------------------------------------------- stack
from repolens.operators import stack as ST  # noqa: E402
from repolens.oracle import stack_sql as OS  # noqa: E402


def stack_profile(spark, sf_dir):
    return ST.stack_profile(ST.repo_markers(FF.corpus_facts(spark, sf_dir)))


@register("stack_profile", lambda: f"""WITH {O.file_facts_cte()}, {OS.markers_cte()}, {OS.stack_cte()}
{OS.flat_stack_select()}""")
def q_stack_profile(spark, sf_dir):
    return ST.flatten_profile(stack_profile(spark, sf_dir))

# --------------------------------------------------------------------------- profile, architecture, rules
from repolens.operators import architecture as AR  # noqa: E402
from repolens.operators import profile as PR  # noqa: E402
from repolens.operators import rules as RU  # noqa: E402
from repolens.oracle import profile_sql as OP  # noqa: E402


def repo_profile(spark, sf_dir):
    """The profile, dealt by repository: what reads it (rules, reports, joins) is a stage with code of its own."""
    return PR.repo_profile(FF.corpus_facts(spark, sf_dir)).repartition("repo_id")


@register("architecture", lambda: f"""WITH {OP.profile_ctes()}, {OP.architecture_cte()}
SELECT * FROM architecture_flat""")
def q_architecture(spark, sf_dir):
    return AR.flatten_architecture(AR.architecture(repo_profile(spark, sf_dir)))


@register("rule_findings", lambda: f"""WITH {OP.profile_ctes()}, {OP.findings_cte()}
SELECT repo_id, rank, CAST(rule_ord AS INTEGER) AS rule_ord, rule_id, category, severity, current, suggested,
       reason, benefit, effort, priority, tags, evidence FROM findings""")
def q_rule_findings(spark, sf_dir):
    f = RU.rule_findings(RU.rule_results(repo_profile(spark, sf_dir)))
    return f.select(*[c for c in f.columns if c not in ("tags", "evidence")],
                    F.array_join("tags", ",").alias("tags"), F.array_join("evidence", "; ").alias("evidence"))


@register("rule_counts", lambda: f"""WITH {OP.profile_ctes()}, {OP.findings_cte()}
SELECT p.repo_id, CAST(count(f.rule_id) AS BIGINT) AS total_findings,
       CAST(count(*) FILTER (WHERE f.severity = 'critical') AS BIGINT) AS critical_count,
       CAST(count(*) FILTER (WHERE f.severity = 'warning') AS BIGINT) AS warning_count,
       CAST(count(*) FILTER (WHERE f.severity = 'info') AS BIGINT) AS info_count
FROM profile p LEFT JOIN findings f ON p.repo_id = f.repo_id GROUP BY p.repo_id""")
def q_rule_counts(spark, sf_dir):
    return RU.rule_results(repo_profile(spark, sf_dir)).drop("findings")


@register("rule_findings_text", lambda: f"""WITH {OP.profile_ctes()}, {OP.findings_cte()}
SELECT p.repo_id, coalesce(string_agg('[' || upper(f.severity) || '] ' || f.category || ': ' || f.current || ' -> '
         || f.suggested || chr(10) || 'Evidence: ' || f.evidence || chr(10) || 'Reason: ' || f.reason || chr(10)
         || 'Benefit: ' || f.benefit, chr(10) || chr(10) ORDER BY f.rank), '{RU.NO_FINDINGS_TEXT}') AS rule_text
FROM profile p LEFT JOIN findings f ON p.repo_id = f.repo_id GROUP BY p.repo_id""")
def q_rule_findings_text(spark, sf_dir):
    return RU.findings_text(RU.rule_results(repo_profile(spark, sf_dir)))


def repo_health(profile):
    """Flagship: per repository size, complexity, architecture and rule counts.

    Architecture and rule counts are column expressions over the same profile
    row: one scan, one projection, no join.
    """
    patterns = AR.architecture_columns()["patterns"]
    df = profile.select("repo_id", "language", "project_type", "file_count", "line_count",
                        "average_complexity", "max_complexity", "duplication_risk",
                        F.array_join(patterns, ", ").alias("patterns"), RU.findings_array().alias("findings"))
    return RU.with_counts(df).drop("findings")


@register("repo_health", lambda: f"""WITH {OP.profile_ctes()}, {OP.architecture_cte()}, {OP.findings_cte()},
counts AS (
  SELECT p.repo_id, CAST(count(f.rule_id) AS BIGINT) AS total_findings,
         CAST(count(*) FILTER (WHERE f.severity = 'critical') AS BIGINT) AS critical_count,
         CAST(count(*) FILTER (WHERE f.severity = 'warning') AS BIGINT) AS warning_count,
         CAST(count(*) FILTER (WHERE f.severity = 'info') AS BIGINT) AS info_count
  FROM profile p LEFT JOIN findings f ON p.repo_id = f.repo_id GROUP BY p.repo_id)
SELECT p.repo_id, p.language, p.project_type, p.file_count, p.line_count, p.average_complexity,
       p.max_complexity, p.duplication_risk, a.patterns, c.total_findings, c.critical_count, c.warning_count,
       c.info_count
FROM profile p JOIN architecture_flat a ON p.repo_id = a.repo_id JOIN counts c ON p.repo_id = c.repo_id""")
def q_repo_health(spark, sf_dir):
    return repo_health(repo_profile(spark, sf_dir))

# --------------------------------------------------------------------------- security text
from repolens.functions import text as TX  # noqa: E402
from repolens.operators import secrets as SC  # noqa: E402
from repolens.oracle import security_sql as OSEC  # noqa: E402
from repolens.sources.corpus import repo_files, repo_ids  # noqa: E402
from repolens.sources.tables import read_table  # noqa: E402


@register("scan_secrets", lambda: f"""WITH {O.file_facts_cte()}, {OSEC.secrets_cte()}
SELECT repo_id, path, line, type, severity, match FROM secret_findings""")
def q_scan_secrets(spark, sf_dir):
    return SC.scan_secrets(repo_files(spark, sf_dir)).drop("pattern_ord")


@register("scan_pages", lambda: f"""WITH page_lines AS (
  SELECT page_id, CAST(generate_subscripts(string_split(html, chr(10)), 1) AS INTEGER) AS line,
         unnest(string_split(html, chr(10))) AS text FROM pages),
hits AS ({OSEC.line_hits('page_lines', 'page_id, line')})
SELECT page_id, line, type, severity, match FROM hits""")
def q_scan_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    lines = pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line")) \
        .select("page_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")
    return SC.line_findings(lines).withColumnRenamed("line_no", "line").drop("pattern_ord")


# Two of three turns quote a credential: a key or a header of the text's own digest.
_QUOTED = """text || CASE turn % 3 WHEN 0 THEN ' (key sk-' || md5(text) || ')' WHEN 1 THEN ' Authorization: Bearer ' || md5(text) ELSE '' END"""


@register("scrub_conversations", lambda: f"""WITH c AS (SELECT conv_id, turn, {_QUOTED} AS said FROM conversations)
SELECT conv_id, turn, {TX.sql_scrub('said')} AS scrubbed, {TX.sql_scrub('said')} <> said AS changed FROM c""")
def q_scrub_conversations(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).withColumn("said", F.expr(_QUOTED))
    scrubbed = TX.scrub_secrets(F.col("said"))
    return conv.select("conv_id", "turn", scrubbed.alias("scrubbed"), (scrubbed != F.col("said")).alias("changed"))


TOKEN_VALUE = r'token = "([0-9a-f]{40})"'


@register("mask_tokens", lambda: f"""SELECT doc_id, CAST(generate_subscripts(regexp_extract_all(text, {TX.sql_str(TOKEN_VALUE)}, 1), 1) AS INTEGER) AS ord,
  {TX.sql_mask('unnest(regexp_extract_all(text, ' + TX.sql_str(TOKEN_VALUE) + ', 1))')} AS masked
FROM documents WHERE regexp_matches(text, {TX.sql_str(TOKEN_VALUE)})""")
def q_mask_tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = docs.where(F.col("text").rlike(TOKEN_VALUE)).select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_VALUE), 1)).alias("pos", "tok"))
    return found.select("doc_id", (F.col("pos") + 1).cast("int").alias("ord"), TX.mask_secret(F.col("tok")).alias("masked"))


@register("validate_targets", lambda: f"""SELECT page_id, url, {OSEC.target_verdict_sql('url')} AS reason,
  ({OSEC.target_verdict_sql('url')}) IS NULL AS valid FROM pages""")
def q_validate_targets(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    verdict = SC.target_verdict(F.col("url"))
    return pages.select("page_id", "url", verdict.alias("reason"), verdict.isNull().alias("valid"))


@register("non_http_projects", lambda: f"""WITH {OP.profile_ctes()}
SELECT repo_id, project_type, (project_type IN ({', '.join(TX.sql_str(t) for t in SC.NON_HTTP_TYPES)})
  OR regexp_matches(project_type, {TX.sql_str(SC.NON_HTTP_RE)})) AS non_http FROM stack""")
def q_non_http_projects(spark, sf_dir):
    prof = stack_profile(spark, sf_dir)
    return prof.select("repo_id", "project_type", SC.is_non_http(F.col("project_type")).alias("non_http"))

# --------------------------------------------------------------------------- dependency audit
from repolens.operators import audit as AU  # noqa: E402,F811

_AUDIT_BASE = """audit_base AS (
  SELECT l_orderkey AS repo_id, l_linenumber, l_returnflag, l_partkey, p_name,
         CASE l_linenumber % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate'
              WHEN 3 THEN 'low' WHEN 4 THEN 'info' END AS sev,
         CASE WHEN l_orderkey % 7 <> 0 AND l_orderkey % 5 = 0 THEN 'v6' ELSE 'v7' END AS format,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS INTEGER) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 11 <> 0)"""


@register("audit_rollup", lambda: f"""WITH {_AUDIT_BASE}
SELECT repo_id, CAST(count(*) FILTER (WHERE sev = 'critical') AS BIGINT) AS critical,
  CAST(count(*) FILTER (WHERE sev = 'high') AS BIGINT) AS high,
  CAST(count(*) FILTER (WHERE sev = 'moderate') AS BIGINT) AS moderate,
  CAST(count(*) FILTER (WHERE sev IS NULL OR sev NOT IN ('critical', 'high', 'moderate')) AS BIGINT) AS low,
  CAST(count(*) AS BIGINT) AS total
FROM audit_base GROUP BY repo_id""")
def q_audit_rollup(spark, sf_dir):
    return AU.audit_rollup(AU.parse_audit(AU.derive_audit_reports(spark, sf_dir)))


@register("audit_advisories", lambda: f"""WITH {_AUDIT_BASE}
SELECT repo_id, pos,
  CASE WHEN format = 'v6' THEN p_name ELSE p_name || '#' || pos END AS name,
  coalesce(sev, 'low') AS severity,
  CASE WHEN format = 'v6' OR l_returnflag = 'R' THEN 'Advisory for ' || p_name ELSE p_name || '#' || pos END AS title,
  CASE WHEN format = 'v6' OR l_returnflag = 'R' THEN '{AU.ADVISORY_URL}' || l_partkey ELSE '' END AS url
FROM audit_base WHERE format = 'v6' OR l_returnflag IN ('R', 'N')""")
def q_audit_advisories(spark, sf_dir):
    return AU.audit_advisories(AU.parse_audit(AU.derive_audit_reports(spark, sf_dir)))

# --------------------------------------------------------------------------- long form and quarantine
from repolens.operators import catalog as CAT  # noqa: E402
from repolens.session import checkpointed, ensure_checkpoint_dir  # noqa: E402
from repolens.sources import quarantine as QN  # noqa: E402


def _sql_rows(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, (bool, int)) else TX.sql_str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# An order stands for a repository, its parts for dependencies: two of three parts have a name of the catalogue.
_NAMES = [r[3] for r in CAT.node_catalog_rows()]
_DETECT_SQL = f"""catalog(ord, facet, label, dependency, dev_only, suppressed_by) AS (VALUES {_sql_rows(CAT.node_catalog_rows())}),
hits AS (SELECT DISTINCT d.repo_id, c.facet, c.ord, c.label, c.suppressed_by FROM deps d JOIN catalog c USING (dependency) WHERE d.dev OR NOT c.dev_only)
SELECT repo_id, facet, ord, label FROM hits h
WHERE NOT EXISTS (SELECT 1 FROM deps d WHERE d.repo_id = h.repo_id AND d.dependency = h.suppressed_by)"""


@register("dependency_stack", lambda: f"""WITH deps AS (
  SELECT l_orderkey AS repo_id, l_returnflag = 'R' AS dev,
    CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ([{', '.join(TX.sql_str(n) for n in _NAMES)}])[p_partkey % {len(_NAMES)} + 1] END AS dependency
  FROM lineitem JOIN part ON p_partkey = l_partkey), {_DETECT_SQL}""")
def q_dependency_stack(spark, sf_dir):
    """D1-D8 over a dependency inventory (``lineitem`` x ``part``) with the catalogue as a table."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag"])
    parts = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
        F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")))
    deps = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("repo_id"), name.alias("dependency"), (F.col("l_returnflag") == "R").alias("dev"))
    return CAT.detect(deps, CAT.node_catalog(spark))


@register("quarantine_audits", lambda: f"""SELECT CASE WHEN l_orderkey % {AU.BROKEN_EVERY} = 0 THEN 'rejected' ELSE 'accepted' END AS sink,
  CASE WHEN l_orderkey % {AU.BROKEN_EVERY} = 0 THEN 'unparsable' END AS reject_reason, count(DISTINCT l_orderkey) AS reports
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def q_quarantine_audits(spark, sf_dir):
    """A2: audit reports written to an accepted and a rejected sink, read back."""
    reports = AU.derive_audit_reports(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    QN.quarantine(reports, F.when(F.try_parse_json("audit_json").isNull(), F.lit("unparsable")), path)
    sinks = [QN.read(spark, path, s, reports.schema).select(F.lit(s).alias("sink"), "reject_reason") for s in (QN.ACCEPTED, QN.REJECTED)]
    return sinks[0].unionByName(sinks[1]).groupBy("sink", "reject_reason").agg(F.count("*").alias("reports"))


# --------------------------------------------------------------------------- request log replay
from repolens.operators import quota as QU  # noqa: E402
from repolens.oracle import quota_sql as OQ  # noqa: E402
from repolens.sources import request_log as RLOG  # noqa: E402

# Test limits: the driver's request rates never reach the production limits
# (at most 10 requests per user-day), so the registered replays use tight ones.
GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY = 21_600, 2, 3
FW_RPM, FW_RPD = 1, 20


@register("request_gate", lambda: "WITH RECURSIVE " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY)
          + "\nSELECT event_id, status, reason, retry_after FROM gate")
def q_request_gate(spark, sf_dir):
    return QU.request_gate(RLOG.request_log(spark, sf_dir), RLOG.token_states(spark, sf_dir),
                           window_s=GATE_WINDOW_S, limit=GATE_LIMIT, daily=GATE_DAILY)


def _tight_limits(spark):
    return RLOG.model_limits(spark, [(m, lbl, FW_RPM, FW_RPD) for m, lbl, _, _ in RLOG.MODEL_LIMITS])


@register("fixed_window_quota", lambda: "WITH " + OQ.fixed_window_sql(FW_RPM, FW_RPD)
          + "\nSELECT event_id, model, allowed, reason, retry_after_ms FROM fixed_window")
def q_fixed_window_quota(spark, sf_dir):
    return QU.fixed_window_quota(RLOG.request_log(spark, sf_dir), _tight_limits(spark), (None, FW_RPM, FW_RPD))


@register("ttl_cache_replay", lambda: "WITH RECURSIVE " + OQ.cache_sql() + "\nSELECT event_id, key, hit FROM cache_replay")
def q_ttl_cache_replay(spark, sf_dir):
    return QU.ttl_cache_replay(RLOG.cache_lookups(RLOG.request_log(spark, sf_dir)))


def _gate(spark, sf_dir):
    return QU.gate_stages(RLOG.request_log(spark, sf_dir), RLOG.token_states(spark, sf_dir),
                          window_s=GATE_WINDOW_S, limit=GATE_LIMIT, daily=GATE_DAILY)


@register("sliding_window_limit", lambda: "WITH RECURSIVE " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY)
          + "\nSELECT event_id, slide_ok, CAST(slide_retry AS BIGINT) AS slide_retry FROM quota")
def q_sliding_window_limit(spark, sf_dir):
    return _gate(spark, sf_dir).where(F.col("slide_ok").isNotNull()).select(
        "event_id", "slide_ok", F.col("slide_retry").cast("bigint").alias("slide_retry"))


@register("daily_token_quota", lambda: "WITH RECURSIVE " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY)
          + "\nSELECT event_id, daily_ok, CAST(daily_retry AS BIGINT) AS daily_retry FROM quota WHERE slide_ok")
def q_daily_token_quota(spark, sf_dir):
    return _gate(spark, sf_dir).where(F.col("slide_ok")).select("event_id", "daily_ok", "daily_retry")


@register("token_binding", lambda: "WITH " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY).split(",\nlimited AS")[0]
          + "\nSELECT event_id, bearer_token AS token, auth_reason IS NULL AS auth_ok, auth_reason FROM g4 WHERE pre_status IS NULL")
def q_token_binding(spark, sf_dir):
    return _gate(spark, sf_dir).where(F.col("pre_status").isNull()).select(
        "event_id", F.col("bearer_token").alias("token"), F.col("auth_reason").isNull().alias("auth_ok"), "auth_reason")


@register("version_gate", lambda: f"""WITH {RLOG.request_log_cte()}
SELECT event_id, version, {OQ.version_ok_sql('version')} AS version_ok FROM request_log""")
def q_version_gate(spark, sf_dir):
    log = RLOG.request_log(spark, sf_dir)
    return log.select("event_id", "version", QU.version_at_least(F.col("version")).alias("version_ok"))


@register("clock_skew_filter", lambda: "WITH " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY).split(",\ng2 AS")[0]
          + "\nSELECT event_id, client_ts, parsed_ts, sig_reason FROM g1")
def q_clock_skew_filter(spark, sf_dir):
    log = RLOG.request_log(spark, sf_dir)
    return log.select("event_id", "client_ts", QU.parse_client_ts(F.col("client_ts")).alias("parsed_ts"),
                      QU.clock_skew_reason(F.col("client_ts"), F.col("signature"), F.col("sec"), F.col("sig_ok"))
                      .alias("sig_reason"))


@register("allowed_model_filter", lambda: f"""WITH {RLOG.request_log_cte()}
SELECT event_id, model, model <> '' AND model IN ({', '.join(TX.sql_str(m) for m in QU.allowed_models())}) AS allowed
FROM request_log""")
def q_allowed_model_filter(spark, sf_dir):
    log = RLOG.request_log(spark, sf_dir)
    allowed = QU.allowed_models()
    return log.select("event_id", "model", ((F.col("model") != "") & F.col("model").isin(*allowed)).alias("allowed"))


def _limits_values():
    return ", ".join(f"({TX.sql_str(m)}, {TX.sql_str(lbl)}, {rpm}, {rpd})" for m, lbl, rpm, rpd in RLOG.MODEL_LIMITS)


@register("quota_usage", lambda: f"""WITH {RLOG.request_log_cte()},
limits(model, label, rpm, rpd) AS (VALUES {_limits_values()}),
fw AS (SELECT r.event_id, r.ts, r.ts_ms, r.model, r.ts_ms - r.ts_ms % 60000 AS minute, r.ts_ms - r.ts_ms % 86400000 AS day,
              coalesce(l.rpm, {RLOG.DEFAULT_LIMITS[1]}) AS rpm, coalesce(l.rpd, {RLOG.DEFAULT_LIMITS[2]}) AS rpd
       FROM request_log r LEFT JOIN limits l ON l.model = r.model),
per_min AS (SELECT model, day, minute, any_value(rpm) AS rpm, any_value(rpd) AS rpd, count(*) AS n FROM fw GROUP BY model, day, minute),
caps AS (SELECT model, minute, greatest(0, least(rpm, rpd - least(rpd, coalesce(sum(least(n, rpm)) OVER (
    PARTITION BY model, day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS cap FROM per_min),
allowed AS (SELECT f.event_id, f.model, f.ts_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY model, minute ORDER BY ts, event_id) AS r FROM fw) f
  JOIN caps c ON c.model = f.model AND c.minute = f.minute WHERE r <= cap),
nowt AS (SELECT max(ts_ms) AS now, max(ts_ms) - max(ts_ms) % 60000 AS m0, max(ts_ms) - max(ts_ms) % 86400000 AS d0 FROM request_log),
usage AS (SELECT a.model, count(*) FILTER (WHERE ts_ms >= m0 AND ts_ms <= now) AS minute_used,
                 count(*) FILTER (WHERE ts_ms >= d0 AND ts_ms <= now) AS day_used FROM allowed a, nowt GROUP BY a.model)
SELECT l.model, l.label, CAST(coalesce(minute_used, 0) AS BIGINT) AS minute_used, CAST(l.rpm AS BIGINT) AS minute_limit,
  CAST(coalesce(day_used, 0) AS BIGINT) AS day_used, CAST(l.rpd AS BIGINT) AS day_limit,
  CASE WHEN coalesce(minute_used, 0) / l.rpm >= 1 THEN 'limit' WHEN coalesce(minute_used, 0) / l.rpm >= 0.8 THEN 'warning' ELSE 'ok' END AS minute_status,
  CASE WHEN coalesce(day_used, 0) / l.rpd >= 1 THEN 'limit' WHEN coalesce(day_used, 0) / l.rpd >= 0.8 THEN 'warning' ELSE 'ok' END AS day_status
FROM limits l LEFT JOIN usage u ON u.model = l.model""")
def q_quota_usage(spark, sf_dir):
    log = RLOG.request_log(spark, sf_dir)
    limits = RLOG.model_limits(spark)
    return QU.quota_usage(log, limits)


_REGISTRATIONS = f"""WITH RECURSIVE {RLOG.request_log_cte()},
a AS (SELECT event_id, ts, ip, machine_id, ts_ms // 86400000 AS day,
             user_agent LIKE '%Mozilla/%' OR user_agent LIKE '%Chrome/%' OR user_agent LIKE '%Safari/%' OR user_agent LIKE '%Firefox/%' AS browser,
             regexp_full_match(machine_id, '[0-9a-f]{{64}}') AS fine FROM request_log),
firsts AS (SELECT ip, day, machine_id, min({{'t': ts, 'e': event_id}}) AS f FROM a WHERE fine AND NOT browser GROUP BY ip, day, machine_id),
o AS (SELECT *, row_number() OVER (ORDER BY f) AS rn, dense_rank() OVER (ORDER BY machine_id) AS m, dense_rank() OVER (ORDER BY ip, day) AS g FROM firsts),
fold AS (
  SELECT rn, TRUE AS ok, [m] AS known, [g] AS used FROM o WHERE rn = 1
  UNION ALL
  SELECT rn, ok, CASE WHEN ok THEN list_append(known, m) ELSE known END, CASE WHEN ok THEN list_append(used, g) ELSE used END
  FROM (SELECT o.rn, o.m, o.g, p.known, p.used, NOT list_contains(p.known, o.m) AND len(list_filter(p.used, lambda x: x = o.g)) < 3 AS ok
        FROM fold p JOIN o ON o.rn = p.rn + 1)),
grants AS (SELECT machine_id, f FROM o JOIN fold USING (rn) WHERE ok)
SELECT a.event_id, a.ip, a.machine_id, CAST(CASE WHEN browser THEN 403 WHEN NOT fine THEN 400
  WHEN {{'t': ts, 'e': event_id}} = f THEN 201 WHEN {{'t': ts, 'e': event_id}} > f THEN 200 ELSE 429 END AS INTEGER) AS status
FROM a LEFT JOIN grants USING (machine_id)"""


@register("registration_limit", lambda: _REGISTRATIONS)
def q_registration_limit(spark, sf_dir):
    """Every request of the log as a registration attempt of its machine."""
    return QU.registration_limit(RLOG.request_log(spark, sf_dir))

# --------------------------------------------------------------------------- AI batch tables
from repolens.operators import ai as AI  # noqa: E402
from repolens.operators import normalise as NO  # noqa: E402
from repolens.operators import store as STORE  # noqa: E402


def _summary_sql() -> str:
    def listed(c):
        return f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE '{AI.NONE_DETECTED}' END"
    parts = ["'PROJECT TYPE: ' || project_type", "''", "'FRONTEND'", listed("frontend"), "''",
             "'BACKEND'", listed("backend"), "''", "'DATABASE'", listed("databases"), "''",
             "'STYLING'", listed("styling"), "''", "'LANGUAGE'", "language", "''",
             "'PACKAGE MANAGER'", "coalesce(nullif(package_manager, ''), 'Unknown')", "''",
             "'API ROUTES'", "CAST(api_route_count AS VARCHAR)", "''",
             "'COMPONENT COUNT'", "CAST(component_count AS VARCHAR)", "''",
             "'FILE COUNT'", "CAST(file_count AS VARCHAR)", "''",
             "'DEPENDENCIES'", f"array_to_string(list_slice(dependencies, 1, {AI.SUMMARY_DEPS}), ' ')", "''",
             "'DEV DEPENDENCIES'", f"array_to_string(list_slice(dev_dependencies, 1, {AI.SUMMARY_DEV_DEPS}), ' ')"]
    return f"summaries AS (SELECT repo_id, concat_ws(chr(10), {', '.join(parts)}) AS summary FROM profile)"


def _summaries(spark, sf_dir):
    prof = repo_profile(spark, sf_dir)
    return prof, AI.project_summary(prof)


@register("project_summary", lambda: f"""WITH {OP.profile_ctes()}, {_summary_sql()}
SELECT repo_id, summary FROM summaries""")
def q_project_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)[1]


@register("summary_cache_key", lambda: f"""WITH {OP.profile_ctes()}, {_summary_sql()},
k AS (SELECT repo_id, substr(sha256(summary), 1, 16) AS summary_hash,
             'analysis:moonshotai/kimi-k2-instruct:' || substr(sha256(summary), 1, 16) AS cache_key FROM summaries)
SELECT repo_id, summary_hash, cache_key, substr(sha256(cache_key), 1, 16) AS cache_file FROM k""")
def q_summary_cache_key(spark, sf_dir):
    s = _summaries(spark, sf_dir)[1]
    key = AI.cache_key("analysis", AI.ANALYSIS_MODEL, F.col("summary"))
    return s.select("repo_id", AI.summary_hash(F.col("summary")).alias("summary_hash"), key.alias("cache_key"),
                    AI.cache_file_key(key).alias("cache_file"))


@register("analysis_requests", lambda: f"""WITH {OP.profile_ctes()}, {_summary_sql()}, {OP.architecture_cte()}
SELECT p.repo_id, 'analysis' AS kind, 'moonshotai/kimi-k2-instruct' AS model,
  'analysis:moonshotai/kimi-k2-instruct:' || substr(sha256(s.summary), 1, 16) AS cache_key,
  concat_ws(chr(10), 'PROJECT CONTEXT (pre-detected):', '- Project Type: ' || p.project_type,
    '- TypeScript Detected: ' || CASE WHEN p.has_typescript THEN 'YES' ELSE 'NO' END,
    '- Test Files Found: ' || p.test_file_count,
    '- Architecture Patterns: ' || coalesce(nullif(a.patterns, ''), 'unknown'))
  || chr(10) || chr(10) || 'Analyse this project summary and answer with JSON only:' || chr(10) || chr(10) || s.summary AS prompt
FROM profile p JOIN summaries s ON s.repo_id = p.repo_id LEFT JOIN architecture_flat a ON a.repo_id = p.repo_id""")
def q_analysis_requests(spark, sf_dir):
    prof, summ = _summaries(spark, sf_dir)
    pats = AR.architecture(prof).select("repo_id", F.array_join("patterns", ", ").alias("patterns"))
    return AI.analysis_requests(prof, summ, pats)


def _responses(spark, sf_dir):
    """The recorded responses, written once as a recorded table would be."""
    return checkpointed(AI.derive_ai_responses(spark, sf_dir))


@register("reasoning_requests")
def q_reasoning_requests(spark, sf_dir):
    prof, summ = _summaries(spark, sf_dir)
    analysis = AI.accepted(_responses(spark, sf_dir), "analysis").select("repo_id", "scan_id", AI.normalize_analysis(F.col("content")).alias("a"))
    analysis = analysis.select("repo_id", "scan_id", F.to_json("a").alias("analysis_json"), F.col("a.projectContext").alias("project_context"))
    text = RU.findings_text(RU.rule_results(prof))
    return AI.reasoning_requests(prof, summ, analysis, text)


@register("security_requests")
def q_security_requests(spark, sf_dir):
    store = STORE.persist(repo_files(spark, sf_dir))
    summ = AI.project_summary(store.profile)
    # the audit runs only where a root package-lock.json exists (A2)
    with_lock = checkpointed(ST.repo_markers(store.files).where(F.col(ST.marker_col("package-lock.json"))).select("repo_id"))
    audit = AU.audit_rollup(AU.parse_audit(AU.derive_audit_reports(spark, sf_dir, with_lock)))
    secrets = store.secrets.groupBy("repo_id").agg(F.count(F.lit(1)).alias("secret_findings"))
    top = CX.high_complexity_files(store.files, 5).groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("top_files"))
    return AI.security_requests(store.profile, summ, audit, secrets, top, SC.is_non_http(F.col("project_type")))


@register("deployment_requests", lambda: f"""WITH {OP.profile_ctes()}, {_summary_sql()}
SELECT p.repo_id, 'deployment' AS kind, 'moonshotai/kimi-k2-instruct' AS model,
  'deployment:moonshotai/kimi-k2-instruct:' || substr(sha256(s.summary), 1, 16) AS cache_key,
  concat_ws(chr(10), '- Project Type: ' || p.project_type,
    '- Docker: ' || CASE WHEN p.has_docker THEN 'YES' ELSE 'NO' END,
    '- CI/CD: ' || CASE WHEN p.has_ci THEN 'YES' ELSE 'NO' END,
    '- Files: ' || p.file_count, '- Test Files Found: ' || p.test_file_count,
    CASE WHEN p.project_type IN ({', '.join(TX.sql_str(t) for t in SC.NON_HTTP_TYPES)})
          OR regexp_matches(p.project_type, {TX.sql_str(SC.NON_HTTP_RE)}) THEN 'THIS PROJECT IS NOT A SERVER.' END,
    '', s.summary) AS prompt
FROM profile p JOIN summaries s ON s.repo_id = p.repo_id""")
def q_deployment_requests(spark, sf_dir):
    prof, summ = _summaries(spark, sf_dir)
    return AI.deployment_requests(prof, summ, SC.is_non_http(F.col("project_type")))


@register("scan_ai_responses")
def q_scan_ai_responses(spark, sf_dir):
    return AI.scan_ai_responses(_responses(spark, sf_dir), repo_ids(spark, sf_dir))


@register("normalize_analysis")
def q_normalize_analysis(spark, sf_dir):
    a = AI.accepted(_responses(spark, sf_dir), "analysis").select("repo_id", "scan_id", AI.normalize_analysis(F.col("content")).alias("a"))
    lists = [F.array_join(f"a.{k}", ", ").alias(k) for k in NO.ANALYSIS_LISTS]
    return a.select("repo_id", "scan_id", *lists, *[F.col(f"a.{k}").alias(k) for k in NO.ANALYSIS_TEXTS])


@register("normalize_suggestions")
def q_normalize_suggestions(spark, sf_dir):
    r = AI.accepted(_responses(spark, sf_dir), "reasoning").select("repo_id", "scan_id", AI.normalize_reasoning(F.col("content")).alias("r"))
    return r.select("repo_id", "scan_id", F.posexplode("r.suggestions").alias("pos", "s")).select("repo_id", "scan_id", "pos", "s.*")


@register("normalize_scores")
def q_normalize_scores(spark, sf_dir):
    r = AI.accepted(_responses(spark, sf_dir), "reasoning").select("repo_id", "scan_id", AI.normalize_reasoning(F.col("content")).alias("r"))
    return r.select("repo_id", "scan_id", *[F.col(f"r.scores.{side}.{d}").alias(f"{side}_{d}")
                                 for side in ("current", "optimized") for d in AI.SCORE_DIMENSIONS])


@register("normalize_security")
def q_normalize_security(spark, sf_dir):
    r = AI.accepted(_responses(spark, sf_dir), "security").select("repo_id", "scan_id", AI.normalize_security(F.col("content")).alias("s"))
    return r.select("repo_id", "scan_id", F.col("s.score").alias("score"), F.array_join("s.strengths", ", ").alias("strengths"),
                    F.col("s.summary").alias("summary"), F.posexplode_outer("s.findings").alias("pos", "f")) \
        .select("repo_id", "scan_id", "score", "strengths", "summary", "pos", "f.*")


@register("normalize_deployment")
def q_normalize_deployment(spark, sf_dir):
    r = AI.accepted(_responses(spark, sf_dir), "deployment").select("repo_id", "scan_id", AI.normalize_deployment(F.col("content")).alias("d"))
    return r.select("repo_id", "scan_id", F.col("d.score").alias("score"), F.array_join("d.strengths", ", ").alias("strengths"),
                    F.col("d.summary").alias("summary"), F.posexplode_outer("d.recommendations").alias("pos", "f")) \
        .select("repo_id", "scan_id", "score", "strengths", "summary", "pos", "f.*")


@register("ai_severity_counts")
def q_ai_severity_counts(spark, sf_dir):
    resp = _responses(spark, sf_dir)
    sec = AI.accepted(resp, "security").select("repo_id", "scan_id", AI.normalize_security(F.col("content")).alias("s"))
    dep = AI.accepted(resp, "deployment").select("repo_id", "scan_id", AI.normalize_deployment(F.col("content")).alias("d"))
    return (sec.select("repo_id", "scan_id", *AI.severity_counts(F.col("s.findings"), "severity", AI.SECURITY_SEVERITIES))
            .join(dep.select("repo_id", "scan_id", *AI.severity_counts(F.col("d.recommendations"), "priority", AI.DEPLOY_PRIORITIES)),
                  ["repo_id", "scan_id"], "full"))


@register("merge_suggestions")
def q_merge_suggestions(spark, sf_dir):
    res = RU.rule_results(repo_profile(spark, sf_dir))
    m = AI.merged_suggestions(res, _responses(spark, sf_dir))
    return m.select("repo_id", "scan_id", F.posexplode("merged").alias("pos", "m")).select(
        "repo_id", "scan_id", (F.col("pos") + 1).alias("rank"), "m.id", "m.source", "m.category", "m.current", "m.suggested",
        "m.priority", "m.effort")


@register("score_delta")
def q_score_delta(spark, sf_dir):
    r = AI.accepted(_responses(spark, sf_dir), "reasoning").select("repo_id", "scan_id", AI.normalize_reasoning(F.col("content")).alias("r"))
    return r.select("repo_id", "scan_id", F.explode(AI.score_delta(F.col("r"))).alias("d")).select("repo_id", "scan_id", "d.*")

# --------------------------------------------------------------------------- reports
from repolens.operators import audit_log as AL  # noqa: E402
from repolens.operators import report as RP  # noqa: E402


def _compare_sql() -> str:
    def listed(c):
        return f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE 'None' END"

    def yes(c):
        return f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END"
    vals = [("Language", "language"), ("Project Type", "project_type"), ("Frontend", listed("frontend")),
            ("Backend", listed("backend")), ("Database", listed("databases")), ("Styling", listed("styling")),
            ("TypeScript", yes("has_typescript")), ("Docker", yes("has_docker")), ("CI/CD", yes("has_ci")),
            ("Files", "CAST(file_count AS VARCHAR)"), ("Lines of Code", "format('{:,}', line_count)"),
            ("Components", "CAST(component_count AS VARCHAR)"), ("API Routes", "CAST(api_route_count AS VARCHAR)"),
            ("Test Files", "CAST(test_file_count AS VARCHAR)")]
    unions = " UNION ALL ".join(f"SELECT repo_id, {i} AS ord, '{a}' AS attribute, {v} AS value FROM profile"
                                for i, (a, v) in enumerate(vals))
    return f"""vals AS ({unions}),
pairs AS (SELECT p.repo_id AS repo_a, p.repo_id + 1 AS repo_b FROM profile p
          WHERE p.repo_id % 2 = 0 AND EXISTS (SELECT 1 FROM profile q WHERE q.repo_id = p.repo_id + 1))"""


@register("compare_repos", lambda: f"""WITH {OP.profile_ctes()}, {_compare_sql()}
SELECT repo_a, repo_b, a.ord, a.attribute, a.value AS value_a, b.value AS value_b, a.value <> b.value AS differs
FROM pairs JOIN vals a ON a.repo_id = repo_a JOIN vals b ON b.repo_id = repo_b AND b.ord = a.ord""")
def q_compare_repos(spark, sf_dir):
    prof = repo_profile(spark, sf_dir)
    return RP.compare_repos(prof, RP.adjacent_pairs(prof.select("repo_id")))


@register("report_top_n", lambda: f"""WITH {O.file_facts_cte()}, {OSEC.secrets_cte()}, {_AUDIT_BASE},
s AS (SELECT repo_id, printf('%s (%s) %s:%d %s', type, severity, path, line, match) AS item,
             row_number() OVER (PARTITION BY repo_id ORDER BY path, line, pattern_ord) AS rank,
             count(*) OVER (PARTITION BY repo_id) AS n FROM secret_findings),
c AS (SELECT repo_id, printf('%s complexity: %d', path, complexity) AS item,
             row_number() OVER (PARTITION BY repo_id ORDER BY complexity DESC, path) AS rank,
             count(*) OVER (PARTITION BY repo_id) AS n
      FROM file_facts WHERE readable AND NOT is_test_cx AND complexity > 15),
adv AS (SELECT repo_id, pos, CASE WHEN format = 'v6' THEN p_name ELSE p_name || '#' || pos END AS name,
               coalesce(sev, 'low') AS severity,
               CASE WHEN format = 'v6' OR l_returnflag = 'R' THEN 'Advisory for ' || p_name ELSE p_name || '#' || pos END AS title
        FROM audit_base WHERE format = 'v6' OR l_returnflag IN ('R', 'N')),
a AS (SELECT repo_id, printf('%s (%s): %s', name, severity, title) AS item,
             row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY repo_id) AS n FROM adv)
SELECT 'secrets' AS section, CAST(repo_id AS BIGINT) AS repo_id, CAST(rank AS BIGINT) AS rank, item,
       CAST(greatest(n - 20, 0) AS BIGINT) AS overflow FROM s WHERE rank <= 20
UNION ALL SELECT 'complex_files', repo_id, rank, item, greatest(n - 10, 0) FROM c WHERE rank <= 10
UNION ALL SELECT 'advisories', repo_id, rank, item, greatest(n - 10, 0) FROM a WHERE rank <= 10""")
def q_report_top_n(spark, sf_dir):
    files = repo_files(spark, sf_dir)
    secrets = SC.scan_secrets(files)
    facts = FF.file_facts(files)
    cx = CX.analysed(facts).where(~F.col("is_test_cx") & (F.col("complexity") > CX.HIGH_COMPLEXITY))
    adv = AU.audit_advisories(AU.parse_audit(AU.derive_audit_reports(spark, sf_dir)))
    return RP.report_top_n(secrets, cx, adv)


REPORT_TIME = "2024-01-31T00:00:00.000Z"  # after the last event of the tables


def _report(spark, sf_dir):
    """The whole report of every repository, before its mode is applied."""
    store, responses = STORE.persist(repo_files(spark, sf_dir)), _responses(spark, sf_dir)
    facts, prof = store.files, store.profile
    with_lock = checkpointed(ST.repo_markers(facts).where(F.col(ST.marker_col("package-lock.json"))).select("repo_id"))
    audit = checkpointed(AU.parse_audit(AU.derive_audit_reports(spark, sf_dir, with_lock)))
    parts = RP.report_parts(FF.files_by_extension_map(facts), AU.audit_rollup(audit), AU.audit_advisories(audit), store.secrets,
                            store.scanned(), CX.high_complexity_files(facts, 10))
    res = checkpointed(RU.rule_results(prof))
    ai = {k: AI.accepted(responses, k).select("repo_id", "scan_id", f(F.col("content")).alias(k)) for k, f in (
        ("reasoning", AI.normalize_reasoning), ("security", AI.normalize_security), ("deployment", AI.normalize_deployment))}
    merged = AI.merged_suggestions(res, responses)
    return RP.repo_report(prof, parts, res, merged, ai, REPORT_TIME)


@register("repo_report")
def q_repo_report(spark, sf_dir):
    return RP.report_json(RP.for_mode(_report(spark, sf_dir), "codebase")).drop("mode")


@register("mode_projection")
def q_mode_projection(spark, sf_dir):
    """Every report in every mode, contents and all."""
    return RP.report_json(RP.all_modes(_report(spark, sf_dir)))


@register("report_markdown")
def q_report_markdown(spark, sf_dir):
    return RP.report_markdown(RP.for_mode(_report(spark, sf_dir), "codebase"))

# --------------------------------------------------------------------------- streaming twins
from repolens.streaming import gate as GATE  # noqa: E402
from repolens.streaming import replay as STR  # noqa: E402


@register("sliding_window_stream", lambda: f"""WITH RECURSIVE {RLOG.request_log_cte()},
limited AS (SELECT event_id, token, sec, ts, ts_ms FROM request_log),
{OQ.slide_ctes(GATE_WINDOW_S, GATE_LIMIT)}
SELECT l.event_id, l.token, r <= adm AS slide_ok, CAST(CASE WHEN r > adm THEN retry END AS BIGINT) AS slide_retry
FROM (SELECT *, row_number() OVER (PARTITION BY token, sec ORDER BY ts, event_id) AS r FROM limited) l
JOIN slide d ON d.token = l.token AND d.sec = l.sec""")
def q_sliding_window_stream(spark, sf_dir):
    """J3 as a stateful stream over all requests (availableNow replay of the events file)."""
    return STR.replayed(spark, sf_dir, lambda log: STR.sliding_window_stream(log, GATE_WINDOW_S, GATE_LIMIT))


@register("ttl_cache_stream", lambda: "WITH RECURSIVE " + OQ.cache_sql() + "\nSELECT event_id, key, hit FROM cache_replay")
def q_ttl_cache_stream(spark, sf_dir):
    return STR.replayed(spark, sf_dir, lambda log: STR.ttl_cache_stream(RLOG.cache_lookups(log)))


@register("fixed_window_stream", lambda: "WITH " + OQ.fixed_window_sql(FW_RPM, FW_RPD)
          + "\nSELECT event_id, model, allowed, reason, retry_after_ms FROM fixed_window")
def q_fixed_window_stream(spark, sf_dir):
    limits = {m: (FW_RPM, FW_RPD) for m, _, _, _ in RLOG.MODEL_LIMITS}
    return STR.replayed(spark, sf_dir, lambda log: STR.fixed_window_stream(log, limits, (None, FW_RPM, FW_RPD)))


@register("minute_usage_stream", lambda: f"""WITH {RLOG.request_log_cte()}
SELECT date_trunc('minute', ts) AS minute, model, count(*) AS requests FROM request_log GROUP BY ALL""")
def q_minute_usage_stream(spark, sf_dir):
    """All one-minute windows, the ones still open at the end among them."""
    got = STR.replayed(spark, sf_dir, STR.minute_usage_stream, "1 minute", run=STR.run_updates, key=["window", "model"])
    return got.select(F.col("window.start").alias("minute"), "model", "requests")


@register("registration_stream", lambda: _REGISTRATIONS)
def q_registration_stream(spark, sf_dir):
    """J5 as a stream over all requests, in micro-batches of the time ranges."""
    return STR.replayed(spark, sf_dir, lambda log: log, run=STR.run_registrations)


def _gate_replayed(spark, sf_dir, build):
    tokens = RLOG.token_states(spark, sf_dir)
    return STR.replayed(spark, sf_dir, lambda log: build(log, tokens, window_s=GATE_WINDOW_S, limit=GATE_LIMIT, daily=GATE_DAILY), provider=GATE.ROCKSDB)


@register("request_gate_stream", lambda: ORACLE["request_gate"])
def q_request_gate_stream(spark, sf_dir):
    """J7 as a stream with all token states in the state store."""
    return _gate_replayed(spark, sf_dir, GATE.request_gate_stream)


@register("token_quota_stream", lambda: "WITH RECURSIVE " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY) + """
SELECT g.event_id, g.bearer_token AS token, auth_reason, slide_ok, CAST(slide_retry AS BIGINT) AS slide_retry, daily_ok,
       CAST(daily_retry AS BIGINT) AS daily_retry
FROM g4 g LEFT JOIN quota q ON q.event_id = g.event_id WHERE pre_status IS NULL""")
def q_token_quota_stream(spark, sf_dir):
    """J6, J3 and J4 as a stream: verdicts of the requests that pass the checks before them."""
    return _gate_replayed(spark, sf_dir, GATE.token_quota_stream)


_RECORD = "SELECT {ts} AS ts, substr(sha256(coalesce({token}, '')), 1, 16) AS session_id, {action} AS action, {model} AS model, " \
          "{outcome} AS outcome, CAST({duration} AS BIGINT) AS duration_ms, {detail} AS detail, CAST({ts} AS DATE) AS date"
_CALL_SQL = f"""
{_RECORD.format(ts="ts", token="token", action="'analysis_start'", model="model", outcome="'success'", duration="NULL", detail="NULL")} FROM calls
UNION ALL {_RECORD.format(ts="answered", token="token", action="CASE WHEN event_type <> 'error' THEN 'analysis_complete' ELSE 'analysis_failed' END", model="model",
                          outcome="CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failure' END", duration="ms",
                          detail="CASE WHEN event_type = 'error' THEN 'upstream error' END")} FROM calls WHERE event_id % 29 <> 0 AND ms <= 3600000"""
_CALL_CTE = """calls AS (SELECT *, ts + to_milliseconds(ms) AS answered FROM (
  SELECT *, CASE WHEN event_id % 31 = 0 THEN 9000000 ELSE event_id * 7919 % 90000 END AS ms FROM request_log WHERE model <> ''))"""


@register("append_audit_events", lambda: "WITH RECURSIVE " + OQ.gate_ctes(GATE_WINDOW_S, GATE_LIMIT, GATE_DAILY) + ",\nlookups AS"
          + OQ.cache_sql().split("lookups AS", 1)[1] + f""", {_CALL_CTE},
decided AS (SELECT r.ts, r.model, g.status, g.reason, CASE WHEN starts_with(auth_header, 'Bearer ') THEN substr(auth_header, 8) END AS token
            FROM gate g JOIN request_log r USING (event_id)),
looked AS (SELECT r.ts, r.token, c.key, c.hit FROM cache_replay c JOIN request_log r USING (event_id))
{_RECORD.format(ts="ts", token="token", action="CASE status WHEN 200 THEN 'api_call' WHEN 429 THEN 'rate_limit_hit' ELSE 'api_error' END", model="model",
                outcome="CASE status WHEN 200 THEN 'success' WHEN 429 THEN 'warning' ELSE 'failure' END", duration="NULL", detail="reason")} FROM decided
UNION ALL {_RECORD.format(ts="ts", token="token", action="CASE WHEN hit THEN 'cache_hit' ELSE 'cache_miss' END", model="NULL", outcome="'success'", duration="NULL",
                          detail="key")} FROM looked
UNION ALL {_CALL_SQL}""")
def q_append_audit_events(spark, sf_dir):
    """Gate decisions, cache lookups and model calls as audit records (the streaming sink is ``STR.append_audit_events``)."""
    log = RLOG.request_log(spark, sf_dir)
    stages = QU.gate_stages(log, RLOG.token_states(spark, sf_dir), window_s=GATE_WINDOW_S, limit=GATE_LIMIT, daily=GATE_DAILY)
    gate = QU.gate_status(stages, keep=("ts", "bearer_token", "model")).withColumnRenamed("bearer_token", "token")
    looked = QU.ttl_cache_replay(RLOG.cache_lookups(log)).join(log.select("event_id", "ts", "token"), "event_id")
    return AL.gate_records(gate).unionByName(AL.cache_records(looked)).unionByName(AL.call_records(RLOG.model_calls(log), RLOG.model_answers(log)))


@register("model_call_stream", lambda: f"WITH {RLOG.request_log_cte()}, {_CALL_CTE}{_CALL_SQL}")
def q_model_call_stream(spark, sf_dir):
    """A7 as a stream: starts of model calls, and ends with their durations."""
    return STR.run_available_now(STR.model_call_stream(spark, STR.ranged_by_time(spark, sf_dir)), whole=True)
