"""Request log (source A4) derived from the driver's ``events`` table.

Each event is one call to the proxy. Header fields the gate inspects are
derived from ``event_id``/``user_id`` arithmetic so that every gate has
failures to decide; the same derivation is spelled in DuckDB for the oracle.

``ts`` is loaded as ``timestamp_ntz``; it is cast to ``TIMESTAMP`` in the UTC
session before epoch arithmetic, so minute/day windows are UTC-aligned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.sources.tables import read_table

# ---------------------------------------------------------------------------
# Derivation parameters (ours). Model names and limits are the reference's.
# ---------------------------------------------------------------------------
MODEL_BY_EVENT = {
    "click": "qwen/qwen3-32b",
    "view": "llama-3.3-70b-versatile",
    "purchase": "openai/gpt-oss-120b",
    "signup": "moonshotai/kimi-k2-instruct",
    "error": "llama-3.1-8b-instant",
}
GOOD_VERSION, OLD_VERSION, PRE_VERSION, SHORT_VERSION = "1.4.2", "0.9.1", "1.0.0-beta", "2.0"
CLI_AGENT, BROWSER_AGENT = "repolens-cli/1.4.2", "Mozilla/5.0 (X11; Linux x86_64)"
CACHE_UPGRADE_AT = "2024-01-20 00:00:00"
CACHE_KEY_BUCKETS = 10
# ---------------------------------------------------------------------------

# Fixed values of the reference: model limit table (model, label, rpm, rpd),
# the fallback for unlisted models, and the gate's default allow-list.
MODEL_LIMITS = [
    ("qwen/qwen3-32b", "Qwen3 32B", 30, 1000),
    ("llama-3.3-70b-versatile", "LLaMA 3.3 70B Versatile", 30, 1000),
    ("llama-3.1-8b-instant", "LLaMA 3.1 8B Instant", 30, 14400),
    ("meta-llama/llama-4-scout-17b-16e-instruct", "LLaMA 4 Scout 17B", 30, 500),
    ("moonshotai/kimi-k2-instruct", "Kimi K2", 30, 1000),
    ("openai/gpt-oss-120b", "GPT OSS 120B", 30, 500),
    ("openai/gpt-oss-20b", "GPT OSS 20B", 30, 1000),
]
DEFAULT_LIMITS = ("Unknown model", 30, 500)
DEFAULT_ALLOWED_MODELS = ["moonshotai/kimi-k2-instruct", "openai/gpt-oss-120b", "qwen/qwen3-32b",
                          "llama-3.3-70b-versatile"]

LIMITS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False), T.StructField("label", T.StringType(), False),
    T.StructField("rpm", T.LongType(), False), T.StructField("rpd", T.LongType(), False)])


def model_limits(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or MODEL_LIMITS, LIMITS_SCHEMA)


def _case(col, mapping: dict, default=None):
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_request_log(read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]))


def derive_request_log(ev: DataFrame) -> DataFrame:
    """Header fields of each request, derived from an ``events`` batch or stream."""
    e, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    ts_ms = F.unix_millis(ts)
    sec = F.expr("unix_millis(cast(ts as timestamp)) div 1000")
    token = F.when(u % 37 == 0, F.concat(F.lit("ptai_"), u.cast("string"))) \
        .otherwise(F.concat(F.lit("ptai_"), F.lpad(u.cast("string"), 20, "0")))
    machine = (F.when(e % 89 == 0, F.lit("not-a-machine"))
               .when(e % 97 == 0, F.sha2(F.concat(F.lit("other-"), u.cast("string")), 256))
               .otherwise(F.sha2(F.concat(F.lit("machine-"), u.cast("string")), 256)))
    version = (F.when(e % 50 == 0, F.lit(OLD_VERSION)).when(e % 50 == 1, F.lit(PRE_VERSION))
               .when(e % 50 == 2, F.lit("")).when(e % 50 == 3, F.lit(SHORT_VERSION)).otherwise(F.lit(GOOD_VERSION)))
    client_ts = (F.when(e % 103 == 0, F.lit(""))
                 .when(e % 83 == 0, F.lit("abc"))
                 .when(e % 79 == 0, F.concat(sec.cast("string"), F.lit("xyz")))
                 .when(e % 71 == 0, (sec - 45).cast("string"))
                 .otherwise((sec + (e % 7) - 3).cast("string")))
    model = F.when(e % 131 == 0, F.lit("")).otherwise(_case(F.col("event_type"), MODEL_BY_EVENT, ""))
    return ev.select(
        "event_id", ts.alias("ts"), ts_ms.alias("ts_ms"), sec.alias("sec"), "user_id", "event_type",
        token.alias("token"), machine.alias("machine_id"),
        F.concat(F.lit("ip-"), (F.when(e % 11 == 0, e).otherwise(u) % 20).cast("string")).alias("ip"),
        F.when(e % 53 == 0, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.lit("/v1/compute").alias("route"),
        F.when(e % 41 == 0, F.lit(BROWSER_AGENT)).otherwise(F.lit(CLI_AGENT)).alias("user_agent"),
        F.when(e % 59 == 0, F.lit("")).otherwise(F.concat(F.lit("Bearer "), token)).alias("auth_header"),
        version.alias("version"), client_ts.alias("client_ts"),
        F.when(e % 107 == 0, F.lit("")).otherwise(F.lit("sig")).alias("signature"),
        (e % 61 != 0).alias("sig_ok"),
        F.when(e % 67 == 0, F.lit(150000)).otherwise(200 + (e * 7919) % 5000).cast("bigint").alias("body_bytes"),
        (e % 73 != 0).alias("body_json_ok"),
        F.when(e % 113 == 0, F.lit("anthropic")).when(e % 127 == 0, F.lit("openai"))
         .otherwise(F.lit("groq")).alias("provider"),
        model.alias("model"),
    )


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KV token table: ``unbound`` / ``any`` / a bound machine; some tokens revoked."""
    users = read_table(spark, sf_dir, "events", ["user_id"]).distinct()
    u = F.col("user_id")
    token = F.when(u % 37 == 0, F.concat(F.lit("ptai_"), u.cast("string"))) \
        .otherwise(F.concat(F.lit("ptai_"), F.lpad(u.cast("string"), 20, "0")))
    state = (F.when(u % 3 == 0, F.lit("unbound")).when(u % 3 == 1, F.lit("any"))
             .otherwise(F.sha2(F.concat(F.lit("machine-"), u.cast("string")), 256)))
    return users.where(u % 29 != 0).select(token.alias("token"), state.alias("state"))


def cache_lookups(log: DataFrame) -> DataFrame:
    """Cache lookups: key ``analysis:<model>:<bucket>``, millisecond times, version per era."""
    key = F.concat(F.lit("analysis:"), F.col("event_type"), F.lit(":"),
                   (F.col("user_id") % CACHE_KEY_BUCKETS).cast("string"))
    version = F.when(F.col("ts") >= F.lit(CACHE_UPGRADE_AT).cast("timestamp"), F.lit("2")).otherwise(F.lit("1"))
    return log.select("event_id", "ts", "ts_ms", key.alias("key"), version.alias("version"))


def model_calls(log: DataFrame) -> DataFrame:
    """Calls of a model: every request whose model is named."""
    return log.where(F.col("model") != "").select(F.col("event_id").alias("call_id"), "ts", "token", "model")


def model_answers(log: DataFrame) -> DataFrame:
    """Answers to calls, up to 90 seconds later: some never come, some come after hours, some are errors."""
    e = F.col("event_id")
    ms = F.when(e % 31 == 0, F.lit(9_000_000)).otherwise(e * 7919 % 90_000)
    ok = F.col("event_type") != "error"
    return log.where((F.col("model") != "") & (e % 29 != 0)).select(
        e.alias("answer_to"), F.timestamp_micros(F.unix_micros("ts") + ms * 1000).alias("answered"), ok.alias("ok"),
        F.when(~ok, "upstream error").alias("error"))


# ---- DuckDB spelling ----------------------------------------------------------

def _sql_case(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


def request_log_cte() -> str:
    tok = ("CASE WHEN user_id % 37 = 0 THEN 'ptai_' || CAST(user_id AS VARCHAR) "
           "ELSE 'ptai_' || lpad(CAST(user_id AS VARCHAR), 20, '0') END")
    return f"""request_log AS (
  SELECT event_id, ts, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000000 AS sec, user_id, event_type,
    {tok} AS token,
    CASE WHEN event_id % 89 = 0 THEN 'not-a-machine'
         WHEN event_id % 97 = 0 THEN sha256('other-' || CAST(user_id AS VARCHAR))
         ELSE sha256('machine-' || CAST(user_id AS VARCHAR)) END AS machine_id,
    'ip-' || CAST(CASE WHEN event_id % 11 = 0 THEN event_id ELSE user_id END % 20 AS VARCHAR) AS ip,
    CASE WHEN event_id % 53 = 0 THEN 'GET' ELSE 'POST' END AS method, '/v1/compute' AS route,
    CASE WHEN event_id % 41 = 0 THEN '{BROWSER_AGENT}' ELSE '{CLI_AGENT}' END AS user_agent,
    CASE WHEN event_id % 59 = 0 THEN '' ELSE 'Bearer ' || {tok} END AS auth_header,
    CASE WHEN event_id % 50 = 0 THEN '{OLD_VERSION}' WHEN event_id % 50 = 1 THEN '{PRE_VERSION}'
         WHEN event_id % 50 = 2 THEN '' WHEN event_id % 50 = 3 THEN '{SHORT_VERSION}' ELSE '{GOOD_VERSION}' END AS version,
    CASE WHEN event_id % 103 = 0 THEN '' WHEN event_id % 83 = 0 THEN 'abc'
         WHEN event_id % 79 = 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) || 'xyz'
         WHEN event_id % 71 = 0 THEN CAST(epoch_us(ts) // 1000000 - 45 AS VARCHAR)
         ELSE CAST(epoch_us(ts) // 1000000 + event_id % 7 - 3 AS VARCHAR) END AS client_ts,
    CASE WHEN event_id % 107 = 0 THEN '' ELSE 'sig' END AS signature,
    event_id % 61 <> 0 AS sig_ok,
    CAST(CASE WHEN event_id % 67 = 0 THEN 150000 ELSE 200 + (event_id * 7919) % 5000 END AS BIGINT) AS body_bytes,
    event_id % 73 <> 0 AS body_json_ok,
    CASE WHEN event_id % 113 = 0 THEN 'anthropic' WHEN event_id % 127 = 0 THEN 'openai' ELSE 'groq' END AS provider,
    CASE WHEN event_id % 131 = 0 THEN '' ELSE {_sql_case('event_type', MODEL_BY_EVENT, '')} END AS model
  FROM events),
token_states AS (
  SELECT {tok} AS token,
    CASE WHEN user_id % 3 = 0 THEN 'unbound' WHEN user_id % 3 = 1 THEN 'any'
         ELSE sha256('machine-' || CAST(user_id AS VARCHAR)) END AS state
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 29 <> 0)"""
