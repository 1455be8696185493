"""Audit records (A7): gate decisions, cache lookups and model calls with their durations.

All parts are column expressions and joins that a batch and a stream share. A model
call's start and end are two rows of one call id; they meet by an equi-join on the id with a
bound on the time between them, so as a stream (watermarks on both sides) Spark
forgets a call once its answer can't come in time any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SECONDS = 3600  # an answer later than this belongs to no call


def session_of(token: Column) -> Column:
    """A session's name: sixteen digits of the token's digest, never the token."""
    return F.substring(F.sha2(F.coalesce(token, F.lit("")), 256), 1, 16)


def record(ts: str, token: Column, action, model, outcome, duration_ms=None, detail=None) -> list[Column]:
    text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
    duration = F.lit(None) if duration_ms is None else duration_ms
    return [F.col(ts).alias("ts"), session_of(token).alias("session_id"), text(action).alias("action"), text(model).alias("model"),
            text(outcome).alias("outcome"), duration.cast("bigint").alias("duration_ms"), text(detail).alias("detail"),
            F.to_date(ts).alias("date")]


def gate_records(decisions: DataFrame) -> DataFrame:
    """Decisions (ts, token, model, status, reason): forwarded calls, calls over a limit, refused calls."""
    ok, limited = F.col("status") == 200, F.col("status") == 429
    action = F.when(ok, "api_call").when(limited, "rate_limit_hit").otherwise("api_error")
    outcome = F.when(ok, "success").when(limited, "warning").otherwise("failure")
    return decisions.select(record("ts", F.col("token"), action, F.col("model"), outcome, None, F.col("reason")))


def cache_records(lookups: DataFrame) -> DataFrame:
    """Cache lookups (ts, token, key, hit)."""
    return lookups.select(record("ts", F.col("token"), F.when(F.col("hit"), "cache_hit").otherwise("cache_miss"), None, "success", None, F.col("key")))


def call_records(calls: DataFrame, answers: DataFrame, most_seconds: int = MOST_SECONDS) -> DataFrame:
    """Model calls (call_id, ts, token, model) and their answers (answer_to, answered, ok, error): a start each, and an end for each call answered in time."""
    late = F.expr(f"INTERVAL {int(most_seconds)} SECONDS")
    met = calls.join(answers, (F.col("call_id") == F.col("answer_to")) & (F.col("answered") >= F.col("ts")) & (F.col("answered") <= F.col("ts") + late))
    duration = F.unix_millis("answered") - F.unix_millis("ts")
    ended = met.select(record("answered", F.col("token"), F.when(F.col("ok"), "analysis_complete").otherwise("analysis_failed"), F.col("model"),
                              F.when(F.col("ok"), "success").otherwise("failure"), duration, F.col("error")))
    return calls.select(record("ts", F.col("token"), "analysis_start", F.col("model"), "success")).unionByName(ended)
