"""Quota, cache and gate replay over the request log (operators J1-J11).

The reference keeps per-key counters in a file or a KV store and decides each
request as it arrives. Here a log of requests is replayed in (ts, event_id)
order with the same decisions:

* J1 fixed-window quota and J4 daily quota have closed forms over running
  counts, computed on per-minute / per-second counts (bounded by the time
  span, not by the number of requests);
* J3 sliding window and J9 TTL cache are sequential per key. Requests are first
  pre-aggregated per (key, second) - map-side, so a hot key is flattened before
  the shuffle - and a key is cut into sessions at gaps that provably reset its
  state (a whole window, a whole time to live). Sessions are folded in parallel:
  hash-partitioned, sorted within partitions (external, spillable sort) and
  streamed through ``mapInPandas`` with only one session's small state in
  memory (J9 by millisecond);
* J5 registrations couple machines and IPs, so no key splits them. A grant holds
  iff no earlier grant names its machine and fewer than the limit its IP and day.
  The earliest attempts of every IP and day are settled by bounds from below and
  above, which are recomputed until they meet; later ones are taken in where places are left;
* J7 reads the log twice, narrowly, and keeps the authorised rows in the
  checkpoint folder; what follows reads those.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens.session import checkpointed
from repolens.sources import request_log as RL

# ---------------------------------------------------------------------------
# Fixed values of the reference (defaults; every one is a parameter below).
# ---------------------------------------------------------------------------
SLIDING_WINDOW_SECONDS = 60
SLIDING_MAX_REQUESTS = 60
DAILY_TOKEN_LIMIT = 200
MAX_BODY_BYTES = 100_000
MIN_VERSION = "1.0.0"
MAX_CLOCK_SKEW_SECONDS = 30
DAILY_RETRY_MIN_SECONDS = 60
CACHE_TTL_MS = 3_600_000
REGISTRATIONS_PER_IP_DAY = 3
ATTEMPTS_A_PLACE = 8
BROWSER_AGENTS = ["Mozilla/", "Chrome/", "Safari/", "Firefox/"]
TOKEN_PREFIX, TOKEN_MIN_LENGTH = "ptai_", 20
SUPPORTED_PROVIDERS = ["groq", "openai"]
MINUTE_MS, DAY_MS = 60_000, 86_400_000
# ---------------------------------------------------------------------------


# ---- scalar gates (J8, J10, J11, token/machine formats) -----------------------

def version_at_least(version: Column, minimum: str = MIN_VERSION) -> Column:
    """Numeric major.minor.patch comparison; a non-numeric patch fails on equal major.minor."""
    mma, mmi, mpa = [float(x) for x in minimum.split(".")[:3]]
    parts = F.split(version, r"\.")
    ma, mi = (F.get(parts, i).try_cast("double") for i in range(2))  # digits alone, by the pattern below
    last = F.get(parts, 2)
    pa = F.when(last.rlike(r"^[0-9]+([eE][+-]?[0-9]+)?\s*\z"), last.try_cast("double")) \
        .when(last.rlike(r"^0[xX][0-9a-fA-F]+\s*\z"), F.conv(F.substr(last, F.lit(3)), 16, 10).try_cast("double"))
    ok = (F.when(ma != mma, ma > mma)
          .when(mi != mmi, mi > mmi)
          .otherwise(F.coalesce(pa >= mpa, F.lit(False))))
    return F.coalesce(version.rlike(r"^\d+\.\d+\.\d+") & ok, F.lit(False))


def parse_client_ts(s: Column) -> Column:
    """``parseInt`` - leading integer after optional blanks, else NULL."""
    return F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def clock_skew_reason(client_ts: Column, signature: Column, now_sec: Column, sig_ok: Column,
                      max_skew: int = MAX_CLOCK_SKEW_SECONDS) -> Column:
    """NULL when the signature gate passes, else the reason (first failure wins)."""
    parsed = parse_client_ts(client_ts)
    return (F.when((client_ts == "") | (signature == ""), F.lit("missing_signature"))
            .when(parsed.isNull(), F.lit("invalid_timestamp"))
            .when(F.abs(now_sec - parsed) > max_skew, F.lit("timestamp_expired"))
            .when(~sig_ok, F.lit("invalid_signature")))


def allowed_models(override: str | None = None) -> list[str]:
    """Comma list override (trimmed, blanks ignored), else the defaults."""
    configured = [m.strip() for m in (override or "").split(",") if m.strip()]
    return configured or list(RL.DEFAULT_ALLOWED_MODELS)


def is_browser(agent: Column) -> Column:
    out = F.lit(False)
    for a in BROWSER_AGENTS:
        out = out | agent.contains(a)
    return out


def token_format_ok(token: Column) -> Column:
    return token.startswith(TOKEN_PREFIX) & (F.length(token) >= TOKEN_MIN_LENGTH)


def machine_format_ok(machine: Column) -> Column:
    return (F.length(machine) == 64) & machine.rlike(r"^[0-9a-f]+\z")


# ---- J1 / J2: client-side fixed windows per model ----------------------------

def fixed_window_quota(log: DataFrame, limits: DataFrame, default=RL.DEFAULT_LIMITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per model, allow while the minute count < rpm and then the day count < rpd.

    Denied requests are not counted, minutes nest in days, so within a
    (model, day) the admitted count of minute m is
    ``min(n_m, rpm, max(0, rpd - sum of earlier minutes' min(n, rpm)))``.
    The running sum runs over per-minute counts (at most 1,440 per model-day).
    """
    lim = limits.select("model", "rpm", "rpd")  # broadcast by Spark's own size check
    req = (log.select("event_id", "ts", "ts_ms", "model").join(lim, "model", "left")
           .select("event_id", "ts", "ts_ms", "model",
                   F.coalesce("rpm", F.lit(default[1])).alias("rpm"),
                   F.coalesce("rpd", F.lit(default[2])).alias("rpd"),
                   (F.col("ts_ms") - F.col("ts_ms") % MINUTE_MS).alias("minute"),
                   (F.col("ts_ms") - F.col("ts_ms") % DAY_MS).alias("day")))
    per_min = req.groupBy("model", "day", "minute").agg(F.count(F.lit(1)).alias("n"),
                                                        F.first("rpm").alias("rpm"), F.first("rpd").alias("rpd"))
    w = Window.partitionBy("model", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    cand = F.least(F.col("n"), F.col("rpm"))
    per_min = per_min.select("model", "minute", "rpm", "rpd", F.coalesce(F.sum(cand).over(w), F.lit(0)).alias("before"))
    per_min = per_min.select("model", "minute", F.greatest(F.lit(0), F.least(
        F.col("rpm"), F.col("rpd") - F.least(F.col("rpd"), F.col("before")))).alias("cap"), "rpm")
    rank = F.row_number().over(Window.partitionBy("model", "minute").orderBy("ts", "event_id"))
    j = req.select("event_id", "ts", "ts_ms", "model", "minute", "day", rank.alias("r")) \
        .join(per_min, ["model", "minute"])
    allowed = F.col("r") <= F.col("cap")
    reason = F.when(allowed, F.lit(None)).when(F.col("cap") == F.col("rpm"), F.lit("rpm")).otherwise(F.lit("rpd"))
    retry = (F.when(reason == "rpm", F.col("minute") + MINUTE_MS - F.col("ts_ms"))
             .when(reason == "rpd", F.col("day") + DAY_MS - F.col("ts_ms")))
    return j.select("event_id", "model", allowed.alias("allowed"), reason.cast("string").alias("reason"),
                    retry.cast("bigint").alias("retry_after_ms"), *keep)


def quota_usage(log: DataFrame, limits: DataFrame, now_ms: int | None = None, default=RL.DEFAULT_LIMITS) -> DataFrame:
    """Per listed model, used / limit in the minute and day containing ``now``.

    ``now`` defaults to the last request time of the log (one aggregate). Windows
    nest in days, so only the day of ``now`` is replayed.
    """
    if now_ms is None:
        now_ms = log.agg(F.max("ts_ms")).first()[0] or 0
    m0, d0 = now_ms - now_ms % MINUTE_MS, now_ms - now_ms % DAY_MS
    day = log.where((F.col("ts_ms") >= d0) & (F.col("ts_ms") < d0 + DAY_MS))
    counted = fixed_window_quota(day, limits, default, keep=("ts_ms",)).where(F.col("allowed") & (F.col("ts_ms") <= now_ms))
    usage = counted.groupBy("model").agg(F.count_if(F.col("ts_ms") >= m0).alias("minute_used"), F.count("*").alias("day_used"))
    out = limits.join(usage, "model", "left").select(
        "model", "label", F.coalesce("minute_used", F.lit(0)).cast("bigint").alias("minute_used"),
        F.col("rpm").alias("minute_limit"), F.coalesce("day_used", F.lit(0)).cast("bigint").alias("day_used"),
        F.col("rpd").alias("day_limit"))

    def status(used, limit):
        pct = F.col(used) / F.col(limit)
        return F.when(pct >= 1, F.lit("limit")).when(pct >= 0.8, F.lit("warning")).otherwise(F.lit("ok"))
    return out.select("*", status("minute_used", "minute_limit").alias("minute_status"),
                      status("day_used", "day_limit").alias("day_status"))


# ---- J3 + J4: per-token sliding window, then daily quota --------------------------

SLIDE_SCHEMA = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("sec", T.LongType()),
    T.StructField("admitted", T.LongType()), T.StructField("retry_after", T.LongType())])


def _slide_stream(window_s: int, limit: int):
    """Fold over (token, session, sec, n) rows sorted by (token, session, sec), streamed batch by batch.

    State is only the current session's admitted seconds inside the window, so
    memory does not grow with a key's number of rows.
    """
    def run(batches):
        key, win_s, win_c, head, total = None, [], [], 0, 0
        for pdf in batches:
            toks, secs = pdf["token"].tolist(), pdf["sec"].tolist()
            adm_out, retry_out = [], []
            for t, b, s, n in zip(toks, pdf["session"].tolist(), secs, pdf["n"].tolist()):
                if (t, b) != key:
                    key, win_s, win_c, head, total = (t, b), [], [], 0, 0
                while head < len(win_s) and win_s[head] <= s - window_s:
                    total -= win_c[head]
                    head += 1
                if head > 4096:                      # drop expired entries now and then
                    win_s, win_c, head = win_s[head:], win_c[head:], 0
                adm = max(0, min(n, limit - total))
                if adm:
                    win_s.append(s)
                    win_c.append(adm)
                    total += adm
                adm_out.append(adm)
                retry_out.append(max(1, win_s[head] + window_s - s) if n > adm and head < len(win_s) else None)
            yield pd.DataFrame({"token": toks, "sec": secs, "admitted": adm_out,
                                "retry_after": pd.array(retry_out, dtype="Int64")})
    return run


def with_sessions(df: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """``df`` with ``session``, where a key's current stretch without a gap of ``gap`` or more began."""
    w = Window.partitionBy(key).orderBy(at)
    began = F.when(F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True)), F.col(at))
    return df.withColumn("_began", began).withColumn("session", F.max("_began").over(w)).drop("_began")


def ordered_fold(df: DataFrame, key: list[str], order: list[str], fn, schema: T.StructType) -> DataFrame:
    """Run a per-key sequential fold: hash-partition by key, sort by (key, order), stream the partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key).sortWithinPartitions(*key, *order).mapInPandas(fn, schema)


def sliding_and_daily(reqs: DataFrame, window_s: int = SLIDING_WINDOW_SECONDS,
                      limit: int = SLIDING_MAX_REQUESTS, daily: int = DAILY_TOKEN_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """J3 + J4 for requests that reached the limiter (columns token, sec, ts, ts_ms, event_id).

    Returns per request: ``slide_ok``, ``slide_retry``, ``daily_ok``, ``daily_retry``, and the columns ``keep``.
    """
    per_sec = with_sessions(reqs.groupBy("token", "sec").agg(F.count(F.lit(1)).alias("n")), "token", "sec", window_s)
    folded = ordered_fold(per_sec, ["token", "session"], ["sec"], _slide_stream(window_s, limit), SLIDE_SCHEMA)
    before = Window.partitionBy("token", "day").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("day", F.expr("sec div 86400")).withColumn(
        "day_before", F.coalesce(F.sum("admitted").over(before), F.lit(0))).drop("day")
    rank = F.row_number().over(Window.partitionBy("token", "sec").orderBy("ts", "event_id"))
    j = reqs.select(*dict.fromkeys(("event_id", "token", "sec", "ts_ms", *keep)), rank.alias("r")).join(folded, ["token", "sec"])
    slide_ok = F.col("r") <= F.col("admitted")
    daily_rank = F.col("day_before") + F.col("r")
    daily_ok = slide_ok & (daily_rank <= daily)
    next_midnight = F.col("ts_ms") - F.col("ts_ms") % DAY_MS + DAY_MS
    daily_retry = F.greatest(F.lit(DAILY_RETRY_MIN_SECONDS), F.ceil((next_midnight - F.col("ts_ms")) / 1000))
    return j.select("event_id", *(c for c in keep if c != "event_id"), slide_ok.alias("slide_ok"),
                    F.when(~slide_ok, F.col("retry_after")).alias("slide_retry"),
                    daily_ok.alias("daily_ok"),
                    F.when(slide_ok & ~daily_ok, daily_retry).cast("bigint").alias("daily_retry"))


# ---- J6 + J7: token binding and the request gate -------------------------------

GATE_COLUMNS = ("event_id", "ts", "ts_ms", "sec", "machine_id", "body_bytes", "body_json_ok", "model", "provider")


def gate_checks(log: DataFrame, min_version: str = MIN_VERSION) -> DataFrame:
    """The checks that need one request alone (J8, J10, formats), on a batch or a stream, with the columns that later gates read."""
    bearer = F.col("auth_header").startswith("Bearer ")
    # in steps: what a step refers to more than once is computed once, in the step before
    rows = log.select(
        *GATE_COLUMNS, F.when(bearer, F.substr(F.col("auth_header"), F.lit(8))).alias("bearer_token"),
        ((F.col("method") != "POST") | (F.col("route") != "/v1/compute")).alias("elsewhere"), is_browser(F.col("user_agent")).alias("browser"),
        version_at_least(F.col("version"), min_version).alias("new_enough"),
        clock_skew_reason(F.col("client_ts"), F.col("signature"), F.col("sec"), F.col("sig_ok")).alias("sig_reason"),
        machine_format_ok(F.col("machine_id")).alias("machine_ok"))
    no_bearer = F.col("bearer_token").isNull()
    failed = [(F.col("elsewhere"), 404, F.lit("not_found")), (F.col("browser"), 403, F.lit("browser")), (no_bearer, 401, F.lit("no_bearer")),
              (~F.col("new_enough"), 426, F.lit("outdated_client")), (F.col("sig_reason").isNotNull(), 401, F.col("sig_reason"))]
    pre, pre_reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for gate, status, reason in reversed(failed):
        pre, pre_reason = F.when(gate, F.lit(status)).otherwise(pre), F.when(gate, reason).otherwise(pre_reason)
    fmt = (F.when(~token_format_ok(F.col("bearer_token")), F.lit("invalid_token_format"))
           .when(~F.col("machine_ok"), F.lit("invalid_machine_format")))
    base = rows.select(*GATE_COLUMNS, "bearer_token", pre.alias("pre_status"), pre_reason.alias("pre_reason"), fmt.alias("fmt_reason"))
    # rows that no token state can decide are dealt by their number, so they don't meet under one key
    reach = F.col("pre_status").isNull() & F.col("fmt_reason").isNull()
    return base.withColumn("reach", reach).withColumn(
        "key", F.when(F.col("reach"), F.col("bearer_token")).otherwise(F.concat(F.lit("-"), (F.col("event_id") % 1024).cast("string"))))


def gate_stages(log: DataFrame, tokens: DataFrame, *, min_version: str = MIN_VERSION,
                window_s: int = SLIDING_WINDOW_SECONDS, limit: int = SLIDING_MAX_REQUESTS,
                daily: int = DAILY_TOKEN_LIMIT) -> DataFrame:
    """Per request: pre-auth status, auth verdict (J6) and quota verdicts."""
    base = gate_checks(log, min_version)
    # An unbound token binds to the first machine that reaches the state check
    first = base.where("reach").groupBy("key").agg(F.min_by("machine_id", F.struct("ts", "event_id")).alias("first"))
    states = tokens.select(F.col("token").alias("key"), "state").join(first, "key", "left").select(
        "key", "state", F.when(F.col("state") == "unbound", F.col("first")).otherwise(F.col("state")).alias("bound"))
    auth_reason = (F.when(F.col("fmt_reason").isNotNull(), F.col("fmt_reason"))
                   .when(F.col("state").isNull(), F.lit("token_not_found"))
                   .when(F.col("state") == "any", F.lit(None))
                   .when(F.col("bound") != F.col("machine_id"), F.lit("machine_mismatch")))
    authed = checkpointed(base.join(states, "key", "left").withColumn("auth_reason", auth_reason).drop("key", "state", "bound", "reach", "fmt_reason"))
    passed = F.col("pre_status").isNull() & F.col("auth_reason").isNull()
    quota = sliding_and_daily(authed.where(passed).withColumn("token", F.col("bearer_token")), window_s, limit, daily, tuple(authed.columns))
    return quota.unionByName(authed.where(~passed), allowMissingColumns=True)


def gate_status(gated: DataFrame, *, max_body: int = MAX_BODY_BYTES, allowed: list[str] | None = None,
                configured_providers=("groq",), keep: tuple[str, ...] = ()) -> DataFrame:
    """J7's decision from the verdicts of all gates, on a batch or a stream, beside the columns ``keep``."""
    model_ok = (F.col("model") != "") & F.col("model").isin(*(allowed or allowed_models()))
    decided = [(F.col("pre_status").isNotNull(), F.col("pre_status"), F.col("pre_reason")),
               (F.col("auth_reason").isNotNull(), F.lit(401), F.col("auth_reason")),
               (~F.col("slide_ok"), F.lit(429), F.lit("rate_limited")),
               (~F.col("daily_ok"), F.lit(429), F.lit("daily_limit")),
               (F.col("body_bytes") > max_body, F.lit(413), F.lit("body_too_large")),
               (~F.col("body_json_ok"), F.lit(400), F.lit("invalid_json")),
               (~model_ok, F.lit(400), F.lit("model_not_allowed")),
               (~F.col("provider").isin(*SUPPORTED_PROVIDERS), F.lit(400), F.lit("unsupported_provider")),
               (~F.col("provider").isin(*configured_providers), F.lit(503), F.lit("provider_not_configured"))]
    status, reason = F.lit(200), F.lit("forwarded")
    for failed, code, why in reversed(decided):
        status, reason = F.when(failed, code).otherwise(status), F.when(failed, why).otherwise(reason)
    retry = F.when(~F.col("slide_ok"), F.col("slide_retry")).when(~F.col("daily_ok"), F.col("daily_retry"))
    return gated.select("event_id", *keep, status.cast("int").alias("status"), reason.alias("reason"),
                        F.when(status == 429, retry).cast("bigint").alias("retry_after"))


def request_gate(log: DataFrame, tokens: DataFrame, *, min_version: str = MIN_VERSION,
                 window_s: int = SLIDING_WINDOW_SECONDS, limit: int = SLIDING_MAX_REQUESTS,
                 daily: int = DAILY_TOKEN_LIMIT, max_body: int = MAX_BODY_BYTES,
                 allowed: list[str] | None = None, configured_providers=("groq",)) -> DataFrame:
    """Status of every request; the first failing gate decides.

    Quotas are consumed by requests that pass the route/agent/bearer/version/
    signature/auth gates, before the body-size, JSON and model checks.
    """
    g = gate_stages(log, tokens, min_version=min_version, window_s=window_s, limit=limit, daily=daily)
    return gate_status(g, max_body=max_body, allowed=allowed, configured_providers=configured_providers)


# ---- J9: TTL cache replay -----------------------------------------------------------

CACHE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("ts_ms", T.LongType()),
    T.StructField("first_hit", T.BooleanType())])


def _cache_stream(ttl_ms: int):
    def run(batches):
        key, created, ver = None, None, None
        for pdf in batches:
            keys, times = pdf["key"].tolist(), pdf["ts_ms"].tolist()
            out = []
            for k, b, t, v in zip(keys, pdf["session"].tolist(), times, pdf["version"].tolist()):
                if (k, b) != key:
                    key, created, ver = (k, b), None, None
                hit = created is not None and v == ver and t - created <= ttl_ms
                if not hit:
                    created, ver = t, v
                out.append(hit)
            yield pd.DataFrame({"key": keys, "ts_ms": times, "first_hit": out})
    return run


def ttl_cache_replay(lookups: DataFrame, ttl_ms: int = CACHE_TTL_MS) -> DataFrame:
    """Hit iff ``now - created <= ttl`` (milliseconds) and versions match; a miss (re)creates; hits do not refresh.

    Lookups of one key in one millisecond share the first one's version; after
    it the entry exists with age 0, so only that first lookup can miss. The
    fold runs over those per-millisecond rows, in sessions: after a gap longer than
    the time to live the entry is stale whatever came before.
    """
    per_ms = lookups.groupBy("key", "ts_ms").agg(F.min_by("version", F.struct("ts", "event_id")).alias("version"))
    folded = ordered_fold(with_sessions(per_ms, "key", "ts_ms", ttl_ms + 1), ["key", "session"], ["ts_ms"], _cache_stream(ttl_ms), CACHE_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("key", "ts_ms").orderBy("ts", "event_id"))
    j = lookups.select("event_id", "key", "ts_ms", rank.alias("r")).join(folded, ["key", "ts_ms"])
    return j.select("event_id", "key", F.when(F.col("r") == 1, F.col("first_hit")).otherwise(F.lit(True)).alias("hit"))


# ---- J5: registrations per IP and day -------------------------------------------------

def _settled(rows: DataFrame, per_day: int) -> DataFrame:
    """The grants among ``rows``, decided as if there were no other attempts.

    An attempt is ``fresh`` if no other before it may have been granted to its machine. A fresh one is
    granted or finds its IP and day full, so one that has as many fresh ones before it as there are places
    isn't. A fresh one with fewer attempts before it than places surely is, and later ones of its machine aren't.
    What is surely not granted leaves the rows. The earliest open attempt settles in every round, in
    practice several days do.
    """
    machine, before = Window.partitionBy("machine_id"), Window.partitionBy("ip", "day").orderBy("f", "machine_id").rowsBetween(Window.unboundedPreceding, -1)
    places = F.coalesce(F.when(F.col("day").isNotNull(), per_day - F.col("used")), F.lit(2**31 - 1))  # without a day there is no limit
    while True:
        rows = rows.withColumn("fresh", F.min("f").over(machine) == F.col("f"))
        rows = rows.withColumns({"low": F.col("fresh") & (F.count("*").over(before) < places), "high": F.count_if("fresh").over(before) < places})
        rows = rows.withColumn("own", F.min(F.when(F.col("low"), F.col("f"))).over(machine)).where(F.col("high") & F.coalesce(F.col("f") <= F.col("own"), F.lit(True)))
        rows = checkpointed(rows.drop("fresh", "high", "own"))
        if rows.where(~F.col("low")).isEmpty():
            return rows.drop("low")
        rows = rows.drop("low")


def registration_grants(firsts: DataFrame, per_day: int = REGISTRATIONS_PER_IP_DAY, ahead: int = ATTEMPTS_A_PLACE) -> DataFrame:
    """The granted ones of first attempts (ip, day, machine_id, f = (ts, event_id), used = grants of that IP and day before).

    What comes after the last place of an IP and day doesn't matter, so only the earliest attempts of each, ``ahead`` a place,
    are settled. Where these leave a place and there are later ones, more of them are taken in and all are settled again,
    until no IP and day has both: then the grants are those among all attempts.
    """
    firsts = checkpointed(firsts.where(F.col("used") < per_day))
    dated, turn = firsts.where("day is not null"), F.row_number().over(Window.partitionBy("ip", "day").orderBy("f", "machine_id"))
    reach = max(1, ahead * per_day)
    sizes = dated.groupBy("ip", "day").agg(F.count("*").alias("n"))
    rows = dated.withColumn("turn", turn).where(F.col("turn") <= reach).join(sizes, ["ip", "day"])
    rows = checkpointed(rows.unionByName(firsts.where("day is null"), allowMissingColumns=True))
    while True:
        granted = _settled(rows.select(*firsts.columns), per_day)
        taken = granted.groupBy("ip", "day").agg(F.count("*").alias("taken"))
        short = checkpointed(rows.groupBy("ip", "day").agg(F.max("turn").alias("reached"), F.first("n").alias("n"), F.first("used").alias("used_before"))
                             .where("reached < n").join(taken, ["ip", "day"], "left")
                             .where(F.coalesce("taken", F.lit(0)) < per_day - F.col("used_before")).drop("taken", "used_before"))
        if short.isEmpty():
            return granted
        reach *= 8
        more = dated.join(short, ["ip", "day"]).withColumn("turn", turn).where((F.col("turn") <= reach) & (F.col("turn") > F.col("reached")))
        rows = checkpointed(rows.unionByName(more.drop("reached")))


def first_attempts(valid: DataFrame) -> DataFrame:
    """The first attempt of each (ip, day, machine): only that one can be granted, since a day's grants never fall."""
    return valid.groupBy("ip", "day", "machine_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))


def registration_attempts(attempts: DataFrame) -> DataFrame:
    fine = F.coalesce(machine_format_ok(F.col("machine_id")), F.lit(False))
    refused = F.when(is_browser(F.col("user_agent")), F.lit(403)).when(~fine, F.lit(400))
    return attempts.select("event_id", "ts", F.coalesce("ip", F.lit("unknown")).alias("ip"), "machine_id", F.expr("unix_millis(ts) div 86400000").alias("day"), refused.alias("refused"))


def registration_status(attempts: DataFrame, grants: DataFrame) -> DataFrame:
    """Status of every attempt by its machine's grant (machine_id, f)."""
    at = F.struct("ts", "event_id")
    status = F.coalesce("refused", F.when(at == F.col("f"), F.lit(201)).when(at > F.col("f"), F.lit(200)).otherwise(F.lit(429)))
    return attempts.join(grants.select("machine_id", "f"), "machine_id", "left").select(
        "event_id", "ip", "machine_id", status.cast("int").alias("status"))


def registration_limit(attempts: DataFrame, per_day: int = REGISTRATIONS_PER_IP_DAY) -> DataFrame:
    """Known machine -> 200; else at most ``per_day`` new machines per IP and UTC day -> 201 / 429. A machine may use any IPs."""
    a = registration_attempts(attempts)
    firsts = first_attempts(a.where("refused is null")).withColumn("used", F.lit(0))
    return registration_status(a, registration_grants(firsts, per_day))
