"""Request-log replays against brute-force sequential replays in Python."""

from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from repolens.operators import quota as QU
from repolens.sources import request_log as RL

from .conftest import SMALL


@pytest.fixture(scope="module")
def log(spark):
    return RL.request_log(spark, SMALL).cache()


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: (t[1], t[0]) if len(t) > 1 else t)


@pytest.mark.parametrize("window,limit,daily", [(21600, 2, 3), (60, 1, 2), (3600, 3, 100)])
def test_sliding_and_daily_match_sequential_replay(spark, log, window, limit, daily):
    reqs = log.select("event_id", "token", "sec", "ts", "ts_ms")
    got = {r["event_id"]: (r["slide_ok"], r["slide_retry"], r["daily_ok"], r["daily_retry"])
           for r in QU.sliding_and_daily(reqs, window, limit, daily).collect()}
    rows = sorted(((r["ts"], r["event_id"], r["token"], r["sec"], r["ts_ms"]) for r in reqs.collect()))
    stamps, days, expect = defaultdict(list), defaultdict(int), {}
    for _, eid, tok, sec, ms in rows:
        kept = [t for t in stamps[tok] if t > sec - window]
        stamps[tok] = kept
        if len(kept) >= limit:
            expect[eid] = (False, max(1, kept[0] + window - sec), False, None)
            continue
        kept.append(sec)
        key = (tok, sec // 86400)
        if days[key] >= daily:
            nxt = (ms // 86400000 + 1) * 86400000
            expect[eid] = (True, None, False, max(60, -(-(nxt - ms) // 1000)))
        else:
            days[key] += 1
            expect[eid] = (True, None, True, None)
    assert got == expect


def test_ttl_cache_matches_sequential_replay(spark, log):
    lookups = RL.cache_lookups(log)
    got = {r["event_id"]: r["hit"] for r in QU.ttl_cache_replay(lookups, 3_600_000).collect()}
    state, expect = {}, {}
    for ts, eid, key, ms, ver in sorted((r["ts"], r["event_id"], r["key"], r["ts_ms"], r["version"])
                                         for r in lookups.collect()):
        entry = state.get(key)
        hit = entry is not None and entry[1] == ver and ms - entry[0] <= 3_600_000
        if not hit:
            state[key] = (ms, ver)
        expect[eid] = hit
    assert got == expect


def test_registrations_match_sequential_replay(spark, log):
    attempts = log.where(F.col("event_type") == "signup")
    got = {r["event_id"]: r["status"] for r in QU.registration_limit(attempts, 1).collect()}
    known, per_ip_day, expect = set(), defaultdict(int), {}
    for ts, eid, ip, machine, agent in sorted((r["ts"], r["event_id"], r["ip"], r["machine_id"], r["user_agent"])
                                              for r in attempts.collect()):
        if any(a in agent for a in QU.BROWSER_AGENTS):
            expect[eid] = 403
        elif len(machine) != 64 or any(c not in "0123456789abcdef" for c in machine):
            expect[eid] = 400
        elif machine in known:
            expect[eid] = 200
        elif per_ip_day[(ip, ts.date())] >= 1:
            expect[eid] = 429
        else:
            per_ip_day[(ip, ts.date())] += 1
            known.add(machine)
            expect[eid] = 201
    assert got == expect


def sequential(rows, per_day):
    known, used, out = set(), defaultdict(int), {}
    for ts, eid, ip, machine in sorted(rows, key=lambda r: r[:2]):
        key = (ip or "unknown", ts.date())
        if machine in known:
            out[eid] = 200
        elif used[key] >= per_day:
            out[eid] = 429
        else:
            used[key] += 1
            known.add(machine)
            out[eid] = 201
    return out


@pytest.mark.parametrize("per_day", [0, 1, 3])
def test_registrations_of_machines_that_move(spark, per_day):
    """Machines on many IPs: a grant on one IP changes what others have left, in long chains."""
    import datetime as dt
    import hashlib
    import random

    rng = random.Random(per_day)
    start = dt.datetime(2024, 3, 1)
    machines = [hashlib.sha256(bytes([i])).hexdigest() for i in range(60)]
    rows = [(start + dt.timedelta(minutes=rng.randrange(6000)), i, rng.choice(["a", "b", "c", "d", None]), rng.choice(machines)) for i in range(500)]
    rows += [(start + dt.timedelta(minutes=10 * i), 1000 + i, f"x{i % 2}", machines[(i + 1) // 2]) for i in range(60)]  # each hands on to the next
    log = spark.createDataFrame([(*r, "cli") for r in rows], "ts timestamp, event_id long, ip string, machine_id string, user_agent string")
    got = {r.event_id: r.status for r in QU.registration_limit(log, per_day).collect()}
    assert got == sequential(rows, per_day)


@pytest.mark.parametrize("ahead", [1, 8])
def test_registrations_of_many_days_settle_in_a_few_rounds(spark, monkeypatch, ahead):
    """Machines that try every day: a round settles several days, and attempts after the last place aren't carried along."""
    import datetime as dt
    import hashlib
    import random

    rng = random.Random(3)
    start = dt.datetime(2024, 3, 1)
    machines = [hashlib.sha256(bytes([i // 256, i % 256])).hexdigest() for i in range(400)]
    rows = [(start + dt.timedelta(days=d, seconds=rng.randrange(86400)), 400 * d + m, f"i{m % 2}", machines[m]) for d in range(25) for m in range(400)]
    log = spark.createDataFrame([(*r, "cli") for r in rows], "ts timestamp, event_id long, ip string, machine_id string, user_agent string")
    firsts = QU.first_attempts(QU.registration_attempts(log)).withColumn("used", F.lit(0))
    sizes, kept = [], QU.checkpointed

    def counted(df):
        sizes.append(df)
        return kept(df)
    monkeypatch.setattr(QU, "checkpointed", counted)
    grants = QU.registration_grants(firsts, 2, ahead)
    granted = {r.f.event_id for r in grants.collect()}
    assert granted == {e for e, status in sequential(rows, 2).items() if status == 201}
    assert len(sizes) <= (40 if ahead == 1 else 16)


@pytest.mark.parametrize("window, limit", [(5, 2), (60, 3), (1, 1)])
def test_a_hot_token_is_folded_in_sessions(spark, window, limit):
    """One key with nearly all rows: its sessions lie in several partitions and give the sequential result."""
    import datetime as dt
    import random

    rng = random.Random(7)
    start, at, rows = dt.datetime(2024, 3, 1), 0, []
    for i in range(1500):
        at += rng.choice([0, 0, 1, 1, 2, window, 3 * window, 7200 if i % 200 == 0 else 1])
        rows.append(("hot" if i % 20 else "cold", i, start + dt.timedelta(seconds=at)))
    reqs = spark.createDataFrame(rows, "token string, event_id long, ts timestamp").selectExpr("*", "unix_seconds(ts) sec", "unix_millis(ts) ts_ms")
    got = {r.event_id: (r.slide_ok, r.slide_retry) for r in QU.sliding_and_daily(reqs, window, limit, 10**9).collect()}
    kept, expect = defaultdict(list), {}
    for token, eid, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        s = int(ts.replace(tzinfo=dt.timezone.utc).timestamp())
        now = kept[token] = [x for x in kept[token] if x > s - window]
        if len(now) < limit:
            now.append(s)
            expect[eid] = (True, None)
        else:
            expect[eid] = (False, max(1, now[0] + window - s))
    assert got == expect
    sessions = QU.with_sessions(reqs.groupBy("token", "sec").count(), "token", "sec", window)
    assert sessions.where("token = 'hot'").select("session").distinct().count() > 50


def test_fixed_window_matches_sequential_replay(spark, log):
    limits = RL.model_limits(spark, [(m, lbl, 1, 5) for m, lbl, _, _ in RL.MODEL_LIMITS])
    got = {r["event_id"]: (r["allowed"], r["reason"], r["retry_after_ms"])
           for r in QU.fixed_window_quota(log, limits, (None, 1, 5)).collect()}
    buckets, expect = {}, {}
    for ts, eid, model, ms in sorted((r["ts"], r["event_id"], r["model"], r["ts_ms"]) for r in log.collect()):
        m0, d0 = ms - ms % 60000, ms - ms % 86400000
        b = buckets.get(model)
        minute = b["minute"] if b and b["minute"][0] == m0 else [m0, 0]
        day = b["day"] if b and b["day"][0] == d0 else [d0, 0]
        buckets[model] = {"minute": minute, "day": day}
        if minute[1] >= 1:
            expect[eid] = (False, "rpm", m0 + 60000 - ms)
        elif day[1] >= 5:
            expect[eid] = (False, "rpd", d0 + 86400000 - ms)
        else:
            minute[1] += 1
            day[1] += 1
            expect[eid] = (True, None, None)
    assert got == expect
