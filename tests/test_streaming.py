"""Streaming twins replay the same events as the batch operators (availableNow)."""

from pyspark.sql import functions as F

from repolens.operators import audit_log as AL
from repolens.operators import quota as QU
from repolens.sources import request_log as RL
from repolens.streaming import gate as GA
from repolens.streaming import replay as ST

from .conftest import SMALL


def test_sliding_window_stream_equals_batch(spark):
    stream = ST.request_stream(spark, SMALL)
    got = ST.run_available_now(ST.sliding_window_stream(stream, 21600, 2))
    got = {r["event_id"]: (r["slide_ok"], r["slide_retry"]) for r in got.collect()}
    reqs = RL.request_log(spark, SMALL).select("event_id", "token", "sec", "ts", "ts_ms")
    want = {r["event_id"]: (r["slide_ok"], r["slide_retry"])
            for r in QU.sliding_and_daily(reqs, 21600, 2, 10**9).collect()}
    assert got == want


def test_ttl_cache_stream_equals_batch(spark):
    got = ST.run_available_now(ST.ttl_cache_stream(RL.cache_lookups(ST.request_stream(spark, SMALL))))
    got = {r["event_id"]: r["hit"] for r in got.collect()}
    want = {r["event_id"]: r["hit"] for r in QU.ttl_cache_replay(RL.cache_lookups(RL.request_log(spark, SMALL))).collect()}
    assert got == want


def test_fixed_window_stream_equals_batch(spark):
    limits = {m: (1, 5) for m, _, _, _ in RL.MODEL_LIMITS}
    got = ST.run_available_now(ST.fixed_window_stream(ST.request_stream(spark, SMALL), limits, (None, 1, 5)))
    got = {r["event_id"]: (r["allowed"], r["reason"], r["retry_after_ms"]) for r in got.collect()}
    lim = RL.model_limits(spark, [(m, lbl, 1, 5) for m, lbl, _, _ in RL.MODEL_LIMITS])
    want = {r["event_id"]: (r["allowed"], r["reason"], r["retry_after_ms"])
            for r in QU.fixed_window_quota(RL.request_log(spark, SMALL), lim, (None, 1, 5)).collect()}
    assert got == want


def parts(folder, late):
    """The events table as a folder of four part files in order of time, the last with a late row."""
    import datetime as dt
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SMALL}/events.parquet").sort_by("ts")
    n = table.num_rows // 4
    cuts = [table.slice(i * n, n if i < 3 else None) for i in range(4)]
    if late:
        row = cuts[3].slice(5, 1).to_pylist()[0]
        row |= {"event_id": 10**9, "ts": cuts[0].column("ts")[0].as_py() + dt.timedelta(seconds=1)}
        cuts[3] = pa.concat_tables([cuts[3], pa.Table.from_pylist([row], table.schema)])
    target = folder / "events.parquet"
    target.mkdir()
    for i, part in enumerate(cuts):
        pq.write_table(part, target / f"part-{i}.parquet")
        os.utime(target / f"part-{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    return str(folder)


def test_streams_of_many_batches_equal_batch_without_late_rows(spark, tmp_path):
    folder = parts(tmp_path, late=True)
    log = RL.request_log(spark, SMALL)
    stream = lambda: ST.request_stream(spark, folder, max_files=1)
    assert RL.request_log(spark, folder).count() == log.count() + 1

    got = {r.event_id: (r.slide_ok, r.slide_retry) for r in ST.run_available_now(ST.sliding_window_stream(stream(), 21600, 2)).collect()}
    want = QU.sliding_and_daily(log.select("event_id", "token", "sec", "ts", "ts_ms"), 21600, 2, 10**9)
    assert got == {r.event_id: (r.slide_ok, r.slide_retry) for r in want.collect()}

    got = {r.event_id: r.hit for r in ST.run_available_now(ST.ttl_cache_stream(RL.cache_lookups(stream()))).collect()}
    assert got == {r.event_id: r.hit for r in QU.ttl_cache_replay(RL.cache_lookups(log)).collect()}

    limits = {m: (1, 5) for m, _, _, _ in RL.MODEL_LIMITS}
    got = {r.event_id: (r.allowed, r.reason, r.retry_after_ms) for r in ST.run_available_now(ST.fixed_window_stream(stream(), limits, (None, 1, 5))).collect()}
    lim = RL.model_limits(spark, [(m, lbl, 1, 5) for m, lbl, _, _ in RL.MODEL_LIMITS])
    want = QU.fixed_window_quota(log, lim, (None, 1, 5))
    assert got == {r.event_id: (r.allowed, r.reason, r.retry_after_ms) for r in want.collect()}


def test_audit_sink_appends_by_date(spark, tmp_path):
    stream = ST.request_stream(spark, parts(tmp_path, late=False), max_files=2)
    decided = stream.select("ts", "token", "model", F.when(F.col("sig_ok"), 200).otherwise(401).alias("status"),
                            F.when(F.col("sig_ok"), "forwarded").otherwise("invalid_signature").alias("reason"))
    query = ST.append_audit_events(AL.gate_records(decided), str(tmp_path / "audit"), str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.json(str(tmp_path / "audit"))
    log = RL.request_log(spark, SMALL)
    assert out.count() == log.count() and out.where("action = 'api_call'").count() == log.where("sig_ok").count()
    assert out.select("date").distinct().count() == log.select(F.to_date("ts")).distinct().count()


def test_minute_usage_stream_counts_all_windows(spark, tmp_path):
    folder = parts(tmp_path, late=False)
    got = ST.run_updates(ST.minute_usage_stream(ST.request_stream(spark, folder, "1 minute", max_files=1)), ["window", "model"])
    minute = F.date_trunc("minute", "ts").alias("minute")
    want = RL.request_log(spark, SMALL).groupBy(minute, "model").agg(F.count("*").alias("requests"))
    found = sorted((r.window.start, r.model, r.requests) for r in got.collect())
    assert found == sorted((r.minute, r.model, r.requests) for r in want.collect())


def test_gate_stream_of_many_batches_equals_batch_without_late_rows(spark, tmp_path):
    """Four micro-batches: bindings, windows and daily counts go on from batch to batch; the late row of the last one is dropped."""
    folder = parts(tmp_path, late=True)
    tokens = RL.token_states(spark, SMALL).where("token not like '%7'")
    limits = {"window_s": 21600, "limit": 2, "daily": 3}
    stream = GA.request_gate_stream(ST.request_stream(spark, folder, max_files=1), tokens, **limits)
    got = ST.run_available_now(stream, provider=GA.ROCKSDB)
    want = QU.request_gate(RL.request_log(spark, SMALL), tokens, **limits)
    columns = ["event_id", "status", "reason", "retry_after"]
    found = sorted(map(str, got.select(columns).collect()))
    assert found == sorted(map(str, want.select(columns).collect()))
    assert {"rate_limited", "machine_mismatch", "token_not_found", "forwarded"} <= {r.reason for r in got.collect()}


def test_gate_state_is_forgotten_but_bindings_stay(spark, tmp_path):
    """A token is bound by its first machine; days later its window and counts are gone, its binding isn't."""
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pq.read_schema(f"{SMALL}/events.parquet")
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 30), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)]
    (tmp_path / "events.parquet").mkdir()
    import os
    for i, t in enumerate(at):
        row = {"event_id": 97 * 1009 if i == 3 else 1009 + 100 * i, "ts": t, "user_id": 3, "event_type": "view"}
        pq.write_table(pa.Table.from_pylist([{n: row.get(n) for n in schema.names}], schema), tmp_path / "events.parquet" / f"part-{i}.parquet")
        os.utime(tmp_path / "events.parquet" / f"part-{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    tokens = spark.createDataFrame([("ptai_" + "3".zfill(20), "unbound")], "token string, state string")
    stream = GA.gate_stages_stream(ST.request_stream(spark, str(tmp_path), max_files=1), tokens, window_s=60, limit=1, daily=5)
    got = [(r.auth_reason, r.slide_ok, r.slide_retry) for r in ST.run_available_now(stream, provider=GA.ROCKSDB).orderBy("ts").collect()]
    assert got == [(None, True, None), (None, False, 30), (None, True, None), ("machine_mismatch", None, None)]


class Handle:
    """A map state and timers in memory, for one bucket."""

    def __init__(self):
        self.map, self.timers, self.calls = {}, set(), []

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls.append(("get", key[0]))
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls.append(("put", key[0]))
        self.map[key] = value

    def iterator(self):
        self.calls.append(("all", None))
        return iter(list(self.map.items()))

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        assert at not in self.timers
        self.timers.add(at)


def test_a_call_of_the_gate_decides_many_tokens_with_one_read_and_one_write_each():
    from types import SimpleNamespace

    import pandas as pd

    day, hour = 19_700 * 86400, 3600
    gate, handle = GA.TokenGate(60, 1, 5), Handle()
    gate.init(handle)
    gate.handleInitialState((7,), pd.DataFrame({"token": ["a", "b", "c"], "state": ["unbound", "any", "m"]}), None)
    handle.calls.clear()
    plan = [(None, day), ("a", day + hour), ("b", day + hour), ("b", day + hour + 1), ("c", day + 25 * hour), ("c", day + 26 * hour), ("x", day + 26 * hour)]
    rows = pd.DataFrame({n: [None] * len(plan) for n in GA.NAMES}).assign(
        event_id=range(len(plan)), bearer_token=[t for t, _ in plan], reach=[t is not None for t, _ in plan], machine_id=["m"] * len(plan),
        sec=[s for _, s in plan], ts_ms=[s * 1000 for _, s in plan], ts=[pd.Timestamp(s, unit="s") for _, s in plan])
    (out,) = gate.handleInputRows((7,), iter([rows.iloc[3:], rows.iloc[:3]]), None)
    assert [None if pd.isna(v) else bool(v) for v in out["slide_ok"]] == [None, True, True, False, True, True, None]
    assert out["auth_reason"].tolist()[-1] == "token_not_found" and out["slide_retry"].tolist()[3] == 59
    assert sorted(handle.calls) == [("get", t) for t in "abcx"] + [("put", t) for t in "abc"]
    ends = [(day + n * 86400) * 1000 + 60_000 for n in (1, 2)]
    assert handle.timers == set(ends) and handle.map["a",][0] == "m"

    handle.calls.clear()
    for at in ends:  # the watermark is past the first day alone, though both timers are called
        list(gate.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: ends[0]), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert sorted(handle.calls) == [("all", None), ("put", "a"), ("put", "b")]
    assert handle.map["a",] == ("m", [], [], [], []) and handle.map["c",][3:] == ([19_701], [2])


def test_gate_stream_of_tokens_in_one_bucket_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(GA, "BUCKETS", 1)
    limits = {"window_s": 21600, "limit": 2, "daily": 3}
    tokens = RL.token_states(spark, SMALL)
    got = ST.run_available_now(GA.request_gate_stream(ST.request_stream(spark, parts(tmp_path, late=False), max_files=1), tokens, **limits), provider=GA.ROCKSDB)
    want = QU.request_gate(RL.request_log(spark, SMALL), tokens, **limits)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) != []


def test_token_quota_stream_writes_the_verdicts_alone(spark, tmp_path):
    """The rows that fail the checks before, and the columns of later gates, leave within the stream."""
    limits = {"window_s": 21600, "limit": 2, "daily": 3}
    tokens = RL.token_states(spark, SMALL)
    stream = GA.token_quota_stream(ST.request_stream(spark, parts(tmp_path, late=False), max_files=2), tokens, **limits)
    columns = ["event_id", "token", "auth_reason", "slide_ok", "slide_retry", "daily_ok", "daily_retry"]
    assert stream.isStreaming and stream.columns == columns
    want = QU.gate_stages(RL.request_log(spark, SMALL), tokens, **limits).where("pre_status is null").withColumnRenamed("bearer_token", "token")
    got = ST.run_available_now(stream, whole=True, provider=GA.ROCKSDB)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect())) != []


def test_model_calls_meet_their_answers_over_many_batches(spark, tmp_path):
    folder = parts(tmp_path, late=False)
    got = ST.run_available_now(ST.model_call_stream(spark, folder, max_files=1), whole=True)
    log = RL.request_log(spark, SMALL)
    want = AL.call_records(RL.model_calls(log), RL.model_answers(log))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ends = got.where("duration_ms is not null")
    assert {r.action for r in ends.collect()} == {"analysis_complete", "analysis_failed"} and ends.agg(F.max("duration_ms")).first()[0] < 90_000


def test_registration_stream_of_many_batches_equals_batch(spark, tmp_path):
    folder = parts(tmp_path, late=False)
    requests = ST.request_stream(spark, folder, max_files=1)
    got = ST.run_registrations(requests, per_day=1)
    want = QU.registration_limit(RL.request_log(spark, SMALL), 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert {r.status for r in got.collect()} == {200, 201, 400, 403, 429}
    again = requests.unionByName(ST.request_stream(spark, folder, max_files=1))  # every request delivered twice
    assert ST.run_registrations(again, per_day=1).count() == got.count()


def test_replays_of_files_in_any_order_are_whole(spark, tmp_path, monkeypatch):
    """Files that each span the whole period, a file a batch."""
    import pyarrow.parquet as pq
    import pytest

    from repolens.plans import queries as Q

    table = pq.read_table(f"{SMALL}/events.parquet").sort_by("ts")
    (tmp_path / "events.parquet").mkdir()
    for i in range(6):
        pq.write_table(table.take(list(range(5 - i, table.num_rows, 6))), tmp_path / "events.parquet" / f"part-{i}.parquet")
    folder, replayed = str(tmp_path), ST.replayed
    with pytest.raises(RuntimeError, match="dropped"):
        ST.run_available_now(ST.sliding_window_stream(ST.request_stream(spark, folder, max_files=1)), whole=True)
    monkeypatch.setattr(ST, "replayed", lambda *a, **k: replayed(*a, **k, max_files=1))
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))  # a split a file, so several ranges
    try:
        for query in (Q.q_sliding_window_stream, Q.q_ttl_cache_stream, Q.q_fixed_window_stream, Q.q_minute_usage_stream):
            got, want = query(spark, folder), query(spark, SMALL)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_days_of_a_model_are_counted_apart(spark, tmp_path):
    """A row of the day before, late but within the watermark, doesn't reset the count of the new day."""
    import datetime as dt
    import os

    day = dt.datetime(2024, 3, 2)
    batches = [[(1, day + dt.timedelta(minutes=10)), (2, day - dt.timedelta(minutes=20))],
               [(3, day - dt.timedelta(minutes=5)), (4, day + dt.timedelta(minutes=20))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, t, "m") for e, t in rows], "event_id long, ts timestamp, model string").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        part = next(f for f in os.listdir(f"{tmp_path}/w{i}") if f.startswith("part-"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.link(f"{tmp_path}/w{i}/{part}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("event_id long, ts timestamp, model string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log = stream.selectExpr("*", "unix_millis(ts) ts_ms").withWatermark("ts", "1 day")
    got = {r.event_id: (r.allowed, r.reason) for r in ST.run_available_now(ST.fixed_window_stream(log, {"m": (5, 1)})).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "rpd"), 4: (False, "rpd")}
