"""Structured Streaming twins of the request-log operators (J1, J2, J3, J5, J9, A7); the gate's are in ``gate``.

The request log arrives as a file stream over the table's folder of part files;
the derivation of header fields is the same function as in batch. Per-key
sequential decisions keep their state in Spark's state store through
``applyInPandasWithState`` with an event-time timeout: Spark drops rows older than
the watermark, each micro-batch hands a key's new rows (sorted inside the
function by ``ts, event_id``) together with the key's state, and a key
without rows for longer than its state can matter is forgotten. Results equal a
sequential replay of the rows that are not late.

* J3: state = admitted seconds still inside the window, kept for one window;
* J9: state = (created, version) of the cache entry, kept for its time to live;
* J1: state = (minute start, count, day's count) per model and day, kept to the day's end: counts begin anew with a day,
  so days of a model are decided apart, and a task holds one day's rows of a model at a time;
* J2: tumbling one-minute windows per model with a watermark, in update mode: every micro-batch
  writes the new counts of the windows it touched, and the last count of a window is its result, closed or not;
* J5: repeated deliveries leave by ``dropDuplicatesWithinWatermark``; machine and IP couple attempts, so
  a micro-batch is decided as a log is, after the grants of earlier ones, which are a table;
* A7: audit records appended as JSON, partitioned by date; the start and the end of a model call meet by a stream-stream interval join.

``max_files`` or ``MAX_BYTES`` bounds a micro-batch. The registered replays (``replayed``) feed a whole table in
the order of event time, whatever its files, and fail if Spark dropped a row as late. J1 has one key a model and day, which is the operator's
own meaning: a model's requests of a day are decided one after the other.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from repolens.operators import audit_log as AL
from repolens.operators import quota as QU
from repolens.session import checkpointed, ensure_checkpoint_dir
from repolens.sources import request_log as RL
from repolens.sources.tables import read_table, table_path

MAX_BYTES = 256 << 20


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """A file stream over one table: a folder of part files, or a single file."""
    schema = read_table(spark, sf_dir, name).schema
    path = table_path(sf_dir, name)
    bound = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", MAX_BYTES)
    reader = spark.readStream.schema(schema).option(*bound)
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).isFile():  # streams read folders
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def ranged_by_time(spark: SparkSession, sf_dir: str, name: str = "events") -> str:
    """A folder under the shared checkpoint folder that holds the table in ranges of ``ts``, a file each, their times of
    modification in the same order, which is the order in which a file stream reads them."""
    folder = f"{ensure_checkpoint_dir(spark)}/ranges-{uuid.uuid4().hex}"
    table = read_table(spark, sf_dir, name)
    table.repartitionByRange(max(1, table.rdd.getNumPartitions()), "ts").write.parquet(path := table_path(folder, name))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = fs.getFileStatus(at).getModificationTime() // 1000 * 1000 - 1000 * len(files)
    for i, file in enumerate(files):
        fs.setTimes(file, first + 1000 * i, -1)
    times = [fs.getFileStatus(file).getModificationTime() for file in files]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise RuntimeError(f"{path}: the store doesn't keep times of modification, so a stream can't read the ranges in order")
    return folder


def request_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour", max_files: int | None = None) -> DataFrame:
    return RL.derive_request_log(event_stream(spark, sf_dir, max_files=max_files)).withWatermark("ts", watermark)


def _ordered(pdfs) -> pd.DataFrame | None:
    """A key's rows of one micro-batch in the order of decision."""
    frames = list(pdfs)
    return pd.concat(frames).sort_values(["ts", "event_id"], kind="stable") if frames else None


def _keep_until(state, ms: int) -> None:
    """Forget the key once the watermark has passed ``ms``."""
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


# ---- J3: sliding window per token -------------------------------------------------------

SLIDE_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("token", T.StringType()),
                          T.StructField("slide_ok", T.BooleanType()), T.StructField("slide_retry", T.LongType())])
SLIDE_STATE = T.StructType([T.StructField("secs", T.ArrayType(T.LongType())),
                            T.StructField("counts", T.ArrayType(T.LongType()))])


def _slide_state_fn(window_s: int, limit: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        window = deque(zip(*state.get)) if state.exists else deque()
        total = sum(c for _, c in window)
        rows = _ordered(pdfs)
        if rows is None:
            return
        ids, oks, retries = rows["event_id"].tolist(), [], []
        for s in rows["sec"].tolist():
            while window and window[0][0] <= s - window_s:
                total -= window.popleft()[1]
            ok = total < limit
            oks.append(ok)
            retries.append(None if ok else max(1, window[0][0] + window_s - s))
            if ok:
                total += 1
                if window and window[-1][0] == s:
                    window[-1] = (s, window[-1][1] + 1)
                else:
                    window.append((s, 1))
        state.update(([s for s, _ in window], [c for _, c in window]))
        _keep_until(state, (s + window_s) * 1000)
        yield pd.DataFrame({"event_id": ids, "token": key[0], "slide_ok": oks,
                            "slide_retry": pd.array(retries, dtype="Int64")})
    return fn


def sliding_window_stream(requests: DataFrame, window_s: int = QU.SLIDING_WINDOW_SECONDS,
                          limit: int = QU.SLIDING_MAX_REQUESTS) -> DataFrame:
    """J3 over a stream of requests that reached the limiter (token, sec, ts, event_id)."""
    return requests.select("token", "event_id", "sec", "ts").groupBy("token").applyInPandasWithState(
        _slide_state_fn(window_s, limit), SLIDE_OUT, SLIDE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- J9: TTL cache ---------------------------------------------------------------------

CACHE_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("key", T.StringType()),
                          T.StructField("hit", T.BooleanType())])
CACHE_STATE = T.StructType([T.StructField("created", T.LongType()), T.StructField("version", T.StringType())])


def _cache_state_fn(ttl_ms: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        created, ver = state.get if state.exists else (None, None)
        rows = _ordered(pdfs)
        if rows is None:
            return
        hits = []
        for t, v in zip(rows["ts_ms"].tolist(), rows["version"].tolist()):
            hit = created is not None and v == ver and t - created <= ttl_ms
            if not hit:
                created, ver = t, v
            hits.append(hit)
        state.update((created, ver))
        _keep_until(state, created + ttl_ms + 1)
        yield pd.DataFrame({"event_id": rows["event_id"].tolist(), "key": key[0], "hit": hits})
    return fn


def ttl_cache_stream(lookups: DataFrame, ttl_ms: int = QU.CACHE_TTL_MS) -> DataFrame:
    return lookups.select("key", "event_id", "ts_ms", "ts", "version").groupBy("key").applyInPandasWithState(
        _cache_state_fn(ttl_ms), CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- J1: fixed windows per model ---------------------------------------------------------

FW_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("model", T.StringType()),
                       T.StructField("allowed", T.BooleanType()), T.StructField("reason", T.StringType()),
                       T.StructField("retry_after_ms", T.LongType())])
FW_STATE = T.StructType([T.StructField("m0", T.LongType()), T.StructField("mc", T.LongType()), T.StructField("dc", T.LongType())])


def _fixed_state_fn(limits: dict, default: tuple):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        m0, mc, dc = state.get if state.exists else (None, 0, 0)
        rows = _ordered(pdfs)
        if rows is None:
            return
        (rpm, rpd), d0 = limits.get(key[0], default[1:]), int(key[1])
        oks, reasons, retries = [], [], []
        for ms in rows["ts_ms"].tolist():
            if m0 != ms - ms % QU.MINUTE_MS:
                m0, mc = ms - ms % QU.MINUTE_MS, 0
            if mc >= rpm:
                oks.append(False), reasons.append("rpm"), retries.append(m0 + QU.MINUTE_MS - ms)
            elif dc >= rpd:
                oks.append(False), reasons.append("rpd"), retries.append(d0 + QU.DAY_MS - ms)
            else:
                mc, dc = mc + 1, dc + 1
                oks.append(True), reasons.append(None), retries.append(None)
        state.update((m0, mc, dc))
        _keep_until(state, d0 + QU.DAY_MS)
        yield pd.DataFrame({"event_id": rows["event_id"].tolist(), "model": key[0], "allowed": oks, "reason": reasons,
                            "retry_after_ms": pd.array(retries, dtype="Int64")})
    return fn


def fixed_window_stream(requests: DataFrame, limits: dict[str, tuple[int, int]] | None = None,
                        default: tuple = RL.DEFAULT_LIMITS) -> DataFrame:
    """J1 streaming: ``limits`` maps model -> (rpm, rpd); unlisted models use ``default``."""
    limits = limits if limits is not None else {m: (rpm, rpd) for m, _, rpm, rpd in RL.MODEL_LIMITS}
    day = F.col("ts_ms") - F.col("ts_ms") % QU.DAY_MS
    return requests.select("model", day.alias("day"), "event_id", "ts", "ts_ms").groupBy("model", "day").applyInPandasWithState(
        _fixed_state_fn(limits, default), FW_OUT, FW_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- J5: registrations --------------------------------------------------------------------

def run_registrations(requests: DataFrame, per_day: int = QU.REGISTRATIONS_PER_IP_DAY, whole: bool = False) -> DataFrame:
    """J5 over a stream of attempts with a watermark, driven to its end: the status of every attempt.

    A micro-batch writes its grants and rows to folders of its own number and reads the grants of earlier numbers, so it can be tried again."""
    spark = requests.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    grants = "ip string, day long, machine_id string, f struct<ts: timestamp, event_id: long>, used int, batch long"

    def decide(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        attempts = checkpointed(QU.registration_attempts(rows))
        known = session.read.schema(grants).parquet(f"{folder}/grants/part=*").where(F.col("batch") < batch) if batch else session.createDataFrame([], grants)
        used = known.groupBy("ip", "day").agg(F.count("*").cast("int").alias("used"))
        fresh = attempts.where("refused is null").join(known.select("machine_id"), "machine_id", "left_anti")
        firsts = QU.first_attempts(fresh).join(used, ["ip", "day"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
        new = QU.registration_grants(firsts, per_day).withColumn("batch", F.lit(batch).cast("long")).select("ip", "day", "machine_id", "f", "used", "batch")
        new.write.mode("overwrite").parquet(f"{folder}/grants/part={batch}")
        new = session.read.schema(grants).parquet(f"{folder}/grants/part={batch}")
        QU.registration_status(attempts, known.unionByName(new)).write.mode("overwrite").parquet(f"{folder}/rows/part={batch}")

    once = requests.dropDuplicatesWithinWatermark(["event_id"])
    _drive(once.writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/checkpoint"), whole)
    return spark.read.schema("event_id long, ip string, machine_id string, status int").parquet(f"{folder}/rows/part=*")


# ---- J2 + A7 --------------------------------------------------------------------------------

def minute_usage_stream(requests: DataFrame) -> DataFrame:
    """J2 streaming: requests per model and one-minute window (closed windows in append mode, touched ones in update mode)."""
    return requests.groupBy(F.window("ts", "1 minute"), "model").agg(F.count(F.lit(1)).alias("requests"))


def run_updates(df: DataFrame, key: list[str], whole: bool = False) -> DataFrame:
    """Drive an aggregation to its end in update mode: the last row of every key, windows still open among them.

    Each micro-batch replaces its own folder, so a batch that is tried again counts once."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def upsert(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/part={batch}")

    _drive(df.writeStream.foreachBatch(upsert).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint"), whole)
    values = [c for c in df.columns if c not in key]
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/rows/part=*")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*key, "last.*")


def model_call_stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """A7 streaming: starts and ends of model calls; the answers are a stream of their own with its own watermark."""
    calls = RL.model_calls(request_stream(spark, sf_dir, watermark, max_files))
    answers = RL.model_answers(RL.derive_request_log(event_stream(spark, sf_dir, max_files=max_files)))
    return AL.call_records(calls, answers.withWatermark("answered", watermark))


def append_audit_events(events: DataFrame, path: str, checkpoint: str):
    """A7 sink: append-only JSON, partitioned by date, exactly-once through the checkpoint."""
    return (events.writeStream.format("json").outputMode("append").partitionBy("date")
            .option("path", path).option("checkpointLocation", checkpoint))


def _drive(writer, whole: bool) -> None:
    """Run a streaming query to its end. ``whole``: fail if the watermark dropped rows."""
    query = writer.trigger(availableNow=True).start()
    dropped: dict[int, int] = {}
    ended = False
    while not ended:  # Spark keeps the progress of the last batches only
        ended = query.awaitTermination(1)
        for p in query.recentProgress:
            dropped[p.batchId] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
    if whole and (late := sum(dropped.values())):
        raise RuntimeError(f"the watermark dropped {late} rows as late; the replay is not whole")


def run_available_now(df: DataFrame, whole: bool = False, provider: str | None = None) -> DataFrame:
    """Drive a streaming query to its end (``availableNow``) into Parquet in the shared checkpoint folder; read it back.

    ``whole``: fail if the watermark dropped rows. ``provider``: the state store's, if the query needs another than the session's."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema, store = df.schema, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    if provider:
        spark.conf.set(store, provider)
    try:
        _drive(df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
               .option("checkpointLocation", f"{folder}/checkpoint"), whole)
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def replayed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], watermark: str = "1 hour",
             max_files: int | None = None, run: Callable[..., DataFrame] = run_available_now, **options) -> DataFrame:
    """``build`` of the stream of all requests of a table, in the order of event time."""
    stream = request_stream(spark, ranged_by_time(spark, sf_dir), watermark, max_files)
    return run(build(stream), whole=True, **options)
