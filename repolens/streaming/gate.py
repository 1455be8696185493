"""The request gate as a stream (J4, J6, J7, with J8, J10, J11), on ``transformWithState``.

Checks of one request alone are columns. Everything that depends on earlier requests of
a token is kept in the state store (RocksDB), so one shuffle serves binding, sliding window and
daily count in turn. The operator is grouped by ``BUCKETS`` hashes of the tokens, since a group
costs far more than a token; a bucket's state is a map with an entry a token, of which a
micro-batch reads and writes those of its own tokens:

* the machine that the token is bound to, ``unbound`` or ``any``; the token table is the operator's initial state;
* admitted seconds still inside the sliding window, with their counts;
* admitted requests a day.

Once the watermark has passed the end of a token's day, and of a window begun in it, an event-time timer
forgets what can't matter any more; the binding stays.
A micro-batch's requests are decided in the order of (ts, event_id); rows behind the watermark are
dropped. Requests that no token state can decide are dealt to the buckets by number and keep no state.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from repolens.operators import quota as QU

CARRIED = ("event_id long, ts timestamp, sec long, ts_ms long, machine_id string, body_bytes long, body_json_ok boolean, model string, "
           "provider string, bearer_token string, pre_status int, pre_reason string, fmt_reason string, reach boolean")
VERDICTS = "auth_reason string, slide_ok boolean, slide_retry long, daily_ok boolean, daily_retry long"
NAMES = [c.split()[0] for c in CARRIED.split(", ")]
STATE = "machine string, secs array<long>, counts array<long>, days array<long>, used array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BUCKETS = 1024
UNDECIDED = (None,) * 5


class Token:
    """Binding (J6), sliding window (J3) and daily count (J4) of one token during a micro-batch."""

    def __init__(self, bound, secs=(), counts=(), days=(), used=()):
        self.bound, self.window, self.days = bound, deque(zip(secs, counts)), dict(zip(days, used))
        self.total, self.changed = sum(counts), False

    def decide(self, sec: int, ms: int, machine: str | None, window_s: int, limit: int, daily: int) -> tuple:
        if self.bound == "unbound":
            self.bound, self.changed = machine, True
        if self.bound is None or self.bound not in ("any", machine):
            return "token_not_found" if self.bound is None else "machine_mismatch", None, None, None, None
        self.changed, window = True, self.window
        while window and window[0][0] <= sec - window_s:
            self.total -= window.popleft()[1]
        if self.total >= limit:
            return None, False, max(1, window[0][0] + window_s - sec), False, None
        self.total += 1
        if window and window[-1][0] == sec:
            window[-1] = (sec, window[-1][1] + 1)
        else:
            window.append((sec, 1))
        day = sec // 86400
        self.days[day] = used = self.days.get(day, 0) + 1
        left = (day + 1) * QU.DAY_MS - ms
        return None, True, None, used <= daily, None if used <= daily else max(QU.DAILY_RETRY_MIN_SECONDS, -(-left // 1000))

    def state(self) -> tuple:
        return self.bound, [s for s, _ in self.window], [n for _, n in self.window], list(self.days), list(self.days.values())


class TokenGate(StatefulProcessor):
    """The gate of a bucket of tokens."""

    def __init__(self, window_s: int, limit: int, daily: int):
        self.window_s, self.limit, self.daily = window_s, limit, daily

    def init(self, handle) -> None:
        self.handle, self.swept = handle, set()
        self.tokens = handle.getMapState("tokens", "token string", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for token, state in zip(initialState["token"].tolist(), initialState["state"].tolist()):
            self.tokens.updateValue((token,), Token(state).state())

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        verdicts, met = [], {}
        for reach, token, sec, ms, machine in zip(*(rows[c].tolist() for c in ("reach", "bearer_token", "sec", "ts_ms", "machine_id"))):
            if not reach:
                verdicts.append(UNDECIDED)
                continue
            if token not in met:
                met[token] = Token(*(self.tokens.getValue((token,)) or (None,)))
            # another row's null makes floats of a column's integers
            verdicts.append(met[token].decide(int(sec), int(ms), machine, self.window_s, self.limit, self.daily))
        changed = {token: t for token, t in met.items() if t.changed}
        for token, t in changed.items():
            self.tokens.updateValue((token,), t.state())
        if due := {self._due(t.days) for t in changed.values() if t.days}:
            for at in due - set(self.handle.listTimers()):
                self.handle.registerTimer(at)
        yield self._out(rows, verdicts)

    def _due(self, days) -> int:
        """When a token's window and counts can be forgotten: the same time for all tokens with the same last day."""
        return int((max(days) + 1) * QU.DAY_MS + self.window_s * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if key not in self.swept:  # once a micro-batch, whatever the number of its timers
            self.swept.add(key)
            passed = timerValues.getCurrentWatermarkInMs()
            over = [(token, v[0]) for (token,), v in self.tokens.iterator() if v[3] and self._due(v[3]) <= passed]
            for token, bound in over:
                self.tokens.updateValue((token,), Token(bound).state())
        return iter([])

    def _out(self, rows: pd.DataFrame, verdicts: list[tuple]) -> pd.DataFrame:
        auth, slide, slide_retry, daily, daily_retry = zip(*verdicts)
        return rows[NAMES].assign(auth_reason=list(auth), slide_ok=pd.array(slide, "boolean"), slide_retry=pd.array(slide_retry, "Int64"),
                                  daily_ok=pd.array(daily, "boolean"), daily_retry=pd.array(daily_retry, "Int64"))

    def close(self) -> None:
        pass


def gate_stages_stream(requests: DataFrame, tokens: DataFrame, *, min_version: str = QU.MIN_VERSION, window_s: int = QU.SLIDING_WINDOW_SECONDS,
                       limit: int = QU.SLIDING_MAX_REQUESTS, daily: int = QU.DAILY_TOKEN_LIMIT) -> DataFrame:
    """Verdicts of every request of a stream with a watermark on ``ts``, as ``quota.gate_stages`` gives them for a log."""
    bucket = lambda token: F.pmod(F.xxhash64(token), F.lit(BUCKETS))
    dealt = F.coalesce(F.pmod("event_id", F.lit(BUCKETS)), F.lit(0))
    checked = QU.gate_checks(requests, min_version).select(F.when(F.col("reach"), bucket("bearer_token")).otherwise(dealt).alias("bucket"), *NAMES)
    known = tokens.where("token is not null and state is not null").select(bucket("token").alias("bucket"), "token", "state").groupBy("bucket")
    gated = checked.groupBy("bucket").transformWithStateInPandas(
        TokenGate(window_s, limit, daily), f"{CARRIED}, {VERDICTS}", "append", "eventTime", initialState=known)
    return gated.withColumn("auth_reason", F.coalesce("fmt_reason", "auth_reason")).drop("fmt_reason", "reach")


def request_gate_stream(requests: DataFrame, tokens: DataFrame, *, max_body: int = QU.MAX_BODY_BYTES, allowed: list[str] | None = None,
                        configured_providers=("groq",), **limits) -> DataFrame:
    """J7 streaming: the status of every request as it arrives."""
    return QU.gate_status(gate_stages_stream(requests, tokens, **limits), max_body=max_body, allowed=allowed, configured_providers=configured_providers)


def token_quota_stream(requests: DataFrame, tokens: DataFrame, **limits) -> DataFrame:
    """J6, J3 and J4 streaming: verdicts of the requests that pass the checks before them."""
    return gate_stages_stream(requests, tokens, **limits).where("pre_status is null").select(
        "event_id", F.col("bearer_token").alias("token"), "auth_reason", "slide_ok", "slide_retry", "daily_ok", "daily_retry")
