"""Structured Streaming forms: windows with watermarks, stateful limits, change detection, routing."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.io import EVENTS


def events(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream of the event files in a folder, with ``ts`` as an instant."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_kpis(df: DataFrame, length: str = "1 hour", step: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """count, avg, min, max and latest value per window and key; rows later than ``late`` are dropped."""
    source = df.withWatermark("ts", late) if df.isStreaming else df
    window = F.window("ts", length, step or length)
    return source.groupBy(window.alias("w"), *keys).agg(
        F.count("*").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("latest")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "count", "avg", "min", "max", "latest")


def daily_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    source = df.withWatermark("ts", "1 day") if df.isStreaming else df
    return source.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("accesses")).select(F.col("w.start").alias("day"), *keys, "accesses")


def stale_clients(df: DataFrame, client: str = "user_id", idle: str = "5 minutes") -> DataFrame:
    """Each stretch of activity of a client and the time at which it counts as gone."""
    source = df.withWatermark("ts", idle) if df.isStreaming else df
    return source.groupBy(client, F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("events")).select(client, F.col("s.start").alias("first"), F.col("s.end").alias("gone_at"), "events")


def routed(df: DataFrame, subscribers: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events to subscribers (subscriber, types): those of the type, or all for an empty list; an equi-join on types."""
    everything = "\x00all"
    wanted = subscribers.withColumn("_type", F.explode(F.when(F.size("types") == 0, F.array(F.lit(everything))).otherwise(F.array_distinct("types"))))
    offered = df.withColumn("_type", F.explode(F.array(F.col(kind), F.lit(everything))))
    return offered.join(wanted, "_type").drop("_type")


def routed_boards(df: DataFrame, subscribers: DataFrame, kind: str = "event_type", board: str = "dashboard_id") -> DataFrame:
    """Events to subscribers (subscriber, types, dashboard_id) of the type and the dashboard, each pair once.

    No types, and a blank or null dashboard on either side, mean all of them. The cases exclude each other, and
    each is a key of its own: an event without a dashboard goes to ``all``, which every subscriber takes; one with a
    dashboard goes to its own and to ``open``, which those without one take. What is left is an equi-join.
    """
    everything, of_all, open_ = "\x00all", "\x00every board", "\x00open board"
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    own = F.concat(F.lit("="), F.col(board).cast("string"))
    wanted = subscribers.select(
        "subscriber", F.explode(F.when(F.coalesce(F.size("types"), F.lit(0)) <= 0, F.array(F.lit(everything))).otherwise(F.array_distinct("types"))).alias("_type"),
        F.when(blank("dashboard_id"), F.array(F.lit(open_), F.lit(of_all))).otherwise(F.array(F.concat(F.lit("="), F.col("dashboard_id").cast("string")), F.lit(of_all))).alias("_boards"),
    ).withColumn("_board", F.explode("_boards")).drop("_boards")
    offered = df.withColumn("_type", F.explode(F.array(F.col(kind), F.lit(everything)))).where("_type IS NOT NULL")
    offered = offered.withColumn("_board", F.explode(F.when(blank(board), F.array(F.lit(of_all))).otherwise(F.array(own, F.lit(open_)))))
    return offered.join(wanted, ["_type", "_board"]).drop("_type", "_board")


def alert_events(df: DataFrame, limit: float, kind: Column | None = None) -> DataFrame:
    bad = F.col("event_type") == "error" if kind is None else kind
    return df.where(bad | (F.col("value") >= limit))


def threshold_alerts(df: DataFrame, thresholds: DataFrame, name: str, value: str, risk: str | None = None, result: str | None = None) -> DataFrame:
    """Rows with their ``severity`` (critical, high, failed or warning, the gravest that holds); others are left out.

    ``thresholds``: name, critical_low, warning_low, warning_high, critical_high (null is none); a value at a
    threshold breaches it. Works on streams, joined to a table of thresholds.
    """
    v = F.col(value)
    hit = lambda low, high: F.coalesce(v <= F.col(low), F.lit(False)) | F.coalesce(v >= F.col(high), F.lit(False))
    severity = F.when(hit("critical_low", "critical_high"), "critical")
    if risk:
        severity = severity.when(F.col(risk).isin("high", "critical"), "high")
    if result:
        severity = severity.when(F.col(result).isin("failure", "error"), "failed")
    severity = severity.when(hit("warning_low", "warning_high"), "warning")
    return df.join(thresholds.withColumnRenamed("name", name), name, "left").withColumn("severity", severity).where("severity IS NOT NULL").select(*df.columns, "severity")


# --- rate limit ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Limit:
    """``requests`` in ``window`` seconds, ``burst`` beyond them, and a block of ``BLOCK`` seconds for hasty excess."""

    requests: int
    window: float = 3600.0
    burst: int = 0


# The limits of each class of endpoint; api for all others.
LIMITS = {"upload": Limit(10, burst=2), "export": Limit(50, burst=5), "chat": Limit(100, burst=10), "dashboard": Limit(20, burst=3), "api": Limit(1000, burst=50)}
BLOCK = 60.0
DECISION = "user_id long, endpoint string, event_id long, at double, allowed boolean, reason string"


class Requests:
    """What one user did at one endpoint: times of allowed requests in the window, and the end of a block."""

    def __init__(self, times=(), last: float = -math.inf, blocked: float = -math.inf):
        self.times, self.last, self.blocked = deque(times), last, blocked

    def decide(self, at: float, cost: int, limit: Limit) -> tuple[bool, str]:
        if at < self.blocked:
            return False, "blocked"
        while self.times and self.times[0] <= at - limit.window:
            self.times.popleft()
        if len(self.times) + cost > limit.requests + limit.burst:
            if at - self.last >= 1:
                return False, "limit"
            self.blocked = at + BLOCK
            return False, "blocked"
        self.times.extend([at] * cost)
        self.last = at
        return True, "ok"

    def info(self, at: float, limit: Limit) -> tuple[int, int, float, float | None]:
        """limit, what remains of it without the burst, when the oldest request stops to count, and the whole seconds that a block still lasts."""
        while self.times and self.times[0] <= at - limit.window:
            self.times.popleft()
        reset = (self.times[0] if self.times else at) + limit.window
        return limit.requests, max(0, limit.requests - len(self.times)), reset, float(int(self.blocked - at)) if at < self.blocked else None


LIMIT_INFO = DECISION + ", request_limit int, remaining int, reset_at double, retry_after double"


def _limit_of(limits, endpoint: str) -> Limit:
    return limits if isinstance(limits, Limit) else limits.get(endpoint, limits["api"])


def _requests(df: DataFrame, cost: Column | None) -> DataFrame:
    return df.select("user_id", F.col("event_type").alias("endpoint"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.lit(1) if cost is None else cost).cast("int").alias("cost"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def rate_limited(df: DataFrame, limits: Limit | dict[str, Limit] = LIMITS, cost: Column | None = None) -> DataFrame:
    """Decisions for a table of requests, in the order of time and event_id of each user and endpoint.

    Requests pass sorted; a task keeps the allowed times of one window of one user and endpoint.
    """
    return limit_details(df, limits, cost).select(*_names(DECISION))


def limit_details(df: DataFrame, limits: Limit | dict[str, Limit] = LIMITS, cost: Column | None = None) -> DataFrame:
    """The same with what a caller is told after each request: limit, remaining, reset_at and retry_after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Requests()
        for pdf in batches:
            out = []
            for user, endpoint, event_id, at, c in pdf.itertuples(index=False):
                if (user, endpoint) != key:
                    key, state = (user, endpoint), Requests()
                limit = _limit_of(limits, endpoint)
                out.append((user, endpoint, event_id, at, *state.decide(at, c, limit), *state.info(at, limit)))
            made = pd.DataFrame(out, columns=_names(LIMIT_INFO))
            yield made.assign(retry_after=made["retry_after"].astype("Float64"))

    asked = _requests(df, cost)
    return asked.repartition("user_id", "endpoint").sortWithinPartitions("user_id", "endpoint", "at", "event_id").mapInPandas(run, LIMIT_INFO)


STATE = "user_id long, endpoint string, times array<double>, last double, blocked double"


def limit_states(df: DataFrame, limits: Limit | dict[str, Limit] = LIMITS, cost: Column | None = None) -> DataFrame:
    """What is held of each user and endpoint after all requests of a table: the state that a stream may start from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Requests()
        for pdf in batches:
            out = []
            for user, endpoint, _, at, c in pdf.itertuples(index=False):
                if (user, endpoint) != key:
                    if key is not None:
                        out.append((*key, list(state.times), state.last, state.blocked))
                    key, state = (user, endpoint), Requests()
                state.decide(at, c, _limit_of(limits, endpoint))
            yield pd.DataFrame(out, columns=_names(STATE))
        if key is not None:
            yield pd.DataFrame([(*key, list(state.times), state.last, state.blocked)], columns=_names(STATE))

    asked = _requests(df, cost)
    return asked.repartition("user_id", "endpoint").sortWithinPartitions("user_id", "endpoint", "at", "event_id").mapInPandas(run, STATE)


def user_statistics(states: DataFrame, at: float, limits: dict[str, Limit] = LIMITS) -> DataFrame:
    """Of every user and class of endpoint at a time: limit, remaining, reset_at, retry_after; classes without requests too."""
    rows = [F.struct(F.lit(k).alias("endpoint"), F.lit(v.requests).alias("request_limit"), F.lit(v.window).alias("window"), F.lit(v.burst).alias("burst")) for k, v in limits.items()]
    users = states.select("user_id").distinct().select("user_id", F.inline(F.array(*rows)))
    held = F.filter("times", lambda t: t > F.lit(at) - F.col("window"))
    return users.join(states, ["user_id", "endpoint"], "left").withColumn("held", F.coalesce(held, F.array().cast("array<double>"))).select(
        "user_id", "endpoint", "request_limit", F.greatest(F.lit(0), F.col("request_limit") - F.size("held")).alias("remaining"),
        (F.coalesce(F.get("held", F.lit(0)), F.lit(float(at))) + F.col("window")).alias("reset_at"),
        F.when(F.lit(at) < F.col("blocked"), F.floor(F.col("blocked") - at).cast("double")).alias("retry_after"),
    )


def rate_limited_stream(df: DataFrame, limits: Limit | dict[str, Limit] = LIMITS, cost: Column | None = None) -> DataFrame:
    """Decisions for a stream at once: requests are ordered within a batch only. ``inorder.rate_limited`` waits for the watermark instead."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit = _limit_of(limits, key[1])
        own = Requests(*state.get) if state.exists else Requests()
        out = []
        for event_id, at, c in pd.concat(list(batches)).sort_values(["at", "event_id"])[["event_id", "at", "cost"]].itertuples(index=False):
            out.append((*key, event_id, at, *own.decide(float(at), int(c), limit)))
        state.update((list(own.times), own.last, own.blocked))
        state.setTimeoutDuration(int(1000 * (limit.window + BLOCK)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    return _requests(df, cost).groupBy("user_id", "endpoint").applyInPandasWithState(run, DECISION, "times array<double>, last double, blocked double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def quota(df: DataFrame, limit: int) -> DataFrame:
    """Requests of the last hour, what remains, and the seconds until the oldest of them no longer counts, at each request."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy(at).rangeBetween(-3_600_000_000, 0)
    return df.select(
        "event_id", "user_id", "event_type", F.count("*").over(w).alias("used"), ((F.min(at).over(w) + 3_600_000_000 - at) / 1e6).alias("reset_after")
    ).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


# --- sessions -------------------------------------------------------------------------------------

#: Seconds that a session lasts, the rest of them below which a use renews it, and how many a user may have.
SESSION, RENEW, MOST_SESSIONS = 86_400.0, 3_600.0, 5
SESSION_EVENT = "user_id long, event_id long, at double, session_id long, outcome string, ip_differs boolean, expires double, evicted long"


class Sessions:
    """The open sessions of one user: session_id to (last use, end, address); revoked: session_id to the end it would have had."""

    def __init__(self, held: dict | None = None, revoked: dict | None = None):
        self.held, self.revoked = dict(held or {}), dict(revoked or {})

    def revoke(self, session_id: int | None, at: float, everything: bool = False) -> str:
        """End one session, or all but that one; revoked if any was open."""
        self.revoked = {k: end for k, end in self.revoked.items() if end >= at}
        gone = [k for k, v in self.held.items() if v[1] >= at and (k != session_id if everything else k == session_id)]
        for k in gone:
            self.revoked[k] = self.held.pop(k)[1]
        return "revoked" if gone else "unknown"

    def act(self, action: str | None, session_id: int, at: float, address: str) -> tuple[str, bool, float | None, int | None]:
        """A use (also for no action), ``revoke`` or ``revoke_others``; a session that was revoked is refused until its end."""
        if action in ("revoke", "revoke_others"):
            return self.revoke(session_id, at, action == "revoke_others"), False, None, None
        if self.revoked.get(session_id, -math.inf) >= at:
            return "refused", False, None, None
        return self.use(session_id, at, address)

    def use(self, session_id: int, at: float, address: str) -> tuple[str, bool, float | None, int | None]:
        """Outcome (created, used, renewed or expired), another address, end, and the session that had to go."""
        if session_id in self.held:
            last, end, first = self.held[session_id]
            if at > end:
                del self.held[session_id]
                return "expired", False, None, None
            renewed = end - at < RENEW
            end = at + SESSION if renewed else end
            self.held[session_id] = (at, end, first)
            return "renewed" if renewed else "used", address != first, end, None
        self.held = {k: v for k, v in self.held.items() if v[1] >= at}
        evicted = min(self.held, key=lambda k: (self.held[k][0], k)) if len(self.held) >= MOST_SESSIONS else None
        self.held.pop(evicted, None)
        self.held[session_id] = (at, at + SESSION, address)
        return "created", False, at + SESSION, evicted


def _uses(df: DataFrame) -> DataFrame:
    """user_id, event_id, at, session_id, address and action of a table that has ``ts`` and the rest, action or not."""
    action = F.col("action") if "action" in df.columns else F.lit(None).cast("string").alias("action")
    return df.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("session_id").cast("long"), "address", action)


def session_log(df: DataFrame) -> DataFrame:
    """What becomes of each use of a session, in the order of time and event_id of each user; a task keeps the sessions of one user."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, own = None, Sessions()
        for pdf in batches:
            out = []
            for u, event_id, at, session_id, address, action in pdf.itertuples(index=False):
                if u != user:
                    user, own = u, Sessions()
                out.append((u, event_id, at, session_id, *own.act(action, session_id, at, address)))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in SESSION_EVENT.split(", ")])
            yield made.assign(evicted=made["evicted"].astype("Int64"), expires=made["expires"].astype("Float64"))

    return _uses(df).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, SESSION_EVENT)


def session_log_stream(df: DataFrame) -> DataFrame:
    """What becomes of uses in a stream, at once: they are ordered within a batch only. ``inorder.session_log`` waits for the watermark instead."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *held, gone, until = state.get if state.exists else ([],) * 6
        own = Sessions({k: (a, b, c) for k, a, b, c in zip(*held, strict=True)}, dict(zip(gone, until, strict=True)))
        out = []
        for event_id, at, session_id, address, action in pd.concat(list(batches)).sort_values(["at", "event_id"])[["event_id", "at", "session_id", "address", "action"]].itertuples(index=False):
            out.append((*key, event_id, at, session_id, *own.act(action, session_id, at, address)))
        ids = list(own.held)
        state.update((ids, *([own.held[k][j] for k in ids] for j in range(3)), list(own.revoked), list(own.revoked.values())))
        state.setTimeoutDuration(int(1000 * (SESSION + RENEW)))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in SESSION_EVENT.split(", ")])
        yield made.assign(evicted=made["evicted"].astype("Int64"), expires=made["expires"].astype("Float64"))

    schema = "ids array<long>, last array<double>, ends array<double>, addresses array<string>, gone array<long>, gone_until array<double>"
    return _uses(df).groupBy("user_id").applyInPandasWithState(run, SESSION_EVENT, schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


# --- change detection and refresh ---------------------------------------------------------------


def fingerprint(df: DataFrame) -> tuple:
    """Row count and order-free hash of the contents."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return (tuple(df.columns), row["n"], row["h"])


class Refresher:
    """foreachBatch handler that calls ``action`` only for contents other than the last."""

    def __init__(self, action):
        self.action, self.last = action, None

    def __call__(self, batch: DataFrame, batch_id: int) -> bool:
        now = fingerprint(batch)
        if now == self.last:
            return False
        self.last = now
        self.action(batch, batch_id)
        return True
