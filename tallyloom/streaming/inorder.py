"""Streams whose rows are taken in the order of event time: limits, sessions and KPI histories with event-time timers.

Rows of a key wait in a list state until the watermark has passed them, and are then taken in the order of time
and event_id, so that a stream comes to the same decisions as a sorted table, however its rows are spread over
batches. What the watermark has passed already when it arrives is late and dropped. A key's state goes at the event
time at which it can matter no longer, so that a replay after an outage neither drops it early nor keeps it late. A
stream may start from the states that a table has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import streams
from .streams import BLOCK, LIMITS, Limit, Requests, Sessions


class RateFold:
    """Requests of one user and endpoint."""

    rows = "event_id long, at double, cost int"
    state = "times array<double>, last double, blocked double"
    result = streams.LIMIT_INFO

    def __init__(self, limits):
        self.limits = limits

    def load(self, key, held) -> Requests:
        return Requests(*held) if held else Requests()

    def dump(self, own: Requests) -> tuple:
        return list(own.times), float(own.last), float(own.blocked)

    def step(self, key, own: Requests, row) -> tuple:
        limit = streams._limit_of(self.limits, key[1])
        return (*own.decide(row[1], row[2], limit), *own.info(row[1], limit))

    def until(self, key, own: Requests) -> float:
        return max(0.0, own.last + streams._limit_of(self.limits, key[1]).window, own.blocked)


class SessionFold:
    """Sessions of one user."""

    rows = "event_id long, at double, session_id long, address string, action string"
    state = "ids array<long>, last array<double>, ends array<double>, addresses array<string>, gone array<long>, gone_until array<double>"
    result = streams.SESSION_EVENT

    def load(self, key, held) -> Sessions:
        if not held:
            return Sessions()
        ids, last, ends, addresses, gone, until = held
        return Sessions({k: (a, b, c) for k, a, b, c in zip(ids, last, ends, addresses, strict=True)}, dict(zip(gone, until, strict=True)))

    def dump(self, own: Sessions) -> tuple:
        ids = list(own.held)
        return ids, *([own.held[k][j] for k in ids] for j in range(3)), list(own.revoked), list(own.revoked.values())

    def step(self, key, own: Sessions, row) -> tuple:
        return (row[2], *own.act(row[4], row[2], row[1], row[3]))

    def until(self, key, own: Sessions) -> float:
        return max([*(v[1] for v in own.held.values()), *own.revoked.values()], default=0.0)


#: How many values of a KPI are kept, and of how many the trend is taken.
KEPT, TREND = 50, 10


def trend_of(values: list[float]) -> tuple[float, float, float, float, str]:
    """change, percent, volatility, strength and direction of a few values, as ``kpi.trends`` has them."""
    if len(values) < 3:
        return 0.0, 0.0, 0.0, 0.0, "STABLE"
    v = np.array(values, float)
    x = np.arange(len(v)) - (len(v) - 1) / 2
    change = v[-1] - v[0]
    percent = change * 100 / v[0] if v[0] else 0.0
    mean, spread = v.mean(), v.std()
    volatility = spread / abs(mean) if mean else 0.0
    strength = abs((x * (v - mean)).sum()) / (np.sqrt((x * x).sum()) * spread * np.sqrt(len(v))) if spread else 0.0
    direction = "VOLATILE" if volatility > 0.3 else "STABLE" if abs(percent) < 5 else "UP" if percent > 0 else "DOWN"
    return float(change), float(percent), float(volatility), float(strength), direction


class TrendFold:
    """The latest values of one KPI."""

    rows = "event_id long, at double, value double"
    state = "ats array<double>, kept array<double>"
    result = "kpi_id string, event_id long, at double, value double, points int, change double, percent double, volatility double, strength double, direction string"

    def __init__(self, lasts: float):
        self.lasts = lasts

    def load(self, key, held) -> tuple[list, list]:
        return (list(held[0]), list(held[1])) if held else ([], [])

    def dump(self, own) -> tuple:
        return own

    def step(self, key, own, row) -> tuple:
        ats, kept = own
        ats.append(row[1])
        kept.append(row[2])
        del ats[:-KEPT], kept[:-KEPT]
        return (row[2], len(kept), *trend_of(kept[-TREND:]))

    def until(self, key, own) -> float:
        return own[0][-1] + self.lasts if own[0] else 0.0


class InOrder(StatefulProcessor):
    """Hands the rows of a key to a fold in the order of event time."""

    def __init__(self, fold, keys: int):
        self.fold, self.keys = fold, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.fold.state)
        self.waiting = handle.getListState("waiting", self.fold.rows)
        self.columns = streams._names(self.fold.result)
        self.row_columns = streams._names(self.fold.rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = max(0, timerValues.getCurrentWatermarkInMs())
        for pdf in rows:
            new = [tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in pdf[self.row_columns].itertuples(index=False)]
            new = [(*r[:2], *(None if isinstance(x, float) and np.isnan(x) else x for x in r[2:])) for r in new if int(r[1] * 1000) >= passed]
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(int(min(r[1] for r in new) * 1000))
        yield pd.DataFrame(columns=self.columns).iloc[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in waiting if int(r[1] * 1000) <= passed), key=lambda r: (r[1], r[0]))
        rest = [r for r in waiting if int(r[1] * 1000) > passed]
        own = self.fold.load(key, tuple(self.held.get()) if self.held.exists() else None)
        out = [(*key, r[0], r[1], *self.fold.step(key, own, r)) for r in ready]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(int(min(r[1] for r in rest) * 1000))
        ends = int(self.fold.until(key, own) * 1000) + 1
        if not rest and ends <= passed:
            self.held.clear()
        elif ready:
            self.held.update(self.fold.dump(own))
            self.handle.registerTimer(ends)
        made = pd.DataFrame(out, columns=self.columns)
        for c in ("retry_after", "expires"):
            if c in made:
                made[c] = made[c].astype("Float64")
        yield made.assign(evicted=made["evicted"].astype("Int64")) if "evicted" in made else made

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState[streams._names(self.fold.state)].iloc[0]
        held = tuple(list(x) if isinstance(x, (list, np.ndarray)) else float(x) for x in row)
        self.held.update(held)
        self.handle.registerTimer(int(self.fold.until(key, self.fold.load(key, held)) * 1000) + 1)

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], fold, late: str, started: DataFrame | None) -> DataFrame:
    timed = df.withColumn("_at", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(
        InOrder(fold, len(keys)), fold.result, "append", "EventTime", initialState=started.groupBy(*keys) if started is not None else None
    )


def rate_limited(df: DataFrame, limits: Limit | dict[str, Limit] = LIMITS, late: str = "10 minutes", started: DataFrame | None = None) -> DataFrame:
    """``streams.limit_details`` for a stream of requests; ``started``: states of ``streams.limit_states``."""
    return _run(streams._requests(df, None), ["user_id", "endpoint"], RateFold(limits), late, started)


def session_log(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``streams.session_log`` for a stream of uses and revocations."""
    return _run(streams._uses(df), ["user_id"], SessionFold(), late, None)


def kpi_trends(df: DataFrame, late: str = "10 minutes", lasts: float = 90 * 86_400.0) -> DataFrame:
    """Each new value of a KPI (kpi_id, event_id, ts, value) with the trend of the last TREND; KEPT of them are held, for ``lasts`` seconds."""
    rows = df.select("kpi_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").cast("double").alias("value"))
    return _run(rows, ["kpi_id"], TrendFold(lasts), late, None)
