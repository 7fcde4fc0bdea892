"""Notices of keyed state in event time: a change of state, and once a day the state itself.

Micro-batches may bring events in any order. Events wait in list state until the watermark has passed them; an event-time timer then
takes those that are final, in order of (key, time, id), through the state, and sets itself for the next. So the notices are those of the
events in order, however they arrived. Events that come later than the watermark allows are dropped by the engine before they reach the state
(`numRowsDroppedByWatermark` of the query's progress counts them). A key without events for `idle` is forgotten: its next event starts anew,
with the day's notice and no change.

State is kept by shards of keys (a hash of the key), not by single keys: a call of the state costs about as much for a column of values as for one, and a
shard's events are taken through it as columns. The number of shards is part of the state, so it stays the same for the life of a checkpoint.

Events that the watermark hasn't passed when a stream stops stay in the checkpoint. `unsettled` reads them there, with each key's last state, and
gives the notices they would cause as things stand; a restart gives them for good.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

NOTICES = "key long, kind string, event_id long, us long, before string, now string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 4096
_DAY = 86_400_000_000
_NONE = -(2**63)  # a null key or event_id within the state
_LATEST = datetime.datetime(2262, 1, 1, tzinfo=datetime.UTC)  # of the times that pandas takes; later ones count as this one for the watermark only


def _joined(parts: list[tuple], n: int) -> list[np.ndarray]:
    """Columns of several pieces put together: n of longs, then the states."""
    return [np.array([v for p in parts for v in p[i]], np.int64) for i in range(n)] + [np.array([v for p in parts for v in p[n]], np.str_)]


class Notices(StatefulProcessor):
    """Input: shard, at (timestamp with watermark), key, us (microseconds since 1970), event_id, state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "key array<long>, us array<long>, event_id array<long>, state array<string>")
        self.last = handle.getValueState("last", "key array<long>, us array<long>, state array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = []
        for r in rows:
            if r["us"].isna().any():
                raise ValueError("an event without a time has no place in the order")
            self.pending.appendValue(tuple(r[c].tolist() for c in ("key", "us", "event_id", "state")))
            first.append(int(r["us"].min()))
        if first:
            self._wake(min(first) // 1000 + 1)
        return iter(())

    def _wake(self, ms: int) -> None:
        """One timer a shard: the earliest needed."""
        for t in list(self.handle.listTimers()):
            if t <= ms:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        k, us, ids, state = _joined(list(self.pending.get()), 3)
        final = us // 1000 < mark
        out, last = self._settle(k[final], us[final], ids[final], state[final])
        rest = ~final
        wake = None
        if rest.any():
            self.pending.put([(k[rest].tolist(), us[rest].tolist(), ids[rest].tolist(), state[rest].tolist())])
            wake = max(int(us[rest].min()) // 1000 + 1, mark + 1)
        else:
            self.pending.clear()
        kept = last[1] // 1000 + self.idle_ms >= mark
        if kept.any():
            self.last.update(tuple(c[kept].tolist() for c in last))
            wake = wake or int(last[1][kept].min()) // 1000 + self.idle_ms + 1
        else:
            self.last.clear()
        if wake:
            self.handle.registerTimer(wake)
        return iter([out] if len(out) else [])

    def _settle(self, k: np.ndarray, us: np.ndarray, ids: np.ndarray, state: np.ndarray) -> tuple[pd.DataFrame, list[np.ndarray]]:
        """The notices of final events, and each key's last time and state after them."""
        old_k, old_us, old_state = _joined([self.last.get()] if self.last.exists() else [], 2)
        new = np.arange(len(old_k) + len(k)) >= len(old_k)
        k, us, ids, state = np.append(old_k, k), np.append(old_us, us), np.append(np.zeros_like(old_k), ids), np.append(old_state, state)
        order = np.lexsort((state, ids, us, new, k))
        k, us, ids, state, new = k[order], us[order], ids[order], state[order], new[order]
        begins = np.append(True, k[1:] != k[:-1])[: len(k)]
        seen, before = np.roll(us, 1), np.roll(state, 1)
        fresh = begins | (us - seen > self.idle_ms * 1000)
        daily = new & (fresh | (us // _DAY != seen // _DAY))
        change = new & ~fresh & (state != before)
        at = np.append(np.flatnonzero(daily), np.flatnonzero(change))
        kind = np.repeat(np.array(["daily", "change"], object), (daily.sum(), change.sum()))
        out = pd.DataFrame({"key": k[at], "kind": kind, "event_id": ids[at], "us": us[at], "before": np.where(fresh, None, before.astype(object))[at], "now": state[at].astype(object)})
        ends = np.append(begins[1:], True)[: len(k)]
        return out, [k[ends], us[ends], state[ends]]

    def close(self) -> None:
        pass


def prepared(events: DataFrame, edge: float) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("key"), at.alias("at"), F.unix_micros(at).alias("us"), "event_id", F.when(F.col("value") > edge, "HIGH").otherwise("LOW").alias("state"))


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(_NONE)).alias(c)


def notices(events: DataFrame, edge: float = 100.0, late: str = "1 day", idle_days: int = 30, shards: int = SHARDS) -> DataFrame:
    """Stream of notices: value above the edge or not, by user."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    known = [F.coalesce(c, F.lit(_NONE)).alias(c) for c in ("key", "event_id")]
    e = prepared(events, edge).select(shard, F.least("at", F.lit(_LATEST)).alias("at"), known[0], "us", known[1], "state").withWatermark("at", late)
    out = e.groupBy("shard").transformWithStateInPandas(Notices(idle_days * 86_400_000), NOTICES, "append", "EventTime")
    return out.select(_known("key"), "kind", _known("event_id"), F.timestamp_micros("us").alias("at"), "before", "now")


def in_order(events: DataFrame, last: DataFrame | None = None, idle_days: int = 30) -> DataFrame:
    """The notices of a finished table of prepared events; last: key, state, day, us of what came before."""
    idle = idle_days * _DAY
    rows = events.select("key", "us", "event_id", "state", F.lit(False).alias("old"))
    if last is not None:
        rows = rows.unionByName(last.select("key", "us", F.lit(None).cast("long").alias("event_id"), "state", F.lit(True).alias("old")))
    w = Window.partitionBy("key").orderBy(F.col("old").desc(), "us", "event_id")
    seen = F.lag("us").over(w)
    fresh = seen.isNull() | (F.col("us") - seen > idle)
    day = F.floor(F.col("us") / _DAY)
    rows = rows.select("key", "us", "event_id", "old", F.col("state").alias("now"), F.when(~fresh, F.lag("state").over(w)).alias("before"), (fresh | (day != F.floor(seen / _DAY))).alias("first"))
    kinds = F.array_compact(F.array(F.when(F.col("first"), F.lit("daily")), F.when(F.col("before") != F.col("now"), F.lit("change"))))
    out = rows.where(~F.col("old")).select("key", F.explode(kinds).alias("kind"), "event_id", F.timestamp_micros("us").alias("at"), "before", "now")
    return out.select("key", "kind", "event_id", "at", "before", "now")


def unsettled(spark: SparkSession, checkpoint: str, idle_days: int = 30) -> DataFrame:
    """Notices of events that wait in a stopped stream's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint)

    def rows(name: str, value: str, *columns: str) -> DataFrame:
        lists = F.arrays_zip(*(F.col(f"{value}.{c}").alias(c) for c in columns))
        return state.option("stateVarName", name).load().select(F.inline(lists)).withColumns({c: _known(c) for c in columns if c in ("key", "event_id")})

    return in_order(rows("pending", "list_element", "key", "us", "event_id", "state"), rows("last", "value", "key", "us", "state"), idle_days)
