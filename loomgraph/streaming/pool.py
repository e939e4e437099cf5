"""Pools of open projects: at most so many are open at once, the one used longest ago makes room, idle ones close, and a default stays.

What is open follows from a pool's last calls alone: those projects called last, as
many as there is room for, and not longer ago than the idle time. The batch form looks
from each call no further than that; the stream keeps just these projects as its state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

IDLE_SECONDS, ROOM = 600, 4
IDLE, EVICTED = "idle", "evicted"
_MICROS = 1_000_000

_CLOSED = "pool string, project long, last long, reason string, ended long"  # microseconds
_COLUMNS = ["project", "last", "reason", "ended"]


class Pool:
    """The projects of one pool that are open, with their last call's time (microseconds)."""

    def __init__(self, idle: int, room: int, default: int | None, open_: dict[int, int] | None = None):
        self.idle, self.default = idle, default
        self.room = room if default is None else room - 1  # the default is open from the start
        self.open = dict(open_ or {})

    def close_idle(self, now: int) -> Iterator[tuple[int, int, str, int]]:
        """(project, last call, reason, end) of the projects whose idle time is over."""
        for project, last in sorted(self.open.items(), key=lambda x: (x[1], x[0])):
            if now - last > self.idle:
                del self.open[project]
                yield project, last, IDLE, last + self.idle

    def call(self, project: int, at: int) -> Iterator[tuple[int, int, str, int]]:
        yield from self.close_idle(at)
        if project == self.default:
            return
        if project not in self.open and len(self.open) >= self.room > 0:
            oldest = next(iter(self.open))
            yield oldest, self.open.pop(oldest), EVICTED, at
        self.open.pop(project, None)  # the last one called is the last of the dictionary
        if self.room > 0:
            self.open[project] = at


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros(calls: DataFrame, column: str = "ts") -> Column:
    """A time as microseconds; of one without a zone, as if it were in UTC."""
    return F.unix_micros(column) if calls.schema[column].dataType == TimestampType() else F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {column})")


def _times(closed: DataFrame, calls: DataFrame) -> DataFrame:
    """Microseconds as times of the type that the calls have."""
    at = [F.timestamp_micros(c) if calls.schema["ts"].dataType == TimestampType() else F.expr(f"timestampadd(MICROSECOND, {c}, {_EPOCH})") for c in ("last", "ended")]
    return closed.select("pool", "project", at[0].alias("last_at"), "reason", at[1].alias("ended_at"))


def closings(calls: DataFrame, idle_seconds: int = IDLE_SECONDS, room: int = ROOM, default: int | None = None) -> DataFrame:
    """(pool, project, last_at, reason, ended_at) of all closings up to the last call of all; a batch.

    ``calls`` has pool, project, ts and id; equal times go by id. Null projects and times
    are left out. A pool's calls are cut into spans of the idle time; a task has one span
    and the next, and looks on from each call of the first to what ends it.
    """
    idle = idle_seconds * _MICROS
    rows = calls.where("project is not null and ts is not null").select("pool", "project", "id", _micros(calls).alias("at"))
    now = rows.agg(F.max("at").alias("now"))
    span = F.floor(F.col("at") / idle)
    laid = rows.withColumn("span", F.explode(F.array(span, span - 1))).crossJoin(F.broadcast(now))  # one row

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "id", "project"], kind="stable")
        places = places_of(part["project"].tolist(), part["at"].tolist(), int(part["now"].iloc[0]) if len(part) else 0, int(key[1]), idle, room, default)
        return pd.DataFrame(places, columns=_COLUMNS).assign(pool=key[0])[["pool", *_COLUMNS]]

    return _times(laid.groupBy("pool", "span").applyInPandas(run, _CLOSED), calls)


def places_of(projects: list[int], times: list[int], now: int, span: int, idle: int, room: int, default: int | None) -> list[tuple[int, int, str, int]]:
    """Closings of projects whose last call lies within the span; the calls are those of it and of the next, in order."""
    slots = room if default is None else room - 1
    waiting: dict[int, tuple[int, set[int]]] = {}  # project: its last call, and who was called since
    out = []
    for project, at in zip(projects, times, strict=True):
        for other, (last, since) in list(waiting.items()):
            if at - last > idle:
                out.append((other, last, IDLE, last + idle))
                del waiting[other]
            elif project not in (other, default):
                since.add(project)
                if len(since) >= slots:
                    out.append((other, last, EVICTED, at))
                    del waiting[other]
        if project != default and slots > 0:
            waiting.pop(project, None)
            if at // idle == span:
                waiting[project] = (at, set())
    out += [(p, last, IDLE, last + idle) for p, (last, _) in waiting.items() if now - last > idle]
    return out


class PoolProcessor(StatefulProcessor):
    """State: the open projects, and the calls that the watermark has not reached, which may still be out of order."""

    def __init__(self, idle_seconds: int, room: int, default: int | None):
        self.idle, self.room, self.default = idle_seconds * _MICROS, room, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.open = handle.getListState("open", long("project", "last"))
        self.early = handle.getListState("early", long("at", "id", "project"))
        self.reached = handle.getValueState("reached", long("at"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(i), int(p)) for frame in rows for a, i, p in zip(frame["at"], frame["id"], frame["project"], strict=True)]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, new: list[tuple[int, int, int]], upto: int) -> Iterator[pd.DataFrame]:
        """Takes the calls that the watermark has reached, in order, and closes what has been idle till then."""
        before = self.reached.get()[0] if self.reached.exists() else -1
        known = [tuple(r) for r in self.early.get()] if self.early.exists() else []
        calls = sorted([*known, *(c for c in new if c[0] > before)])  # what comes later than the watermark was late
        pool = Pool(self.idle, self.room, self.default, dict(tuple(r) for r in self.open.get()) if self.open.exists() else {})
        out = []
        for at, _, project in calls:
            if at <= upto:
                out += pool.call(project, at)
        out += pool.close_idle(upto)
        rest = [c for c in calls if c[0] > upto]
        self._put(self.early, rest)
        self._put(self.open, list(pool.open.items()))
        if upto > 0:
            self.reached.update((max(before, upto),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [c[0] // 1000 for c in rest] + [(last + self.idle) // 1000 for last in pool.open.values()]
        if due:
            self.handle.registerTimer(max(min(due) + 1, upto // 1000 + 1))
        yield pd.DataFrame(out, columns=_COLUMNS).assign(pool=key[0])[["pool", *_COLUMNS]]

    @staticmethod
    def _put(state, rows: Iterable[tuple]) -> None:
        rows = list(rows)
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def stream_closings(calls: DataFrame, late: str, idle_seconds: int = IDLE_SECONDS, room: int = ROOM, default: int | None = None) -> DataFrame:
    """The streaming form of ``closings``: closings up to the watermark, which is ``late`` behind the last call.

    Timers close idle projects of pools that get no further calls. Append mode; needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = calls.where("project is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("pool", "project", "id", "ts", _micros(calls).alias("at"))
    return _times(rows.groupBy("pool").transformWithStateInPandas(PoolProcessor(idle_seconds, room, default), _CLOSED, "append", "eventtime"), calls)


def open_projects(calls: DataFrame, idle_seconds: int = IDLE_SECONDS, room: int = ROOM, default: int | None = None) -> DataFrame:
    """(pool, project, last_at, place) of what is open at the last call of all; the default is open always and has place 0."""
    from pyspark.sql import Window

    rows = calls.where("project is not null and ts is not null")
    now = rows.agg(F.max(_micros(calls)).alias("now"))
    last = rows.groupBy("pool", "project").agg(F.max(F.struct("ts", "id")).alias("last")).select("pool", "project", F.col("last.ts").alias("last_at"), F.col("last.id").alias("id"))
    is_default = F.col("project").eqNullSafe(F.lit(default))
    fresh = last.crossJoin(F.broadcast(now)).where(is_default | (F.col("now") - _micros(last, "last_at") <= idle_seconds * _MICROS))  # one row
    place = F.row_number().over(Window.partitionBy("pool", is_default).orderBy(F.desc("last_at"), F.desc("id")))
    ranked = fresh.withColumn("place", F.when(is_default, 0).otherwise(place))
    return ranked.where(F.col("place") <= (room if default is None else room - 1)).select("pool", "project", "last_at", "place")
