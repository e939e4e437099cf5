"""Telemetry of tool calls as streams: running counts, idle sessions, repeats, running cost.

Each has a batch form with the same result over a finished stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

IDLE = "10 minutes"
REPEATS = 4


def read_calls(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 500) -> DataFrame:
    """Calls from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def call_counts(calls: DataFrame) -> DataFrame:
    """Running number of calls for each project and tool."""
    return calls.groupBy("project", "tool").agg(F.count("*").alias("calls"))


def total_counts(calls: DataFrame) -> DataFrame:
    """Calls for each project, and of all together (null); a batch table."""
    return calls.rollup("project").agg(F.count("*").alias("calls"))


def idle_sessions(calls: DataFrame, idle: str = IDLE, late: str | None = None) -> DataFrame:
    """Sessions of a project, which ``idle`` time without a call ends; ``late`` is the watermark of a stream."""
    rows = calls.withWatermark("ts", late) if late else calls
    return rows.groupBy("project", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("calls")).select("project", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls")


def most_recent(calls: DataFrame, keep: int = 4) -> DataFrame:
    """The ``keep`` projects called last, which stay open."""
    last = calls.groupBy("project").agg(F.max("ts").alias("last_ts"))
    return last.orderBy(F.desc("last_ts"), "project").limit(keep).withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_ts"), "project")))


def stream_most_recent(calls: DataFrame, keep: int = 4) -> DataFrame:
    """The streaming form of ``most_recent``, in complete mode: state is one row a project."""
    return calls.groupBy("project").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "project").limit(keep)


def latest_state(calls: DataFrame) -> DataFrame:
    """Each project's last call; of a stream too (complete or update mode)."""
    last = F.max(F.struct("ts", "id", "tool", "value"))
    return calls.groupBy("project").agg(last.alias("s")).select("project", F.col("s.id").alias("id"), F.col("s.tool").alias("tool"), F.col("s.value").alias("value"))


def repeated_calls(calls: DataFrame, least: int = REPEATS) -> DataFrame:
    """Runs of ``least`` or more calls of one tool after another within a project."""
    order = Window.partitionBy("project").orderBy("ts", "id")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("project", "tool").orderBy("ts", "id"))
    runs = calls.withColumn("island", island).groupBy("project", "tool", "island").agg(F.count("*").alias("run"), F.min("id").alias("first_id"), F.min("ts").alias("first_ts"))
    return runs.where(F.col("run") >= least).select("project", "tool", "run", "first_ts")


def running_cost(calls: DataFrame) -> DataFrame:
    """Cost of a project's calls up to each."""
    order = Window.partitionBy("project").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.select("id", "project", F.round(F.sum("value").over(order), 4).alias("running_cost"), F.count("*").over(order).alias("turn"))


def event_kinds(calls: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Calls by day and kind; ``late`` is the watermark of a stream, which then gives closed windows."""
    calls = calls.withWatermark("ts", late) if late else calls
    return calls.groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), "tool", "calls")


def stream_running_cost(calls: DataFrame) -> DataFrame:
    """The streaming form of ``running_cost``: each call with its project's cost and turns so far.

    State is two numbers a project; the calls of a trigger are taken in their order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cost, turn = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        rows = rows.assign(running_cost=(cost + rows["value"].fillna(0).cumsum()).round(4), turn=range(turn + 1, turn + 1 + len(rows)))
        state.update((cost + float(rows["value"].fillna(0).sum()), turn + len(rows)))
        yield rows[["id", "project", "running_cost", "turn"]]

    return calls.groupBy("project").applyInPandasWithState(step, "id long, project long, running_cost double, turn long", "cost double, turn long", "append", GroupStateTimeout.NoTimeout)


def stream_repeats(calls: DataFrame, least: int = REPEATS) -> DataFrame:
    """The streaming form of ``repeated_calls``: a row when a run reaches ``least`` calls.

    State is a project's last tool and how often it has come in a row; the calls of a
    trigger are taken in their order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tool, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        found = []
        for at, name in zip(rows["ts"], rows["tool"], strict=True):
            run = run + 1 if name == tool else 1
            tool = name
            if run == least:
                found.append((key[0], name, at))
        state.update((tool, run))
        yield pd.DataFrame(found, columns=["project", "tool", "reached_ts"])

    return calls.groupBy("project").applyInPandasWithState(step, "project long, tool string, reached_ts timestamp", "tool string, run long", "append", GroupStateTimeout.NoTimeout)
