"""Streams replayed from files give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.tables import scratch
from loomgraph.streaming import telemetry as T


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(i, i % 3, ["read", "read", "read", "read", "write"][i // 3 % 5], 1_700_000_000 + 97 * i + (5000 if i > 40 else 0), float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, project long, tool string, at long, value double").select("id", "project", "tool", F.timestamp_seconds("at").alias("ts"), "value")


def replay(spark, calls, make, mode):
    path = scratch(spark, "calls")
    for k in range(3):  # files are taken in the order of their times
        calls.where((F.col("id") >= 20 * k) & (F.col("id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(path)
    stream = make(T.read_calls(spark, path, calls.schema, 1))
    name = f"t{path[-8:]}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_counts(spark, calls):
    assert replay(spark, calls, T.call_counts, "complete") == sorted(tuple(r) for r in T.call_counts(calls).collect())


def test_sessions(spark, calls):
    whole = sorted(tuple(r) for r in T.idle_sessions(calls).collect())
    closed = replay(spark, calls, lambda c: T.idle_sessions(c, late="1 minute"), "append")
    assert len(whole) == 6 and set(closed) <= set(whole) and len(closed) == 3


def test_repeats(spark, calls):
    batch = sorted((r["project"], r["tool"]) for r in T.repeated_calls(calls).collect())
    assert [r[:2] for r in replay(spark, calls, T.stream_repeats, "append")] == batch and batch


def test_running_cost_latest_and_recent(spark, calls):
    batch = sorted((r["id"], r["project"], r["running_cost"], r["turn"]) for r in T.running_cost(calls).collect())
    assert replay(spark, calls, T.stream_running_cost, "append") == batch
    assert replay(spark, calls, T.latest_state, "complete") == sorted(tuple(r) for r in T.latest_state(calls).collect())
    assert replay(spark, calls, T.stream_most_recent, "complete") == sorted(tuple(r)[:2] for r in T.most_recent(calls).collect())


def test_closed_windows(spark, calls):
    whole = sorted(tuple(r) for r in T.event_kinds(calls, "30 minutes").collect())
    closed = replay(spark, calls, lambda c: T.event_kinds(c, "30 minutes", late="1 minute"), "append")
    assert closed and set(closed) < set(whole)
