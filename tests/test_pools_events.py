"""Pools of open projects against a plain simulation, in batch and as a stream; events of all kinds and those that fit none."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.sources.tables import scratch
from loomgraph.streaming import events as E
from loomgraph.streaming import pool as P

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(seed, n=400, pools=3, projects=7, gap=70):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(0, 2 * gap, n) * (1 + 8 * (rng.random(n) < 0.02)))
    return [(f"p{rng.integers(pools)}", int(rng.integers(projects)), int(i), START + timedelta(seconds=int(t))) for i, t in enumerate(at)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pool string, project long, id long, ts timestamp")


def simulated(rows, idle, room, default, now):
    """Each pool by itself: a list in the order of use, as a server would keep it."""
    out = []
    for name in sorted({r[0] for r in rows}):
        opened: list[list] = []
        slots = room - (default is not None)

        def sweep(at, name=name, opened=opened):
            for entry in list(opened):
                if (at - entry[1]).total_seconds() > idle:
                    opened.remove(entry)
                    out.append((name, entry[0], entry[1], "idle", entry[1] + timedelta(seconds=idle)))

        for _, project, _, at in sorted((r for r in rows if r[0] == name), key=lambda r: (r[3], r[2])):
            sweep(at)
            if project == default:
                continue
            mine = next((e for e in opened if e[0] == project), None)
            if mine:
                opened.remove(mine)
            elif len(opened) >= slots:
                gone = opened.pop(0)
                out.append((name, gone[0], gone[1], "evicted", at))
            opened.append([project, at])
        sweep(now)
    return sorted(out)


def plain(df):
    return sorted((r["pool"], r["project"], r["last_at"].astimezone(timezone.utc), r["reason"], r["ended_at"].astimezone(timezone.utc)) for r in df.collect())


@pytest.mark.parametrize(("idle", "room", "default"), [(600, 4, None), (600, 4, 2), (3_000, 3, 0), (60, 4, 1), (100_000, 4, 5)])
def test_closings_match_a_simulation(spark, idle, room, default):
    rows = made(idle + room)
    calls = frame(spark, [*rows, ("p0", None, 1, START), ("p0", 1, 2, None)]).repartition(3)
    want = simulated(rows, idle, room, default, max(r[3] for r in rows))
    assert plain(P.closings(calls, idle, room, default)) == want and len(want) > 3
    left = {(r["pool"], r["project"]): r["place"] for r in P.open_projects(calls, idle, room, default).collect()}
    ended = {}
    for name, project, last, *_ in want:
        ended[name, project] = last
    latest = {}
    for name, project, _, at in sorted(rows, key=lambda r: r[3]):
        latest[name, project] = at
    assert set(left) == {k for k, at in latest.items() if k[1] == default or ended.get(k) != at}
    assert {p for (_, project), p in left.items() if project == default} <= {0}


def test_no_calls(spark):
    assert P.closings(frame(spark, [])).collect() == [] and P.open_projects(frame(spark, [])).collect() == []


def test_a_stream_that_is_restarted_closes_as_a_batch_does(spark):
    rows = made(3, n=240)
    rng = np.random.default_rng(0)
    path, at = scratch(spark, "calls"), scratch(spark, "stream")
    out = scratch(spark, "closed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        order = sorted(range(len(rows)), key=lambda i: rows[i][2] + rng.uniform(-4, 4))  # a little out of order
        for k in range(4):
            frame(spark, [rows[i] for i in order[60 * k : 60 * k + 60]]).coalesce(1).write.mode("append").parquet(path)
            stream = P.stream_closings(spark.readStream.schema("pool string, project long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path), "30 minutes", 600, 4, 2)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    reached = max(r[3] for r in rows) - timedelta(minutes=30)
    want = simulated([r for r in rows if r[3] <= reached], 600, 4, 2, reached)
    got = plain(spark.read.parquet(out))
    assert got == want and {r[3] for r in got} == {"idle", "evicted"}


# ---------------------------------------------------------------- events

VALUES = {"text": "x", "flag": True, "u8": 255, "u32": 2**32 - 1, "u64": 2**64 - 1, "f64": 0.5}


def payload(kind, **changed):
    out = {"type": kind, "more": [1, {"a": 2}]}
    for name, t in E.KINDS[kind]:
        where, _, last = name.rpartition(".")
        (out.setdefault(where, {}) if where else out)[last] = VALUES[t.rstrip("?")]
    return out | changed


CASES = [(payload(k), k, None) for k in E.KINDS] + [
    (payload("tool_executed", success="true"), "tool_executed", "field success"), (payload("tool_executed", duration_ms=-1), "tool_executed", "field duration_ms"), (payload("tool_executed", duration_ms=2**64), "tool_executed", "field duration_ms"),
    (payload("tool_executed", duration_ms="5"), "tool_executed", "field duration_ms"), (payload("tool_executed", duration_ms=1.5), "tool_executed", "field duration_ms"), (payload("warning", tier=256), "warning", "field tier"), (payload("blocked", type="guard_blocked"), "blocked", None),
    (payload("session_started", task=None), "session_started", "field task"), ({"type": "session_started", "model_id": "m"}, "session_started", "field task"), ({"type": "session_started"}, "session_started", "field task"),
    (payload("llm_response_received", usage={"input_tokens": 1}), "llm_response_received", "field usage.output_tokens"), (payload("llm_response_received", usage=None), "llm_response_received", "field usage.input_tokens"),
    (payload("turn_cost_updated", remaining_budget_usd=None), "turn_cost_updated", None), (payload("turn_cost_updated", cumulative_cost_usd=3), "turn_cost_updated", None), (payload("turn_cost_updated", remaining_budget_usd="1"), "turn_cost_updated", "field remaining_budget_usd"),
    ({"type": "turn_cost_updated", "turn": 1, "input_tokens": 1, "output_tokens": 0, "cumulative_cost_usd": 1e-9}, "turn_cost_updated", None), ({"type": "other"}, "other", "unknown type"), ({"type": 7}, None, "no type"), ({"kind": "x"}, None, "no type"), ([1], None, "no type"),
]


def test_events_of_all_kinds(spark):
    rows = [(i, START, json.dumps(p)) for i, (p, _, _) in enumerate(CASES)] + [(900, START, "{broken"), (901, START, None), (902, START, ""), (903, START, '{"type": "file_indexed", "path": "ä\\n", "symbols_found": 0} x')]
    found = E.read_events(spark.createDataFrame(rows, "id long, ts timestamp, payload string"))
    got = {r["id"]: (r["kind"], r["reason"], r["event"]) for r in found.collect()}
    for i, (_, kind, reason) in enumerate(CASES):
        assert got[i][:2] == (kind, reason) and (got[i][2] is None) == (reason is not None), CASES[i]
    assert [got[i][:2] for i in (900, 901, 902, 903)] == [(None, "not json")] * 4
    assert len(E.KINDS) == 19
    tools = E.of_kind(found, "tool_executed", "id").collect()
    assert [r.asDict() for r in tools] == [{"id": 4, "tool_name": "x", "success": True, "duration_ms": 2**64 - 1}]
    usage = E.of_kind(found, "llm_response_received").collect()
    assert [r["usage_cache_write_tokens"] for r in usage] == [2**64 - 1]
    assert {r["event"]["remaining_budget_usd"] for r in found.where("kind = 'turn_cost_updated' and reason is null").collect()} == {0.5, None}


def test_events_of_a_stream(spark):
    rows = [(START + timedelta(minutes=7 * i), json.dumps(p)) for i, (p, _, _) in enumerate(CASES)]
    path, name = scratch(spark, "events"), "events_of_a_stream"
    df = spark.createDataFrame(rows, "ts timestamp, payload string")
    df.coalesce(1).write.parquet(path)
    stream = E.counted(E.read_events(spark.readStream.schema(df.schema).parquet(path)), "1 hour", "1 minute")
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    whole = sorted(map(str, map(tuple, E.counted(E.read_events(df), "1 hour").collect())))
    assert sorted(map(str, map(tuple, spark.table(name).collect()))) == whole
    assert E.counted(E.read_events(df)).agg(F.sum("events")).first()[0] == len(CASES)
