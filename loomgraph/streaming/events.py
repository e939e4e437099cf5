"""Events of sessions as a tagged union: each kind has fields of its own, and what fits no kind is set aside with the reason."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = (("input_tokens", "u64"), ("output_tokens", "u64"), ("cache_read_tokens", "u64"), ("cache_write_tokens", "u64"))
#: The kinds with their fields; a question mark means that a field may be missing or null.
KINDS: dict[str, tuple[tuple[str, str], ...]] = {
    "session_started": (("task", "text"), ("model_id", "text")),
    "session_completed": (("outcome", "text"), ("total_turns", "u32")),
    "llm_request_sent": (("model_id", "text"), ("estimated_tokens", "u64")),
    "llm_response_received": (("model_id", "text"), *((f"usage.{n}", t) for n, t in _TOKENS), ("stop_reason", "text")),
    "tool_executed": (("tool_name", "text"), ("success", "flag"), ("duration_ms", "u64")),
    "escalation_raised": (("status", "text"), ("reason", "text")),
    "context_compacted": (("tokens_before", "u64"), ("tokens_after", "u64")),
    "context_compaction_triggered": (("context_pct", "u32"), ("messages_count", "u32")),
    "circuit_broken": (("consecutive_failures", "u32"), ("last_error", "text")),
    "provider_switched": (("from_model", "text"), ("to_model", "text")),
    "doom_loop_detected": (("tool_name", "text"), ("consecutive_count", "u32")),
    "file_indexed": (("path", "text"), ("symbols_found", "u32")),
    "index_completed": (("files_processed", "u32"), ("total_symbols", "u32"), ("duration_ms", "u64")),
    "warning": (("tool_name", "text"), ("tier", "u8"), ("message", "text")),
    "blocked": (("tool_name", "text"), ("tier", "u8"), ("reason", "text")),
    "context_tool_called": (("tool_name", "text"), ("success", "flag"), ("duration_ms", "u64")),
    "token_delta": (("delta", "text"), ("turn", "u32"), ("chars_so_far", "u64")),
    "turn_cost_updated": (("turn", "u32"), ("input_tokens", "u32"), ("output_tokens", "u32"), ("cumulative_cost_usd", "f64"), ("remaining_budget_usd", "f64?")),
    "stream_error": (("error", "text"), ("turn", "u32"), ("will_retry", "flag")),
}
#: Tags of these kinds may have a product's name before them.
_NAMED = r"^[a-z0-9]+_(warning|blocked|context_tool_called)$"
_SQL_TYPES = {"text": "string", "flag": "boolean", "u8": "long", "u32": "long", "u64": "decimal(20,0)", "f64": "double"}
_MOST = {"u8": 2**8 - 1, "u32": 2**32 - 1, "u64": 2**64 - 1}


def fields() -> dict[str, str]:
    """Every field of any kind with its SQL type; fields of one name have one type but for their range."""
    out: dict[str, str] = {}
    for parts in KINDS.values():
        for name, kind in parts:
            sql = _SQL_TYPES[kind.rstrip("?")]
            out[name] = sql if out.get(name, sql) == sql else "decimal(20,0)"
    return out


def _fits(payload: Column, name: str, kind: str) -> Column:
    """Whether a field is there, of its type, and in its range."""
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    found, base = F.schema_of_variant(value), kind.rstrip("?")
    whole = found.isin("BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$")
    if base == "text":
        ok = found == "STRING"
    elif base == "flag":
        ok = found == "BOOLEAN"
    elif base == "f64":
        ok = whole | found.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    else:
        ok = whole & F.try_variant_get(payload, f"$.{name}", "decimal(38,0)").between(F.lit(0), F.lit(Decimal(_MOST[base])))
    ok = F.coalesce(ok, F.lit(False))
    return (F.coalesce(found == "VOID", F.lit(True)) | ok) if kind.endswith("?") else ok


def read_events(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with ``kind``, ``event`` (a struct of every kind's fields; those of other kinds are null) and ``reason``.

    ``reason`` is null where the JSON text fits its kind, and else ``not json``, ``no type``,
    ``unknown type`` or ``field`` and the name of the first that is missing, of another type
    or out of range; ``event`` is null then. Fields that a kind doesn't know are ignored. Works on streams too.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))  # what follows a value would be a second one
    parsed = rows.withColumn("_payload", F.when(F.schema_of_variant(F.try_variant_get(listed, "$[1]", "variant")).isNull(), F.try_variant_get(listed, "$[0]", "variant")))
    tag = F.try_variant_get(F.col("_payload"), "$.type", "variant")
    kind = F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get(F.col("_payload"), "$.type", "string"))
    parsed = parsed.withColumn("kind", F.regexp_replace(kind, _NAMED, "$1"))

    pairs = sorted({part for parts in KINDS.values() for part in parts})  # each is judged once, whatever the kind
    bad = F.array_compact(F.array(*[F.when(~_fits(F.col("_payload"), *part), F.lit(":".join(part))) for part in pairs]))
    parsed = parsed.withColumn("_bad", bad)
    wanted = F.create_map(*[x for k, parts in KINDS.items() for x in (F.lit(k), F.array(*[F.lit(":".join(p)) for p in parts]))])
    wanted = F.try_element_at(wanted, F.col("kind"))
    first = F.get(F.filter(wanted, lambda part: F.array_contains("_bad", part)), F.lit(0))
    reason = F.when(F.col("_payload").isNull(), "not json").when(F.col("kind").isNull(), "no type").when(wanted.isNull(), "unknown type").otherwise(F.concat(F.lit("field "), F.split_part(first, F.lit(":"), F.lit(1))))
    parsed = parsed.withColumn("reason", reason)
    owners = {name: [k for k, parts in KINDS.items() if name in dict(parts)] for name in fields()}
    values = [F.when(F.col("kind").isin(owners[name]), F.try_variant_get(F.col("_payload"), f"$.{name}", sql)).alias(name.replace(".", "_")) for name, sql in fields().items()]
    return parsed.withColumn("event", F.when(F.col("reason").isNull(), F.struct(*values))).drop("_payload", "_bad")


def of_kind(events: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Events of one kind: the columns ``keep``, and its own fields."""
    return events.where((F.col("kind") == kind) & F.col("reason").isNull()).select(*keep, *[F.col(f"event.{n.replace('.', '_')}").alias(n.replace(".", "_")) for n, _ in KINDS[kind]])


def counted(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, kind, reason, events): by time, kind and why they were set aside; ``late`` is the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    known = F.when(F.col("kind").isin(list(KINDS)), F.col("kind"))
    return rows.groupBy(F.window("ts", window).alias("w"), known.alias("kind"), "reason").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "kind", "reason", "events")
