"""Scalar rules of the trace model as SQL text and as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event types that the model knows.
EVENT_TYPES = (
    "run.started", "run.completed", "run.failed", "run.observed", "model.requested", "model.completed", "model.failed", "tool.requested",
    "tool.completed", "tool.failed", "decision.recorded", "state.changed", "checkpoint.created", "verification.completed", "otel.span",
)
#: Side effects by rank.
SIDE_EFFECTS = ("read_only", "workspace_write", "external_write", "destructive")

#: The state that an event type stands for; the first rule that holds counts.
STATUS = """CASE WHEN type LIKE '%.failed' THEN 'failed' WHEN type LIKE '%.completed' THEN 'completed' WHEN type = 'state.changed' THEN 'changed'
 WHEN type = 'decision.recorded' THEN 'recorded' WHEN type = 'checkpoint.created' THEN 'checkpointed'
 WHEN type LIKE '%.requested' OR type = 'run.started' THEN 'started' ELSE 'unknown' END"""
#: Words of streamed model events, and the first words of low-level types.
STREAM_WORDS = ("delta", "stream", "chunk", "token", "partial", "segment")
LOW_LEVEL = ("span", "telemetry", "trace", "log", "debug", "internal", "stream")
FOLD_KIND = "CASE WHEN type LIKE 'model.%' AND (" + " OR ".join(f"type LIKE '%{w}%'" for w in STREAM_WORDS) + ") THEN 'model-stream' WHEN " + " OR ".join(f"type LIKE '{w}.%'" for w in LOW_LEVEL) + " THEN 'low-level' END"


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def canonical_json(c: Column) -> Column:
    """Key-sorted JSON; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def state_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def deterministic_uuid(seed: Column) -> Column:
    """A UUID of version 4's shape from the SHA-256 of a seed."""
    h = F.sha2(seed, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_id(c: Column, length: int) -> Column:
    return c.rlike(f"(?i)^[0-9a-f]{{{length}}}$") & ~c.rlike("^0+$")


def is_utc_time(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$") & F.try_to_timestamp(c).isNotNull()


def iso_from_nanos(c: Column) -> Column:
    """Nanoseconds floored to milliseconds; what is out of range is the epoch."""
    ms = F.floor(c.cast("decimal(20,0)") / F.lit(1_000_000)).cast("long")
    return F.date_format(F.timestamp_millis(F.when((ms >= 0) & (ms <= 253402300799999), ms).otherwise(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def most_restrictive(*cols: Column) -> Column:
    rank = [F.coalesce(F.array_position(F.array(*map(F.lit, SIDE_EFFECTS)), c), F.lit(0)) for c in cols]
    return F.element_at(F.array(*map(F.lit, ("none", *SIDE_EFFECTS))), (F.greatest(*rank) if len(rank) > 1 else rank[0]).cast("int") + 1)


def file_name(sequence: Column) -> Column:
    s = sequence.cast("string")
    return F.concat(F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s), F.lit(".json"))
