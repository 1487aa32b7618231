"""Mock replays as runs of their own: what a run did is told again from its records, and the state it ends in is compared.

All runs are rebuilt at once by joins and windows; only the fold of state is a group in Python (recovery.reconstructed). Ids come from the
source's id and positions, times from its events, so a task that is done again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from . import recovery, replay
from .procedures import checkpointed

ACTOR = "replay.runner"
RUNTIME = '{"name":"runweave","version":"1","adapter":"mock"}'
PLAIN = '{"side_effect":"read_only","redactions":[]}'


def _id(prefix: str, *seed) -> Column:
    return F.concat(F.lit(f"{prefix}_"), scalar.deterministic_uuid(F.concat_ws(":", F.lit("mock-replay"), *seed)))


def _payload(key: str) -> Column:
    return F.expr(f"try_variant_get(try_parse_json(body), '$.{key}')")


def answers(calls: DataFrame, parents: DataFrame) -> DataFrame:
    """run_id, event_id, request_id: the first of a result's parents that is a request, and an earlier one."""
    asked = replay.schedule(calls).select("run_id", F.col("event_id").alias("parent_id"), F.col("sequence").alias("asked_at"))
    ends = calls.where(F.col("type").isin(*replay.ENDS)).select("run_id", "event_id", "sequence")
    met = ends.join(parents, ["run_id", "event_id"]).join(asked, ["run_id", "parent_id"]).where("asked_at < sequence")
    return met.groupBy("run_id", "event_id").agg(F.min_by("parent_id", "ordinal").alias("request_id"))


def steps(events: DataFrame, calls: DataFrame, parents: DataFrame, done: DataFrame) -> DataFrame:
    """run_id, number (from 2), event_id, type, timestamp, offset_ms, body, security, request_id, wrong: what a replay tells, in order.

    Changes of state and requests stand as they were; a result is the one recorded for its request (the last, of several), and where that is of
    another type than the event (wrong), the replay ends. done: replay.mock's calls.
    """
    request = done.select("run_id", "event_id", F.lit(True).alias("is_request"))
    told = done.select("run_id", F.col("event_id").alias("request_id"), F.col("response_id").alias("said_id"), "attempt")
    said = events.select("run_id", F.col("event_id").alias("said_id"), F.col("type").alias("said_type"), F.to_json("payload").alias("said"))
    answer = answers(calls, parents).join(told, ["run_id", "request_id"]).join(said, ["run_id", "said_id"])
    e = events.withColumn("own", F.to_json("payload")).withColumn("security", F.to_json(F.expr("try_variant_get(try_parse_json(raw), '$.security')")))
    e = e.select("run_id", "event_id", "pos", "sequence", "type", "timestamp", F.col("monotonic_offset_ms").alias("offset_ms"), "own", "security", "side_effect")
    e = e.join(request, ["run_id", "event_id"], "left").join(answer, ["run_id", "event_id"], "left")
    e = e.where((F.col("type") == "state.changed") | F.col("is_request") | F.col("said_type").isNotNull())
    e = e.withColumn("wrong", F.coalesce(F.col("said_type") != F.col("type"), F.lit(False))).withColumn("end", F.min(F.when(F.col("wrong"), F.col("sequence"))).over(W.partitionBy("run_id")))
    e = e.where("end IS NULL OR sequence <= end").withColumn("number", F.row_number().over(W.partitionBy("run_id").orderBy("sequence", "pos")) + 1)
    e = e.withColumn("type", F.coalesce("said_type", "type")).withColumn("body", F.coalesce("said", "own"))
    failed = F.to_json(F.struct(_payload("correlation_key").alias("correlation_key"), _payload("error").alias("error"), "attempt"))
    completed = F.to_json(F.struct(_payload("correlation_key").alias("correlation_key"), _payload("output").alias("output")))
    e = e.withColumn("body", F.when(F.col("type").endswith(".failed"), failed).when(F.col("type").endswith(".completed"), completed).otherwise(F.col("body")))
    plain = F.to_json(F.struct(F.coalesce("side_effect", F.lit("read_only")).alias("side_effect"), F.array().cast("array<string>").alias("redactions")))
    return e.select("run_id", "number", "event_id", "type", "timestamp", "offset_ms", "body", F.when(F.col("said_type").isNotNull(), plain).otherwise(F.coalesce("security", F.lit(PLAIN))).alias("security"), "request_id", "wrong")


def results(runs: DataFrame, told: DataFrame, early: DataFrame, state: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """run_id, codes (empty: the replay ends in its source's state), state_hash of the replay (null where it was blocked). early: run_id, codes."""
    get = lambda k: F.expr(f"try_variant_get(try_parse_json(body), '$.{k}', 'string')")
    change = F.col("type") == "state.changed"
    value = F.to_json(_payload("value"))
    rows = told.select("run_id", "event_id", (F.col("number") - 1).cast("long").alias("pos"), F.col("number").cast("long").alias("sequence"), *[F.when(change, x).alias(n) for n, x in (("path", get("path")), ("operation", get("operation")), ("value_json", value))])
    none = [F.lit(None).cast("string").alias(n) for n in ("path", "operation", "value_json")]
    start = runs.select("run_id", F.lit("start").alias("event_id"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("sequence"), *none)
    again = recovery.reconstructed(rows.unionByName(start), checkpoints.where("false")).select("run_id", F.col("state_hash").alias("again"), F.col("error").alias("again_error"))
    wrong = told.groupBy("run_id").agg(F.max("wrong").alias("wrong"))
    j = runs.select("run_id").join(early, "run_id", "left").join(wrong, "run_id", "left").join(state.select("run_id", "state_hash", "error"), "run_id", "left").join(again, "run_id", "left")
    late = F.when(F.col("wrong"), "RECORDED_OUTCOME_MISMATCH").when(F.col("error").isNotNull() | F.col("state_hash").isNull(), "SOURCE_ARTIFACT_INVALID").when(~F.col("state_hash").eqNullSafe(F.col("again")), "FINAL_STATE_MISMATCH")
    return j.select("run_id", F.coalesce("codes", F.array_compact(F.array(late))).alias("codes"), F.when(F.col("codes").isNull(), F.col("again")).alias("state_hash"))


def runs_of(events: DataFrame, calls: DataFrame, parents: DataFrame, state: DataFrame, checkpoints: DataFrame, blocked: DataFrame, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events: run_id, sequence, value; manifests: run_id, value; results: run_id, replay_id, codes, state_hash) of one mock replay for each run.

    blocked: run_id, code of runs that may not be replayed; they, and runs whose records or plan don't fit, get a replay that only fails. The
    decisions of a policy aren't told: recorded calls only read. state: recovery.reconstructed of the sources.
    """
    done, bad = replay.mock(calls, parents, plan)
    faults = blocked.select("run_id", "code").unionByName(bad.select("run_id", "code"))
    early = checkpointed(faults.groupBy("run_id").agg(F.sort_array(F.collect_set("code")).alias("codes")))
    runs = events.groupBy("run_id").agg(F.min_by("timestamp", "sequence").alias("first"), F.max_by("timestamp", "sequence").alias("last"), F.max("monotonic_offset_ms").alias("offset_ms")).where("run_id IS NOT NULL")
    told = checkpointed(steps(events.join(early, "run_id", "left_anti"), calls, parents, done))
    out = checkpointed(results(runs, told, early, state, checkpoints).withColumn("replay_id", _id("run", F.col("run_id"))))
    ends = runs.join(out, "run_id").join(told.groupBy("run_id").agg(F.max("number").alias("top")), "run_id", "left").withColumn("top", F.coalesce("top", F.lit(1)))
    good = F.size("codes") == 0
    mode = F.struct(F.lit("mock").alias("mode"), F.col("run_id").alias("source_run_id"))
    error = F.struct(F.lit("MOCK_REPLAY_BLOCKED").alias("code"), F.array_join("codes", ", ").alias("message"), F.lit(False).alias("retryable"), F.lit("validation").alias("kind"))
    begin = ends.select("run_id", F.lit(1).alias("number"), F.lit("run.started").alias("type"), F.col("first").alias("timestamp"), F.lit(0.0).alias("offset_ms"), F.to_json(F.struct(F.try_parse_json(F.lit(RUNTIME)).alias("runtime"), mode.alias("input"))).alias("body"))
    finish = ends.select(
        "run_id", (F.col("top") + 1).alias("number"), F.when(good, "run.completed").otherwise("run.failed").alias("type"), F.col("last").alias("timestamp"), F.coalesce("offset_ms", F.lit(0.0)).alias("offset_ms"),
        F.when(good, F.to_json(F.struct(F.col("state_hash").alias("final_state_hash"), mode.alias("output")))).otherwise(F.to_json(F.struct(error.alias("error")))).alias("body"),
    )
    asked = told.select("run_id", F.col("event_id").alias("request_id"), F.col("number").alias("asked"))
    told = told.join(asked, ["run_id", "request_id"], "left").select("run_id", "number", "type", "timestamp", "offset_ms", "body", "security", "asked")
    frame = begin.unionByName(finish).withColumn("security", F.lit(PLAIN)).withColumn("asked", F.lit(None).cast("int"))
    all_ = told.unionByName(frame)
    event_id = lambda n: _id("evt", F.col("run_id"), n.cast("string"))
    above = F.when(F.col("number") == 1, F.array().cast("array<string>")).otherwise(F.array(event_id(F.coalesce("asked", F.lit(1)))))
    doc = F.struct(
        F.lit("0.2.0").alias("schema_version"), _id("run", F.col("run_id")).alias("run_id"), event_id(F.col("number")).alias("event_id"), above.alias("parent_ids"), F.col("number").alias("sequence"), "type", "timestamp",
        F.coalesce("offset_ms", F.lit(0.0)).alias("monotonic_offset_ms"), F.lit(ACTOR).alias("actor"), F.try_parse_json("body").alias("payload"), F.try_parse_json("security").alias("security"),
    )
    made = all_.select(_id("run", F.col("run_id")).alias("run_id"), F.col("number").alias("sequence"), F.to_json(doc).alias("value"))
    count = (F.col("top") + 1).cast("long")
    fixed = {"schema_version": "0.2.0", "snapshot_type": "run-snapshot", "run_state": "finished", "source": "native", "completeness": "complete"}
    m = F.struct(
        F.col("replay_id").alias("run_id"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.when(good, "completed").otherwise("failed").alias("terminal_status"), F.col("first").alias("created_at"), F.col("last").alias("updated_at"), F.col("last").alias("completed_at"),
        F.try_parse_json(F.lit(RUNTIME)).alias("runtime"), F.array().cast("array<string>").alias("limitations"), count.alias("last_sequence"), count.alias("event_count"), event_id(F.lit(1)).alias("root_event_id"),
    )
    return made, ends.select(F.col("replay_id").alias("run_id"), F.to_json(m).alias("value")), out.select("run_id", "replay_id", "codes", "state_hash")
