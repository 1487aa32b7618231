"""Replay of recorded calls with live adapters, held against what was recorded.

Which calls are made, in what order a run stops and what policy lets through are joins, sums and CASE; Python runs the adapters, the walk
through two values and the assertions, in batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters
from .procedures import checkpointed
from .recovery import judged_checkpoints
from .redaction import canonical
from .replay import decided, differences, recorded, schedule

#: What an adapter of each kind must be able to do.
CAPABILITY = {"model": "model.complete", "tool": "tool.call", "clock": "clock.now", "random": "random.next", "environment": "environment.read"}
#: How faults of the record are called when they stop a replay.
SOURCE_FAULT = {
    "INVALID_RECORDED_REQUEST": "INVALID_SOURCE_CALL",
    "INVALID_RECORDED_OUTCOME": "INVALID_SOURCE_RESPONSE",
    "MISSING_RECORDED_REQUEST": "INVALID_SOURCE_RESPONSE",
    "CORRELATION_KEY_MISMATCH": "INVALID_SOURCE_RESPONSE",
    "MISSING_RECORDED_OUTCOME": "MISSING_SOURCE_RESPONSE",
}
#: The errors of calls that policy keeps back and of adapters that raise.
BLOCKED = {"code": "REPLAY_POLICY_BLOCKED", "message": "The replay policy did not allow this live adapter call.", "retryable": False, "kind": "policy"}
THROWN = {"code": "LIVE_ADAPTER_THROWN", "retryable": False, "kind": "runtime"}


@dataclass(frozen=True)
class Adapter:
    """`run` takes a request (kind, target, correlation_key, attempt, input) and returns ("completed", output) or ("failed", error)."""

    kind: str
    name: str
    run: Callable[[dict], tuple]
    side_effect: str = "read_only"
    capabilities: tuple[str, ...] | None = None  # None: what its kind needs
    mode: str = "live"


class Registry:
    """Adapters by mode and kind; tools by name too. A list of the caller's, so choosing one is a CASE."""

    def __init__(self, found: Sequence[Adapter]):
        self.found = tuple(found)
        single = [(a.mode, a.kind) for a in self.found if a.kind != "tool"]
        if len(single) != len(set(single)) or {a.kind for a in self.found} - set(CAPABILITY):
            raise ValueError("one adapter of each known kind but tools")

    def resolve(self, kind: str, target: str | None = None, mode: str = "live") -> tuple[Adapter | None, str | None]:
        """(adapter, None) or (None, code)."""
        fits = [a for a in self.found if (a.mode, a.kind) == (mode, kind) and (kind != "tool" or a.name == target)]
        if len(fits) != 1:
            return None, "AMBIGUOUS_TOOL_ADAPTER" if fits else "MISSING_ADAPTER"
        able = fits[0].capabilities is None or CAPABILITY[kind] in fits[0].capabilities
        return (fits[0], None) if able else (None, "ADAPTER_CAPABILITY_MISSING")

    def _case(self, kind: Column, target: Column, pick: Callable, other: str | None, mode: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for k, t in sorted({(a.kind, a.name if a.kind == "tool" else None) for a in self.found if a.mode == mode}, key=str):
            out = out.when((kind == k) & (F.lit(True) if t is None else target == t), F.lit(pick(*self.resolve(k, t, mode))).cast("string"))
        return out.otherwise(F.lit(other).cast("string"))

    def code(self, kind: Column, target: Column, mode: str = "live") -> Column:
        """Why no adapter can be chosen; null where one can."""
        return self._case(kind, target, lambda a, code: code, "MISSING_ADAPTER", mode)

    def side_effect(self, kind: Column, target: Column, mode: str = "live") -> Column:
        return self._case(kind, target, lambda a, code: a and a.side_effect, None, mode)


def action_id(mode: str, c: Callable[[str], Column] = F.col) -> Column:
    """The id that approvals name: mode, kind, side effect, target, key and attempt as URI components."""
    out = F.url_encode(F.concat_ws("\0", F.lit(mode), c("kind"), c("side_effect"), c("target"), c("correlation_key"), c("attempt").cast("string")))
    for plain, coded in ((" ", "+"), ("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(coded), F.lit("%20" if plain == " " else plain))
    return F.concat(F.lit("replay-policy/v1/"), F.replace(out, F.lit("%00"), F.lit("/")))


def resume_points(wanted: DataFrame, checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, checkpoint_id, sequence, state_json, code (CHECKPOINT_NOT_FOUND, CHECKPOINT_INVALID or null) of the wanted (run_id, checkpoint_id)."""
    judged = judged_checkpoints(checkpoints, events).withColumn("there", F.lit(True)).withColumnRenamed("code", "fault")
    j = wanted.select("run_id", "checkpoint_id").distinct().join(judged.select("run_id", "checkpoint_id", "sequence", "state_json", "there", "fault"), ["run_id", "checkpoint_id"], "left")
    return j.select("run_id", "checkpoint_id", "sequence", "state_json", F.when(F.col("there").isNull(), "CHECKPOINT_NOT_FOUND").when(F.col("fault").isNotNull(), "CHECKPOINT_INVALID").alias("code"))


def _loads(text):
    return json.loads(text) if isinstance(text, str) else None


def made(calls: DataFrame, registry: Registry) -> DataFrame:
    """Adds `actual` (outcome, value: JSON). A lost executor's calls are made again, so adapters must bear repetition."""

    @F.pandas_udf("outcome string, value string")
    def run(kind: pd.Series, target: pd.Series, key: pd.Series, attempt: pd.Series, body: pd.Series) -> pd.DataFrame:
        out = []
        for k, t, c, n, b in zip(kind, target, key, attempt, body, strict=True):
            try:
                status, value = registry.resolve(k, t)[0].run({"kind": k, "target": t, "correlation_key": c, "attempt": int(n), "input": _loads(b)})
            except Exception as e:  # noqa: BLE001 - whatever an adapter raises is its outcome
                status, value = "failed", {**THROWN, "message": str(e)}
            out.append((status, canonical(value)))
        return pd.DataFrame(out, columns=["outcome", "value"])

    return calls.withColumn("actual", run.asNondeterministic()("kind", "target", "correlation_key", "attempt", "input"))


def judged(done: DataFrame, rules: tuple[dict, ...] = (), assertions: Sequence[tuple[str, Callable]] = ()) -> DataFrame:
    """run_id, event_id, kind, path, assertion of each difference between `outcome`, `value` and `actual`; a different outcome hides the others.

    assertions: (name, f(call, expected, actual) -> bool); one that raises counts as failed. expected and actual are (outcome, value).
    """

    @F.pandas_udf("array<struct<kind:string,path:string,assertion:string>>")
    def compare(call: pd.DataFrame, outcome: pd.Series, value: pd.Series, actual: pd.DataFrame) -> pd.Series:
        found = []
        rows = zip(call.to_dict("records"), outcome, value, actual.outcome, actual.value, strict=True)
        for c, was, before, now, after in rows:
            if was != now:
                found.append([{"kind": "status", "path": "", "assertion": None}])
                continue
            e, a = _loads(before), _loads(after)
            some = [{"kind": k, "path": p, "assertion": None} for k, p in differences(e, a, rules)]
            for name, holds in assertions:
                try:
                    good = bool(holds(c, (was, e), (now, a)))
                except Exception:  # noqa: BLE001 - an assertion that can't be made doesn't hold
                    good = False
                some += [] if good else [{"kind": "assertion", "path": "", "assertion": name}]
            found.append(some)
        return pd.Series(found, dtype=object)

    call = F.struct("kind", "target", "correlation_key", "attempt", "input")
    d = done.select("run_id", "event_id", F.explode(compare(call, "outcome", "value", "actual")).alias("d"))
    return d.select("run_id", "event_id", "d.kind", "d.path", "d.assertion")


def verify(
    events: DataFrame, parents: DataFrame, registry: Registry, rules: tuple[dict, ...] = (), assertions: Sequence[tuple[str, Callable]] = (), policy: list[dict] | None = None, approvals: DataFrame | None = None, resume: DataFrame | None = None, barred: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls with outcome, value and actual; differences; diagnostics as run_id, event_id, code).

    Each recorded call is made again in the order of its recorded end. Runs whose record or resume point has a fault, and those in `barred`
    (run_id, code), make no call. A run stops at its first call without adapter or begun before the resume point; a call that policy keeps back
    fails and the run goes on. A call with several recorded ends is made once. resume: as resume_points returns it; null inputs are the JSON null.
    """
    out, faults = recorded(events, parents)
    named = F.create_map(*[F.lit(x) for kv in SOURCE_FAULT.items() for x in kv])
    found = faults.select("run_id", "event_id", named[F.col("code")].alias("code"))
    no_event = F.lit(None).cast("string").alias("event_id")
    for d in (resume, barred):
        if d is not None:
            found = found.unionByName(d.where("code IS NOT NULL").select("run_id", no_event, "code"))
    found = checkpointed(found)
    s = schedule(events).join(out.drop("event_id"), ["run_id", "kind", "correlation_key", "attempt"]).join(found.select("run_id").distinct(), "run_id", "left_anti")
    start = F.lit(0)
    if resume is not None:
        s = s.join(resume.where("code IS NULL").select("run_id", F.col("sequence").alias("resumed_at")), "run_id", "left")
        start = F.coalesce("resumed_at", F.lit(0))
    s = s.where(F.col("answered_at") > start)
    code = F.when(F.col("sequence") <= start, "CHECKPOINT_CUTS_ACTIVE_CALL").when(registry.code(F.col("kind"), F.col("target")).isNotNull(), "MISSING_LIVE_ADAPTER")
    s = checkpointed(s.withColumns({"code": code, "side_effect": registry.side_effect(F.col("kind"), F.col("target"))}))
    stops = s.where("code IS NOT NULL").groupBy("run_id").agg(F.min(F.struct("answered_at", "event_id", "code")).alias("stop"))
    todo = s.join(stops, "run_id", "left").where("stop IS NULL OR answered_at < stop.answered_at").drop("code", "stop")
    acts = todo.withColumns({"mode": F.lit("live"), "adapter_kind": F.col("kind"), "requires_approval": F.lit(False), "action_id": action_id("live")})
    acts = decided(acts, policy or [], approvals).drop("mode", "adapter_kind", "requires_approval", "rule_index")
    kept_back = acts.where("decision <> 'allow'").withColumn("actual", F.struct(F.lit("failed").alias("outcome"), F.lit(canonical(BLOCKED)).alias("value")))
    # kept, so that no later step makes the calls a second time
    done = checkpointed(made(acts.where("decision = 'allow'"), registry).unionByName(kept_back))
    found = found.unionByName(stops.select("run_id", "stop.event_id", "stop.code")).unionByName(done.where("decision <> 'allow'").select("run_id", "event_id", F.lit("POLICY_BLOCKED").alias("code")))
    return done, judged(done, rules, assertions), found


# --- queries ---------------------------------------------------------------------------------


def _talks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn of a conversation as a call and its end: of a model, of the tool `write` in every fifth and of an unknown tool in every seventh conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    kind = F.when((F.col("conv_id") % 7 == 2) & (F.col("turn") == 2), "tool").when(F.col("conv_id") % 5 == 1, "tool").otherwise("model")
    c = c.withColumns({"kind": kind, "target": F.when((F.col("conv_id") % 7 == 2) & (F.col("turn") == 2), "gone").when(F.col("conv_id") % 5 == 1, "write").otherwise("m")})
    key = F.concat(F.lit("k"), "turn")
    ask = c.select(F.col("conv_id").cast("string").alias("run_id"), F.concat(F.lit("q"), "turn").alias("event_id"), (2 * F.col("turn") + 1).cast("long").alias("sequence"), F.concat("kind", F.lit(".requested")).alias("type"), key.alias("correlation_key"), "target", F.col("n").cast("string").alias("input"), F.lit(None).cast("string").alias("parent_id"))
    end = c.select(F.col("conv_id").cast("string").alias("run_id"), F.concat(F.lit("a"), "turn").alias("event_id"), (2 * F.col("turn") + 2).cast("long").alias("sequence"), F.concat("kind", F.lit(".completed")).alias("type"), key.alias("correlation_key"), F.lit(None).cast("string").alias("target"), (2 * F.col("n") + (F.col("turn") % 4 == 3).cast("int")).cast("string").alias("input"), F.concat(F.lit("q"), "turn").alias("parent_id"))
    e = ask.unionByName(end)
    return e, e.where("parent_id IS NOT NULL").select("run_id", "event_id", F.lit(0).alias("ordinal"), "parent_id")


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    double = lambda request: ("completed", 2 * request["input"])
    return verify(*_talks(spark, sf_dir), Registry([Adapter("model", "m", double), Adapter("tool", "write", double, "external_write")]))


def live_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[1].select("run_id", "event_id", "kind", "path")


def live_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[2]


QUERIES = {f.__name__: f for f in (live_differences, live_diagnostics)}
_T = """WITH t AS (SELECT cast(conv_id AS varchar) AS run_id, concat('q', turn) AS event_id, turn, conv_id % 5 = 1 AS writes, conv_id % 7 = 2 AND turn = 2 AS gone, max(CASE WHEN conv_id % 7 = 2 AND turn = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS stops FROM conversations),
m AS (SELECT * FROM t WHERE NOT (stops = 1 AND turn >= 2))"""
ORACLES = {
    "live_differences": _T + " SELECT run_id, event_id, CASE WHEN writes THEN 'status' ELSE 'value' END AS kind, '' AS path FROM m WHERE writes OR turn % 4 = 3",
    "live_diagnostics": _T + " SELECT run_id, event_id, 'MISSING_LIVE_ADAPTER' AS code FROM t WHERE gone UNION ALL SELECT run_id, event_id, 'POLICY_BLOCKED' FROM m WHERE writes",
}
