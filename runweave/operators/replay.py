"""Replay over traces: call schedules, recorded outcomes, plan and value comparison, policy.

Calls, outcomes and policy decisions are joins and windows by run; only the walk through two JSON values is Python.
"""

from __future__ import annotations

import json
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import adapters
from .workflow import escape

#: Event types of calls.
REQUESTS = ("model.requested", "tool.requested")
ENDS = ("model.completed", "model.failed", "tool.completed", "tool.failed")


def correlation_key(kind: str, target: str, ordinal: int) -> str:
    return f"replay/v1/{kind}/{quote(target, safe=_PLAIN)}/{ordinal}"


#: Fixed value: characters besides letters and digits that URI components keep.
_PLAIN = "-_.!~*'()"


def schedule(events: DataFrame) -> DataFrame:
    """run_id, event_id, kind, target, correlation_key, input, sequence, attempt (by run, kind and key), call (from 0) of requests.

    events: run_id, event_id, sequence, type, correlation_key, target, input (canonical JSON or null). Requests without key or target are invalid.
    """
    r = events.where(F.col("type").isin(*REQUESTS) & F.col("correlation_key").isNotNull())
    r = r.withColumn("kind", F.substring_index("type", ".", 1)).withColumn("attempt", F.row_number().over(W.partitionBy("run_id", "kind", "correlation_key").orderBy("sequence")))
    good = r.where("target IS NOT NULL")
    return good.select("run_id", "event_id", "kind", "target", "correlation_key", "input", "sequence", "attempt", (F.row_number().over(W.partitionBy("run_id").orderBy("sequence")) - 1).alias("call"))


def recorded(events: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes: run_id, kind, correlation_key, attempt, event_id, outcome, value, answered_at; diagnostics: run_id, event_id, code).

    parents: run_id, event_id, ordinal, parent_id. A result belongs to the first of its parents that is an earlier request; of several results
    for one request the last counts.
    """
    calls = schedule(events)
    ends = events.where(F.col("type").isin(*ENDS))
    bad = events.where(F.col("type").isin(*REQUESTS) & (F.col("correlation_key").isNull() | F.col("target").isNull())).select("run_id", "event_id", F.lit("INVALID_RECORDED_REQUEST").alias("code"))
    bad = bad.unionByName(ends.where("correlation_key IS NULL").select("run_id", "event_id", F.lit("INVALID_RECORDED_OUTCOME").alias("code")))
    ends = ends.where("correlation_key IS NOT NULL").select("run_id", "event_id", "sequence", F.substring_index("type", ".", 1).alias("end_kind"), F.substring_index("type", ".", -1).alias("outcome"), F.col("correlation_key").alias("end_key"), F.col("input").alias("value"))
    asked = calls.select("run_id", F.col("event_id").alias("parent_id"), "kind", "correlation_key", "attempt", F.col("sequence").alias("asked_at"))
    met = ends.join(parents, ["run_id", "event_id"]).join(asked, ["run_id", "parent_id"]).where("asked_at < sequence")
    own = met.groupBy("run_id", "event_id").agg(F.min_by(F.struct("kind", "correlation_key", "attempt"), "ordinal").alias("call"))
    j = ends.join(own, ["run_id", "event_id"], "left")
    fits = F.col("call").isNotNull() & (F.col("call.kind") == F.col("end_kind")) & (F.col("call.correlation_key") == F.col("end_key"))
    bad = bad.unionByName(j.where(~F.coalesce(fits, F.lit(False))).select("run_id", "event_id", F.when(F.col("call").isNull(), "MISSING_RECORDED_REQUEST").otherwise("CORRELATION_KEY_MISMATCH").alias("code")))
    out = j.where(fits).groupBy("run_id", "call").agg(F.max_by(F.struct("event_id", "outcome", "value", F.col("sequence").alias("answered_at")), "sequence").alias("r")).select("run_id", "call.*", "r.*")
    open_ = calls.join(out.select("run_id", "kind", "correlation_key", "attempt"), ["run_id", "kind", "correlation_key", "attempt"], "left_anti")
    return out, bad.unionByName(open_.select("run_id", "event_id", F.lit("MISSING_RECORDED_OUTCOME").alias("code")))


def compared_plans(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """run_id, call, code: differences between two schedules, call by call; a different kind hides the call's other differences."""
    e, a = (d.select("run_id", "call", F.struct("kind", "target", "correlation_key", "attempt", "input").alias(n)) for d, n in ((expected, "e"), (actual, "a")))
    j = e.join(a, ["run_id", "call"], "full")
    counts = j.groupBy("run_id").agg((F.count("e") != F.count("a")).alias("off")).where("off").select("run_id", F.lit(None).cast("int").alias("call"), F.lit("CALL_COUNT_MISMATCH").alias("code"))
    differs = lambda f: ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}"))
    rest = F.filter(F.array(*[F.when(differs(f), c) for f, c in (("target", "CALL_TARGET_MISMATCH"), ("correlation_key", "CALL_CORRELATION_KEY_MISMATCH"), ("attempt", "CALL_ATTEMPT_MISMATCH"), ("input", "CALL_INPUT_MISMATCH"))]), lambda c: c.isNotNull())
    both = j.where("e IS NOT NULL AND a IS NOT NULL").select("run_id", "call", F.explode(F.when(differs("kind"), F.array(F.lit("CALL_KIND_MISMATCH"))).otherwise(rest)).alias("code"))
    return counts.unionByName(both)


def mock(events: DataFrame, parents: DataFrame, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls with their recorded outcome, diagnostics) of replaying runs against their own records; plan: another schedule to hold them against."""
    calls = schedule(events)
    out, bad = recorded(events, parents)
    done = calls.join(out.select("run_id", "kind", "correlation_key", "attempt", F.col("event_id").alias("response_id"), "outcome", "value"), ["run_id", "kind", "correlation_key", "attempt"], "left")
    bad = bad.select("run_id", F.lit(None).cast("int").alias("call"), F.lit("RECORDED_ADAPTER_INVALID").alias("code"), "event_id")
    if plan is not None:
        bad = bad.unionByName(compared_plans(calls, plan).withColumn("event_id", F.lit(None).cast("string")))
    return done, bad


# --- comparison of values --------------------------------------------------------------------


def _matches(pattern: str, path: str) -> bool:
    p, q = pattern.split("/"), path.split("/")
    return len(p) == len(q) and all(x in ("*", y) for x, y in zip(p, q, strict=True))


def differences(expected, actual, rules: tuple[dict, ...] = ()) -> list[tuple[str, str]]:
    """(kind, path) where two JSON values differ, in order of paths.

    rules: {"kind": "ignore" | "text" | "file_hash", "path": pattern, "normalize": bool}; * in a pattern stands for one key.
    """
    found: list[tuple[str, str]] = []
    todo = [(expected, actual, "")]
    family = lambda v: "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__
    while todo:
        e, a, path = todo.pop()
        by = {r["kind"]: r for r in reversed(rules) if _matches(r["path"], path)}
        if "ignore" in by:
            continue
        if "text" in by and isinstance(e, str) and isinstance(a, str):
            e, a = ((" ".join(v.split()) for v in (e, a)) if by["text"].get("normalize") else (e, a))
            found += [("text", path)] * (e != a)
        elif "file_hash" in by:
            is_hash = isinstance(e, str) and len(e) == 64 and not set(e) - set("0123456789abcdef")
            found += [("file_hash", path)] * (not is_hash or e != a)
        elif e is None or a is None:
            found += [("value", path)] * (e is not a)
        elif family(e) != family(a):
            found.append(("type", path))
        elif isinstance(e, list):
            found += [("value", path)] * (len(e) != len(a))
            todo += [(x, y, f"{path}/{k}") for k, (x, y) in reversed(list(enumerate(zip(e, a, strict=False))))]
        elif isinstance(e, dict):
            keys = sorted(e.keys() | a.keys(), reverse=True)
            todo += [(e[k], a[k], f"{path}/{escape(k)}") for k in keys if k in e and k in a]
            found += [("value", f"{path}/{escape(k)}") for k in reversed(keys) if (k in e) != (k in a)]
        elif e != a:
            found.append(("value", path))
    return sorted(found, key=lambda f: f[1].split("/"))


def verified(pairs: DataFrame, rules: tuple[dict, ...] = ()) -> DataFrame:
    """(id, expected, actual: JSON) -> id, kind, path of each difference; null text counts as the JSON null."""

    @F.pandas_udf("array<struct<kind:string,path:string>>")
    def diff(e: pd.Series, a: pd.Series) -> pd.Series:
        load = lambda t: json.loads(t) if isinstance(t, str) else None
        return pd.Series([[{"kind": k, "path": p} for k, p in differences(load(x), load(y), rules)] for x, y in zip(e, a, strict=True)], dtype=object)

    unequal = ~F.coalesce(scalar.canonical_json(F.col("expected")).eqNullSafe(scalar.canonical_json(F.col("actual"))), F.lit(False))
    return pairs.where(unequal | F.lit(bool(rules))).select("id", F.explode(diff("expected", "actual")).alias("d")).select("id", "d.kind", "d.path")


# --- policy ----------------------------------------------------------------------------------


def decided(actions: DataFrame, rules: list[dict], approvals: DataFrame | None = None) -> DataFrame:
    """Adds rule_index (null: the default) and decision to actions of mode, adapter_kind, target, side_effect, requires_approval, action_id.

    rules, tried in order, hold any of these and a decision; they are a list of the caller's, so they become one CASE and no join.
    approvals: action_id.
    """
    fields = ("mode", "adapter_kind", "target", "side_effect")
    index = decision = None
    for k, r in enumerate(rules):
        fits = F.lit(True)
        for f in fields:
            if r.get(f) is not None:
                fits = fits & F.col(f).eqNullSafe(F.lit(r[f]))
        index = F.when(fits, k) if index is None else index.when(fits, k)
        decision = F.when(fits, r["decision"]) if decision is None else decision.when(fits, r["decision"])
    default = F.when((F.col("mode") == "recorded") | (F.col("side_effect") == "read_only"), "allow").otherwise("deny")
    out = actions.withColumn("rule_index", F.lit(None).cast("int") if index is None else index).withColumn("chosen", default if decision is None else decision.otherwise(default))
    if approvals is None:
        out = out.withColumn("approved", F.lit(False))
    else:
        out = out.join(approvals.select("action_id", F.lit(True).alias("approved")).distinct(), "action_id", "left")
    ask = (F.col("chosen") == "require_approval") | F.coalesce("requires_approval", F.lit(False))
    final = F.when(F.col("chosen").isin("deny", "dry_run"), F.col("chosen")).when(ask & ~F.coalesce("approved", F.lit(False)), "require_approval").otherwise("allow")
    return out.withColumn("decision", final).drop("chosen", "approved")


# --- queries ---------------------------------------------------------------------------------


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    e = te.select("run_id", "event_id", "sequence", "type", F.when(F.col("n") % 41 != 3, F.format_string("key_%d", F.col("n") % 2)).alias("correlation_key"), F.when(F.col("type").isin(*REQUESTS), "t").alias("target"), F.col("value").cast("string").alias("input"), "n", "parent_id")
    return e, e.where("parent_id IS NOT NULL").select("run_id", "event_id", F.lit(0).alias("ordinal"), "parent_id")


def replay_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(*_calls(spark, sf_dir))[0].select("run_id", "kind", "correlation_key", F.col("attempt").cast("long").alias("attempt"), "event_id", "outcome")


def replay_recorded_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(*_calls(spark, sf_dir))[1]


def replay_mock_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _calls(spark, sf_dir)
    other = e.where("n % 43 <> 7").withColumn("input", F.when(F.col("n") % 29 == 4, "x").otherwise(F.col("input")))
    return compared_plans(schedule(e), schedule(other)).groupBy("code").agg(F.count("*").alias("n"))


def replay_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"].where("type LIKE '%.requested'")
    a = te.select("run_id", F.col("event_id").alias("action_id"), F.when(F.col("n") % 3 == 0, "recorded").otherwise("live").alias("mode"), F.substring_index("type", ".", 1).alias("adapter_kind"), F.col("actor").alias("target"), F.element_at(F.array(*map(F.lit, scalar.SIDE_EFFECTS)), (F.col("n") % 4 + 1).cast("int")).alias("side_effect"), (F.col("n") % 7 == 0).alias("requires_approval"))
    rules = [{"adapter_kind": "tool", "side_effect": "destructive", "decision": "deny"}, {"target": "actor_1", "decision": "require_approval"}, {"mode": "live", "side_effect": "workspace_write", "decision": "allow"}]
    return decided(a, rules).select("action_id", F.col("rule_index").cast("long").alias("rule_index"), "decision")


def verified_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    other = F.when(F.col("event_id") % 5 == 1, F.lit('{"k":null}')).when(F.col("event_id") % 5 == 2, F.lit('{"q":1}')).when(F.col("event_id") % 5 == 3, F.lit("[1]")).otherwise(F.col("props"))
    return verified(e.select(F.col("event_id").alias("id"), F.col("props").alias("expected"), other.alias("actual")))


QUERIES = {f.__name__: f for f in (replay_recorded, replay_recorded_faults, replay_mock_plan, replay_policy, verified_differences)}
_R = """WITH e AS (SELECT *, CASE WHEN n % 41 <> 3 THEN concat('key_', cast(n % 2 AS varchar)) END AS ck, CASE WHEN type LIKE 'model.%' THEN 'model' WHEN type LIKE 'tool.%' THEN 'tool' END AS kind FROM te),
q AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind, ck ORDER BY sequence) AS attempt FROM e WHERE ck IS NOT NULL AND type IN ('model.requested', 'tool.requested')),
d AS (SELECT * FROM e WHERE type IN ('model.completed', 'model.failed', 'tool.completed', 'tool.failed')),
m AS (SELECT d.run_id, d.event_id, d.sequence, d.type, d.ck, d.kind, q.event_id AS asked, q.attempt, q.event_id IS NOT NULL AND q.kind = d.kind AND q.ck = d.ck AS fits FROM d LEFT JOIN q ON d.run_id = q.run_id AND d.parent_id = q.event_id WHERE d.ck IS NOT NULL)"""
ORACLES = {
    "replay_mock_plan": adapters.duck(
        """WITH e AS (SELECT run_id, sequence, n, split_part(type, '.', 1) AS kind, 'key_' || (n % 2) AS ck, CAST(value AS VARCHAR) AS input FROM te WHERE type IN ('model.requested', 'tool.requested') AND n % 41 <> 3),
s AS (SELECT true AS planned, run_id, sequence, kind, ck, input FROM e UNION ALL SELECT false, run_id, sequence, kind, ck, CASE WHEN n % 29 = 4 THEN 'x' ELSE input END FROM e WHERE n % 43 <> 7),
c AS (SELECT s.*, (SELECT count(*) FROM s o WHERE o.planned = s.planned AND o.run_id = s.run_id AND o.sequence < s.sequence) AS call, (SELECT count(*) FROM s o WHERE o.planned = s.planned AND o.run_id = s.run_id AND o.kind = s.kind AND o.ck = s.ck AND o.sequence <= s.sequence) AS attempt FROM s),
j AS (SELECT x.kind <> y.kind AS k, x.ck <> y.ck AS c, x.attempt <> y.attempt AS a, x.input <> y.input AS i FROM c x JOIN c y ON x.planned AND NOT y.planned AND x.run_id = y.run_id AND x.call = y.call),
u AS (SELECT unnest(CASE WHEN k THEN ['CALL_KIND_MISMATCH'] ELSE list_filter([CASE WHEN c THEN 'CALL_CORRELATION_KEY_MISMATCH' END, CASE WHEN a THEN 'CALL_ATTEMPT_MISMATCH' END, CASE WHEN i THEN 'CALL_INPUT_MISMATCH' END], lambda v: v IS NOT NULL) END) AS code FROM j
 UNION ALL SELECT 'CALL_COUNT_MISMATCH' FROM c GROUP BY run_id HAVING count(*) FILTER (WHERE planned) <> count(*) FILTER (WHERE NOT planned))
SELECT code, count(*) AS n FROM u GROUP BY code""",
        ("te",),
    ),
    "replay_recorded": adapters.duck(_R + " SELECT run_id, kind, ck AS correlation_key, attempt, event_id, split_part(type, '.', 2) AS outcome FROM m WHERE fits", ("te",)),
    "replay_recorded_faults": adapters.duck(
        _R
        + """ SELECT run_id, event_id, 'INVALID_RECORDED_REQUEST' AS code FROM e WHERE ck IS NULL AND type IN ('model.requested', 'tool.requested')
UNION ALL SELECT run_id, event_id, 'INVALID_RECORDED_OUTCOME' FROM d WHERE ck IS NULL UNION ALL SELECT run_id, event_id, CASE WHEN asked IS NULL THEN 'MISSING_RECORDED_REQUEST' ELSE 'CORRELATION_KEY_MISMATCH' END FROM m WHERE NOT fits
UNION ALL SELECT q.run_id, q.event_id, 'MISSING_RECORDED_OUTCOME' FROM q WHERE NOT EXISTS (SELECT 1 FROM m WHERE fits AND m.run_id = q.run_id AND m.asked = q.event_id)""",
        ("te",),
    ),
    "replay_policy": adapters.duck(
        """SELECT event_id AS action_id, CASE WHEN r = 9 THEN NULL ELSE r END AS rule_index, CASE WHEN r = 0 THEN 'deny' WHEN r = 1 THEN 'require_approval' WHEN r = 9 AND n % 3 <> 0 AND n % 4 <> 0 THEN 'deny' WHEN n % 7 = 0 THEN 'require_approval' ELSE 'allow' END AS decision
FROM (SELECT *, cast(CASE WHEN type LIKE 'tool.%' AND n % 4 = 3 THEN 0 WHEN actor = 'actor_1' THEN 1 WHEN n % 3 <> 0 AND n % 4 = 1 THEN 2 ELSE 9 END AS bigint) AS r FROM te WHERE type LIKE '%.requested') x""",
        ("te",),
    ),
    "verified_differences": """SELECT event_id AS id, CASE WHEN event_id % 5 = 3 THEN 'type' ELSE 'value' END AS kind, CASE WHEN event_id % 5 = 3 THEN '' ELSE '/k' END AS path FROM events WHERE event_id % 5 IN (1, 2, 3)
UNION ALL SELECT event_id, 'value', '/q' FROM events WHERE event_id % 5 = 2""",
}
