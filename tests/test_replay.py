"""Import, workflows and replay against small cases worked by hand."""

import json

from runweave.operators import otlp, replay, workflow

SF = "/root/testdata/sf0.001"
A, B, C = ("a" * 16, "b" * 16, "c" * 16)


def test_values():
    d = otlp.Decoder({"value_length": 3, "attributes": 2, "depth": 2})
    assert d.value({"intValue": 5}) == "5" and d.value({"stringValue": "abcd"}) == "abc" and d.cut == 1
    assert d.value({"stringValue": "x", "boolValue": True}) == "x" and d.value({"doubleValue": float("nan")}) is None
    assert d.value({"arrayValue": {"values": [{"boolValue": False}, {"arrayValue": {"values": [{"intValue": "1"}]}}]}}) == [False, [None]]
    assert d.attributes([{"key": "a", "value": {"doubleValue": 1.5}}, {"key": ""}, {"key": "z"}]) == {"a": 1.5}
    assert otlp.encoded({"b": 2.0, "a": [None, True]}) == {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"stringValue": "null"}, {"boolValue": True}]}}}, {"key": "b", "value": {"intValue": "2"}}]}}


def test_import(spark, tmp_path):
    t = "1" * 32
    span = lambda s, p=None, at="5", end=None, **k: {"traceId": t.upper(), "spanId": s, "parentSpanId": p, "startTimeUnixNano": at, "endTimeUnixNano": end, "name": s[0], **k}
    attrs = [{"key": "gen_ai.operation.name", "value": {"stringValue": "chat"}}]
    spans = [span(A, B, "7", kind=9, attributes=attrs), span(B, A, "6"), span(C, "f" * 16, status={"code": 2}), span(C, "f" * 16, status={"code": 2}), span("0" * 16), span("d" * 16, at="9", end="3"), span("e" * 16, at="x"), span("e" * 16, "e" * 16), span("9" * 16), span("9" * 16, at="6")]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    got, found = otlp.import_files(spark, [str(tmp_path / "x.json")])
    rows = {r.span_id: r for r in got.collect()}
    assert {k: (r.parent, r.depth) for k, r in rows.items()} == {A: (B, 1), B: (None, 0), C: (None, 0), "e" * 16: (None, 0)}
    assert rows[A].kind == "unknown:9" and rows[A].semantic == "gen_ai_model" and rows[C].status == "ok" and rows[B].status == "unset"
    codes = sorted(r.code for r in found.collect())
    assert codes == sorted(["DUPLICATE_SPAN", "CONFLICTING_SPAN", "MISSING_PARENT", "SELF_PARENT", "PARENT_CYCLE", "INVALID_SPAN_ID", "NEGATIVE_DURATION", "INVALID_TIMESTAMP"])
    s = otlp.summaries(got, found).first()
    assert s.completeness == "partial" and s.limitations == ["invalid_source_data", "missing_parent", "missing_root"]
    few, out = otlp.import_files(spark, [str(tmp_path / "x.json")], {"spans": 2})
    assert few.count() == 2 and out.where("code = 'SPAN_LIMIT_EXCEEDED'").count() == 5


def test_import_of_parts(spark, tmp_path):
    attr = [{"key": "k", "value": {"intValue": "1"}}]
    span = {"traceId": "1" * 32, "spanId": A, "startTimeUnixNano": "5", "droppedEventsCount": 2, "attributes": attr}
    span |= {"events": [{"name": "", "timeUnixNano": "7", "attributes": attr}, 3, {"name": "n", "timeUnixNano": "07", "droppedAttributesCount": 1}]}
    span |= {"links": [{"traceId": "F" * 32, "spanId": B.upper(), "flags": 0}, {"traceId": "0" * 32, "spanId": B}]}
    other = {**span, "spanId": B, "links": []}
    copy = {**other, "links": [{"traceId": "2" * 32, "spanId": C}]}
    scopes = [{"scope": {"name": "s", "version": "", "schemaUrl": "u"}, "spans": [span, other, copy]}, 7]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": ["no", {"resource": {"name": "r", "attributes": attr}, "scopeSpans": scopes}]}))
    (tmp_path / "y.json").write_text("[]")
    got, found = otlp.import_files(spark, [str(tmp_path / "x.json"), str(tmp_path / "y.json")], {"events": 2})
    (r,) = got.collect()
    assert json.loads(r.events) == [{"name": "unnamed", "time_unix_nano": "7", "attributes": {"k": "1"}}] and r.cut == 1
    assert json.loads(r.links) == [{"trace_id": "f" * 32, "span_id": B, "attributes": {}, "flags": 0}]
    assert json.loads(r.resource) == {"attributes": {"k": "1"}} and json.loads(r.scope) == {"attributes": {}, "name": "s", "schemaUrl": "u"}
    assert sorted(x.code for x in found.collect()) == sorted(["DROPPED_SOURCE_DATA"] * 3 + ["CONFLICTING_SPAN", "INVALID_RESOURCE_SPANS", "INVALID_SCOPE_SPANS", "INVALID_REQUEST"])
    assert otlp.summaries(got, found).first().limitations == ["invalid_source_data", "payload_truncated", "sampled_or_dropped"]


def test_third_copy_stands_again(spark):
    rows = [(k, "t", "s", f) for k, f in enumerate("aabcc")]
    r = otlp.isolated(spark.createDataFrame(rows, "pos long, trace_id string, span_id string, fingerprint string")).first()
    assert (r.kept_pos, r.duplicates, r.conflicts) == (3, 2, 1)


def test_queries_without_sql(spark):
    for q in (otlp.QUERIES["otlp_report"], replay.QUERIES["replay_mock_plan"], workflow.QUERIES["workflow_documents"], workflow.QUERIES["workflow_faults"]):
        assert q(spark, SF).count() > 0
    kept = otlp.QUERIES["otlp_normalized"](spark, SF).groupBy("trace_id").agg({"sequence": "max", "*": "count"}).collect()
    assert all(r["max(sequence)"] == r["count(1)"] + 1 for r in kept)
    assert otlp.QUERIES["otlp_observation"](spark, SF).count() == sum(r["count(1)"] + 2 for r in kept)


NODE = {"kind": "tool", "depends_on": [], "success_conditions": []}
DOC = {
    "inputs": {"go": {}},
    "nodes": [{**NODE, "node_id": "a", "retry": {"max_attempts": 2}}, {**NODE, "node_id": "b", "depends_on": [{"node_id": "a", "on": "success"}], "success_conditions": [{"kind": "condition", "condition": {"from": {"kind": "node_output", "name": "b", "path": "/v/0"}, "operator": "equals", "value": 1}}]}],
    "outputs": {"r": {"from": {"node_id": "b", "path": "/v/0"}, "schema": {"type": "integer"}}},
}


def test_workflow_faults(spark):
    bad = json.loads(json.dumps(DOC))
    bad["nodes"][0]["depends_on"] = [{"node_id": "b"}, {"node_id": "x"}, {"node_id": "a"}]
    bad["nodes"].append({**NODE, "node_id": "a", "kind": "verification", "verifier_id": "v", "condition": {"from": {"kind": "input", "name": "no"}, "operator": "exists"}})
    bad["outputs"]["q/r"] = {"from": {"node_id": "gone"}}
    assert workflow.diagnostics(DOC) == []
    got = workflow.diagnostics(bad)
    assert {c for c, _ in got} == {"DUPLICATE_WORKFLOW_NODE_ID", "MISSING_WORKFLOW_DEPENDENCY", "SELF_WORKFLOW_DEPENDENCY", "MISSING_WORKFLOW_VERIFIER", "MISSING_WORKFLOW_REFERENCE", "MISSING_WORKFLOW_OUTPUT_NODE"}
    loop = json.loads(json.dumps(DOC))
    loop["nodes"][0]["depends_on"] = [{"node_id": "b"}]
    assert workflow.diagnostics(loop) == [("WORKFLOW_DEPENDENCY_CYCLE", "/nodes")]
    d = spark.createDataFrame([("w", json.dumps(bad)), ("g", json.dumps(DOC)), ("n", "{"), ("z", None)], "workflow_id string, doc string")
    rows = workflow.validated(d).collect()
    assert ("w", "MISSING_WORKFLOW_OUTPUT_NODE", "/outputs/q~1r/from/node_id") in set(map(tuple, rows)) and {r.workflow_id for r in rows} == {"w", "n", "z"}


def test_scheduler():
    def agent(node, inputs, outputs, n):
        return (False, "E") if node["node_id"] == "a" and n == 1 else (True, {"v": [1]})

    r = workflow.Semantic(DOC, agent).run({"go": 1})
    assert r == {"status": "completed", "nodes": {"a": ("completed", 2), "b": ("completed", 1)}, "outputs": {"r": 1}, "codes": []}
    r = workflow.Semantic(DOC, lambda *x: (True, {"v": [2]})).run({"go": 1})
    assert r["nodes"]["b"] == ("failed", 1) and r["codes"] == ["NODE_FAILED", "OUTPUT_MISSING"]
    assert workflow.Semantic(DOC, agent, allowed=lambda n: False).run({"go": 1})["nodes"]["b"] == ("blocked", 0)
    assert workflow.Semantic(DOC, agent).run({})["codes"] == ["INPUT_MISSING"]
    assert workflow.Semantic(DOC, agent, capabilities=["semantic.node.model"]).run({"go": 1})["codes"] == ["INCOMPATIBLE_AGENT"]
    c = lambda op, v=None: workflow.holds({"from": {"kind": "input", "name": "x", "path": "/k"}, "operator": op, "value": v}, {"x": {"k": []}}, {})
    assert c("exists") and c("truthy") and not c("falsy") and c("equals", []) and c("not_equals", {})
    assert not workflow.same(True, 1) and workflow.same(1, 1.0)


def test_differences():
    rules = ({"kind": "ignore", "path": "/t"}, {"kind": "text", "path": "/l/*", "normalize": True}, {"kind": "file_hash", "path": "/h"})
    e = {"t": 1, "l": ["a  b", "c"], "h": "x", "n": None, "k": 1, "m": {"x": True}}
    a = {"t": 2, "l": ["a b ", "d", "e"], "h": "x", "n": 0, "q": 1, "m": {"x": 1}}
    assert replay.differences(e, a, rules) == [("file_hash", "/h"), ("value", "/k"), ("value", "/l"), ("text", "/l/1"), ("type", "/m/x"), ("value", "/n"), ("value", "/q")]
    assert replay.differences(e, e, rules[:2]) == [] and replay.correlation_key("tool", "a b!/", 2) == "replay/v1/tool/a%20b!%2F/2"


def test_recorded(spark):
    ev = [("r", "q1", 1, "tool.requested", "k", "t", "1"), ("r", "q2", 2, "tool.requested", "k", "t", "2"), ("r", "c1", 3, "tool.failed", "k", None, "e"), ("r", "c2", 4, "tool.completed", "k", None, "f"), ("r", "c3", 5, "model.completed", "k", None, "g"), ("r", "c4", 6, "tool.completed", "k", None, "h"), ("r", "q3", 7, "model.requested", None, "m", None)]
    e = spark.createDataFrame(ev, "run_id string, event_id string, sequence long, type string, correlation_key string, target string, input string")
    p = spark.createDataFrame([("r", "c1", 0, "q1"), ("r", "c2", 0, "q9"), ("r", "c2", 1, "q1"), ("r", "c3", 0, "q2")], "run_id string, event_id string, ordinal int, parent_id string")
    out, bad = replay.recorded(e, p)
    assert [(r.attempt, r.event_id, r.outcome, r.value) for r in out.collect()] == [(1, "c2", "completed", "f")]
    assert {(r.event_id, r.code) for r in bad.collect()} == {("c3", "CORRELATION_KEY_MISMATCH"), ("c4", "MISSING_RECORDED_REQUEST"), ("q2", "MISSING_RECORDED_OUTCOME"), ("q3", "INVALID_RECORDED_REQUEST")}
    done, _ = replay.mock(e, p, replay.schedule(e.where("sequence > 1")))
    assert {(r.event_id, r.outcome) for r in done.collect()} == {("q1", "completed"), ("q2", None)}
    codes = {(r.call, r.code) for r in replay.compared_plans(replay.schedule(e), replay.schedule(e.where("sequence > 1"))).collect()}
    assert codes == {(None, "CALL_COUNT_MISMATCH"), (0, "CALL_INPUT_MISMATCH")}


def test_policy(spark):
    a = spark.createDataFrame([("x", "live", "tool", "t", "read_only", True), ("y", "live", "tool", "t", "destructive", False), ("z", "live", "tool", "u", "destructive", None)], "action_id string, mode string, adapter_kind string, target string, side_effect string, requires_approval boolean")
    rules = [{"target": "u", "decision": "dry_run"}]
    got = {r.action_id: (r.rule_index, r.decision) for r in replay.decided(a, rules).collect()}
    assert got == {"x": (None, "require_approval"), "y": (None, "deny"), "z": (0, "dry_run")}
    yes = spark.createDataFrame([("x",), ("x",)], "action_id string")
    assert replay.decided(a, [], yes).where("action_id = 'x'").collect()[0].decision == "allow"
