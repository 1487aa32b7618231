"""Calls made again with live adapters, against small cases worked by hand."""

import pytest
from runweave.operators import live

E = "run_id string, event_id string, sequence long, type string, correlation_key string, target string, input string"


def trace(spark, rows):
    """rows: run, sequence, type, key, target, input, parent; an event's id is e<sequence>."""
    e = spark.createDataFrame([(r, f"e{n}", n, t, k, x, i) for r, n, t, k, x, i, _ in rows], E)
    p = spark.createDataFrame([(r, f"e{n}", 0, u) for r, n, *_, u in rows if u], "run_id string, event_id string, ordinal int, parent_id string")
    return e, p


CALLS = [
    ("a", 1, "model.requested", "k 1", "m", '{"q":1}', None),
    ("a", 2, "model.completed", "k 1", None, '{"x":1,"t":"a b"}', "e1"),
    ("a", 3, "tool.requested", "k2", "t", "[1]", None),
    ("a", 4, "tool.failed", "k2", None, '{"code":"E"}', "e3"),
    ("a", 5, "tool.requested", "k3", "gone", None, None),
    ("a", 6, "tool.completed", "k3", None, "1", "e5"),
    ("a", 7, "model.requested", "k4", "m", None, None),
    ("a", 8, "model.completed", "k4", None, "1", "e7"),
    ("b", 1, "tool.requested", "k", "t", None, None),
]


def answers(request):
    return "completed", {"x": 2, "t": "a  b"}


def raises(request):
    raise RuntimeError("no")


def test_registry():
    t = live.Adapter("tool", "t", answers)
    r = live.Registry([t, live.Adapter("tool", "u", answers), live.Adapter("tool", "u", answers), live.Adapter("model", "m", answers, capabilities=())])
    assert r.resolve("tool", "t") == (t, None)
    assert [r.resolve(*x)[1] for x in (("tool", "u"), ("tool", "v"), ("model", "m"), ("clock",), ("tool", "t", "recorded"))] == ["AMBIGUOUS_TOOL_ADAPTER", "MISSING_ADAPTER", "ADAPTER_CAPABILITY_MISSING", "MISSING_ADAPTER", "MISSING_ADAPTER"]
    with pytest.raises(ValueError):
        live.Registry([live.Adapter("model", "m", answers), live.Adapter("model", "n", answers)])


def test_verify(spark):
    e, p = trace(spark, CALLS)
    r = live.Registry([live.Adapter("model", "m", answers), live.Adapter("tool", "t", raises)])
    rules = ({"kind": "text", "path": "/t", "normalize": True},)
    done, diffs, found = live.verify(e, p, r, rules, [("holds", lambda c, was, now: c["target"] == "m"), ("breaks", lambda c, was, now: 1 / 0)])
    assert {(x.run_id, x.event_id, x.code) for x in found.collect()} == {("b", "e1", "MISSING_SOURCE_RESPONSE"), ("a", "e5", "MISSING_LIVE_ADAPTER")}
    assert {(x.event_id, x.actual.outcome) for x in done.collect()} == {("e1", "completed"), ("e3", "failed")}
    got = {(x.event_id, x.kind, x.path, x.assertion) for x in diffs.collect()}
    thrown = {("e3", "value", p, None) for p in ("/code", "/kind", "/message", "/retryable")}
    assert got == {("e1", "value", "/x", None), ("e1", "assertion", "", "breaks"), ("e3", "assertion", "", "holds"), ("e3", "assertion", "", "breaks")} | thrown


def test_policy_and_approval(spark):
    e, p = trace(spark, CALLS[:4])
    r = live.Registry([live.Adapter("model", "m", answers, "external_write"), live.Adapter("tool", "t", answers)])
    done, diffs, found = live.verify(e, p, r)
    assert {(x.event_id, x.code) for x in found.collect()} == {("e1", "POLICY_BLOCKED")}
    assert {(x.event_id, x.kind) for x in diffs.collect()} == {("e1", "status"), ("e3", "status")}
    ask = [{"adapter_kind": "model", "decision": "require_approval"}]
    ok = spark.createDataFrame([("replay-policy/v1/live/model/external_write/m/k%201/1",)], "action_id string")
    assert live.verify(e, p, r, policy=ask)[2].count() == 1 and live.verify(e, p, r, policy=ask, approvals=ok)[2].count() == 0


def test_resume(spark):
    e, p = trace(spark, CALLS[:4])
    h = "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"  # of {}
    ck = spark.createDataFrame([("a", "good", 2, "e2", "{}", h), ("a", "cuts", 3, "e3", "{}", h), ("a", "bad", 2, "e2", "{}", "0" * 64)], "run_id string, checkpoint_id string, sequence long, last_event_id string, state_json string, state_hash string")
    r = live.Registry([live.Adapter("model", "m", answers), live.Adapter("tool", "t", answers)])

    def at(name):
        point = live.resume_points(spark.createDataFrame([("a", name)], "run_id string, checkpoint_id string"), ck, e)
        done, _, found = live.verify(e, p, r, resume=point)
        return [x.event_id for x in done.collect()], [x.code for x in found.collect()]

    assert at("good") == (["e3"], []) and at("cuts") == ([], ["CHECKPOINT_CUTS_ACTIVE_CALL"])
    assert at("bad") == ([], ["CHECKPOINT_INVALID"]) and at("none") == ([], ["CHECKPOINT_NOT_FOUND"])


def test_nothing_recorded(spark):
    e, p = trace(spark, CALLS[:1])
    assert [d.count() for d in live.verify(e.limit(0), p, live.Registry([]))] == [0, 0, 0]
