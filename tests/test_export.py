"""Exports and dependencies on small cases worked by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from runweave.operators import ancestors, export, workflow

EVENTS = "run_id string, event_id string, sequence long, type string, timestamp string, parent_ids array<string>, correlation_key string, target string, payload string"
MANIFESTS = "run_id string, terminal_status string, source string, completeness string, limitations array<string>"


def span(text):
    return hashlib.sha256(f"span:{text}".encode()).hexdigest()[:16]


def rows(*events):
    return [("r", e, k + 1, t, f"2024-01-01T00:00:0{k}.0019Z", p, key, "gpt", v) for k, (e, t, p, key, v) in enumerate(events)]


CASE = rows(
    ("s", "run.started", [], None, '{"input":1}'),
    ("a", "tool.requested", ["s"], "a", '{"arguments":{"q":1}}'),
    ("b", "model.requested", ["s"], "b", "{}"),
    ("x", "tool.completed", ["a"], "a", '{"output":null}'),
    ("n", "state.changed", ["x", "b", "gone"], None, "[]"),
    ("m", "state.changed", ["n"], None, "{}"),
    ("c", "tool.requested", ["m", "n"], "c", None),
    ("d", "tool.requested", ["s"], None, "{}"),
    ("y", "tool.failed", ["c"], "c", '{"error":"E"}'),
)


def test_native(spark):
    e, m = spark.createDataFrame(CASE, EVENTS), spark.createDataFrame([("r", "failed", "native", "partial", ["c1"])], MANIFESTS)
    spans, notes, losses = export.native(e, m)
    got = {r.span_id: r for r in spans.collect()}
    run, a, b, c = span("r:run"), span("r:tool:a"), span("r:model:b"), span("r:tool:c")
    assert set(got) == {run, a, b, c}
    assert (got[a].parent_span_id, got[a].status_code, got[b].status_code, got[b].end_ns, got[c].status_code) == (run, 2, 0, None, 3)
    assert [got[c].parent_span_id, *got[c].links] == sorted([a, b])
    # no event but the start names a run, so it is the last of them too
    assert (got[run].status_code, got[run].start_ns, got[run].end_ns) == (3, 1704067200001000000, 1704067200001000000)
    assert json.loads(got[run].attributes)["agent_trace.limitation_codes"] == ["c1"] and "agent_trace.asked" not in got[a].attributes
    assert notes.count() == 2
    assert {(r.code, r.n) for r in losses.collect()} == {("unsupported_event", 1), ("unpaired_call", 1), ("multiple_parents_collapsed", 1), ("content_filtered", 3 + 2 + 1 + 1)}


def test_content(spark):
    e, m = spark.createDataFrame(CASE, EVENTS), spark.createDataFrame([], MANIFESTS)
    spans, notes, losses = export.native(e, m, "redacted-content", lambda c: F.regexp_replace(c, "E", "*"))
    own = {k: json.loads(r.attributes) for r in spans.collect() for k in [r.span_id]}
    assert own[span("r:tool:a")]["agent_trace.asked"] == '{"q":1}' and own[span("r:tool:c")]["agent_trace.answer"] == '"*"'
    assert ("content_filtered", 2) in {(r.code, r.n) for r in losses.collect()}
    with pytest.raises(ValueError):
        export.native(e, m, "redacted-content")


def test_empty(spark):
    e, m = spark.createDataFrame([], EVENTS), spark.createDataFrame([], MANIFESTS)
    assert [d.count() for d in (*export.native(e, m), *export.imported(e))] == [0] * 5


def test_imported(spark):
    p = {"trace_id": "1" * 32, "span_id": "2" * 16, "parent_span_id": "bad", "start_time_unix_nano": "7", "status": "ok", "attributes": {"k": 1}, "links": [{"traceId": "3" * 32, "spanId": "4" * 16}, {"traceId": "x", "spanId": "y"}]}
    e = rows(("a", "otel.span", [], None, json.dumps(p)), ("b", "otel.span", [], None, json.dumps(p | {"span_id": "0" * 16})), ("c", "otel.span", [], None, json.dumps({"trace_id": "1" * 32, "span_id": "5" * 16})), ("d", "otel.span", [], None, None))
    spans, losses = export.imported(spark.createDataFrame(e, EVENTS))
    got = {r.span_id: r for r in spans.collect()}
    assert set(got) == {"2" * 16, "5" * 16}
    r = got["2" * 16]
    assert (r.parent_span_id, r.start_ns, r.end_ns, r.status_code, r.links) == (None, 7, None, 2, ["3" * 32 + "/" + "4" * 16])
    assert {(r.code, r.n) for r in losses.collect()} == {("invalid_source_id", 2), ("attribute_filtered", 1), ("unknown_status_preserved", 1), ("observation_only_preserved", 1)}


def test_walks(spark):
    """A deep chain, a cycle with a way out, and a missing parent."""
    deep = [("r", f"e{k}", f"e{k - 1}") for k in range(1, 700)]
    loop = [("q", "t", "u"), ("q", "u", "v"), ("q", "v", "u"), ("q", "v", "w"), ("q", "z", "gone")]
    edges = spark.createDataFrame(deep + loop, "run_id string, event_id string, parent_id string")
    owned = spark.createDataFrame([("r", "e0", "A"), ("r", "e699", "B"), ("q", "w", "W"), ("q", "t", "T"), ("q", "z", "Z")], "run_id string, event_id string, owner string")
    starts = spark.createDataFrame([("r", "e699"), ("q", "t"), ("q", "z")], "run_id string, event_id string")
    assert {tuple(r) for r in ancestors.nearest_owned(edges, owned, starts).collect()} == {("r", "e699", "A"), ("q", "t", "W")}


def test_walks_of_one_step_take_no_round(spark, monkeypatch):
    """Where no unowned event has a parent, no way goes on; a lone root above is no reason to look further."""
    monkeypatch.setattr(ancestors, "checkpointed", lambda df: pytest.fail("a round was made"))
    edges = spark.createDataFrame([("r", "a", "s"), ("r", "b", "s"), ("r", "j", "a"), ("r", "j", "b"), ("r", "j", "gone")], "run_id string, event_id string, parent_id string")
    owned = spark.createDataFrame([("r", k, k.upper()) for k in "abj"], "run_id string, event_id string, owner string")
    got = ancestors.nearest_owned(edges, owned, owned.select("run_id", "event_id"))
    assert sorted(map(tuple, got.collect())) == [("r", "j", "A"), ("r", "j", "B")]


def test_schema_booleans():
    assert workflow.schema_accepts(True, 1) and workflow.schema_accepts({}, 1) and not workflow.schema_accepts(False, 1)
