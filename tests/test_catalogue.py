"""The trace queries against SQL, and the procedures against plain versions."""

import datetime
import json

import duckdb
import pytest

from runweave.operators import ancestors, plans, procedures
from runweave.plans import catalogue
from runweave.sources import snapshots

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and v != v:
        return "None"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.isoformat() if isinstance(v, datetime.datetime) else v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == want


def test_changes():
    s = {}
    for path, op, v in (("/a", "set", {"x": 1}), ("/a", "merge", {"y": 2}), ("/l", "set", [1]), ("/l", "append", 2), ("/l/-", "set", 3), ("/l/0", "delete", None), ("/b~1c", "set", 4)):
        procedures.apply_change(s, path, op, v)
    assert s == {"a": {"x": 1, "y": 2}, "l": [2, 3], "b/c": 4}
    for path, op, v in (("/", "set", 1), ("/q/r", "set", 1), ("/q", "delete", None), ("/a", "append", 1), ("/__proto__", "set", 1), ("/l/9", "set", 1), ("/a", "merge", 3)):
        with pytest.raises(procedures.StateError):
            procedures.apply_change(s, path, op, v)


def test_forbidden_names_in_values():
    for v in ({"__proto__": 1}, [{"a": {"constructor": 2}}]):
        for op in ("set", "merge", "append"):
            with pytest.raises(procedures.StateError, match="STATE_VALUE_INVALID"):
                procedures.apply_change({"a": {}}, "/a", op, v)


def trace(spark, rows):
    """(event_id, type, parent_id) in order, as a run."""
    made = [("r", k, e, p, k + 1, t, f"2024-01-01T00:00:{k:02d}Z", float(k), "ann" if k % 2 else "bob") for k, (e, t, p) in enumerate(rows)]
    return spark.createDataFrame(made, "run_id string, pos long, event_id string, parent_id string, sequence long, type string, timestamp string, offset_ms double, actor string")


def test_graph_of_a_run(spark):
    te = trace(spark, [("a", "run.started", None), ("b", "model.requested", "a"), ("c", "model.delta", "b"), ("d", "model.token.delta", "c"), ("e", "log.written", "d"), ('f<"&>', "tool.failed", "e")])
    nodes = {r.node_id: r for r in plans.run("graph_nodes", spark, te=te).collect()}
    assert {k: (n.label, n.type, n.actor, n.status, n.n_events) for k, n in nodes.items()} == {
        "a": ("run.started", "run.started", "bob", "started", 1),
        "b": ("model.requested", "model.requested", "ann", "started", 1),
        "group:c": ("model stream (2)", "multiple", "multiple", "unknown", 2),
        "e": ("log.written", "log.written", "bob", "unknown", 1),
        'f<"&>': ("tool.failed", "tool.failed", "ann", "failed", 1),
    }
    assert {r.line for r in plans.run("mermaid_lines", spark, te=te).collect()} == {
        '  node_1["run.started [a]"]', '  node_2["model.requested [b]"]', '  node_3["model stream (2) [c, d]"]', '  node_4["log.written [e]"]', '  node_5["tool.failed [f&lt;&quot;&amp;&gt;]"]',
        "  node_1 -->|causal| node_2", "  node_2 -->|causal| node_3", "  node_3 -->|causal| node_4", "  node_4 -->|causal| node_5",
    }


def test_parents_of_a_repeated_id(spark):
    """A parent's id stands for the last event of that id, among the nodes that are shown."""
    te = trace(spark, [("a", "run.started", None), ("b", "model.delta", "a"), ("x", "model.delta", "a"), ("c", "note", "x"), ("y", "model.delta", "c"), ("b", "model.delta", "c"), ("d", "tool.failed", "b")])
    edges = lambda name, **k: {(r.from_id, r.to_id) for r in plans.run(name, spark, te=te, **k).collect()}
    assert edges("dag_edges") == {("a", "group:b"), ("group:b", "c"), ("c", "group:y"), ("group:y", "d")}
    assert edges("tree_edges") == edges("dag_edges")
    assert edges("dag_edges", shown="first_sequence <> 5") == {("a", "group:b"), ("group:b", "c"), ("group:b", "d")}


def test_orders_of_ids_that_differ_by_case_and_accent(spark):
    ids = ["b", "B", "á", "A", "a", "ab"]
    rows = [("r", 0, "root", None, 1, "run.started", "t0", 0.0, "x"), *[("r", k + 1, e, "root", 2, "note", "t1", 1.0, "x") for k, e in enumerate(ids)]]
    te = spark.createDataFrame(rows, "run_id string, pos long, event_id string, parent_id string, sequence long, type string, timestamp string, offset_ms double, actor string")
    line = {r.from_id: r.to_id for r in plans.run("timeline_edges", spark, te=te).collect()}
    order, at = [], "root"
    while at in line:
        at = line[at]
        order.append(at)
    assert order == ["a", "A", "á", "ab", "b", "B"]


def test_first_occurrence_of_a_parent(spark):
    rows = [("r", "p", None, 0, "z.first"), ("r", "p", None, 1, "a.second"), ("r", "c", "p", 2, "x")]
    dt = spark.createDataFrame(rows, "run_id string, event_id string, parent_id string, pos long, type string")
    assert [tuple(r) for r in plans.run("get_parents", spark, dt=dt).collect()] == [("r", "c", "p", "z.first")]


def test_deep_runs(spark):
    """A chain of 8,000 events: nearest owned ancestor and cycles; all ancestors of one of 300."""
    chain = spark.range(8000).selectExpr("'r' AS run_id", "concat('e', id) AS event_id", "if(id > 0, concat('e', id - 1), NULL) AS parent_id")
    owned = chain.where("event_id = 'e0'").selectExpr("run_id", "event_id", "'root' AS owner")
    assert [tuple(r) for r in ancestors.nearest_owned(chain, owned, chain.where("event_id = 'e7999'")).collect()] == [("r", "e7999", "root")]
    assert procedures.cyclic_events(chain).count() == 0
    short = chain.where("cast(substr(event_id, 2) AS int) < 300")
    got = ancestors.closure(short)
    assert got.count() == 300 * 299 // 2 and got.where("event_id = 'e299' AND ancestor_id = 'e0'").first().depth == 299
    loop = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "c", "b")], "run_id string, event_id string, parent_id string")
    assert {(r.event_id, r.ancestor_id, r.depth) for r in ancestors.closure(loop).collect()} == {("a", "b", 1), ("b", "a", 1), ("a", "a", 2), ("b", "b", 2), ("c", "a", 1), ("c", "b", 1)}


def test_manifest_counts_and_eligibility(spark):
    te = trace(spark, [("a", "run.started", None), ("b", "x", "a")])
    mf = spark.createDataFrame([("r", 2, 2, "0.2.0", "native", "complete", 0), ("s", 1, 0, "0.2.0", "native", "complete", 1), ("t", 0, 0, "0.1.0", "x", "partial", 0)], "run_id string, event_count long, last_sequence long, schema_version string, source string, completeness string, n_limitations int")
    assert [tuple(r)[:2] for r in plans.run("val_manifest_counts", spark, mf=mf, te=te).collect()] == [("s", "EVENT_COUNT_MISMATCH")]
    assert {r.run_id: r.executable for r in plans.run("eligibility", spark, mf=mf).collect()} == {"r": True, "s": False, "t": True}


def test_repeated_keys_of_an_object(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "events.jsonl").write_text('{"run_id": "r", "event_id": "old", "event_id": "new", "sequence": 1, "type": "x", "payload": {"k": 1, "k": 2}}\n')
    got = snapshots.read_events(spark, str(tmp_path)).selectExpr("event_id", "to_json(payload) AS payload").collect()
    assert [tuple(r) for r in got] == [("new", '{"k":2}')] and snapshots.line_diagnostics(spark, str(tmp_path)).count() == 0


def test_cycles(spark):
    rows = [("r", "a", None), ("r", "b", "a"), ("r", "c", "e"), ("r", "d", "c"), ("r", "e", "d"), ("r", "f", "e"), ("r", "g", "gone"), ("s", "x", "x")]
    e = spark.createDataFrame(rows, "run_id string, event_id string, parent_id string")
    want = {("r", "c"), ("r", "d"), ("r", "e"), ("r", "f"), ("s", "x")}
    for most in (100, 0):
        assert set(map(tuple, procedures.cyclic_events(e, most).collect())) == want


def test_span_forest(spark):
    rows = [("t", "a", None, 5), ("t", "b", "a", 9), ("t", "c", "a", 7), ("t", "d", "c", 8), ("t", "y", "z", 1), ("t", "z", "y", 2)]
    got = procedures.span_forest(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_ns long")).orderBy("sequence").collect()
    assert [(r.span_id, r.depth, r.detached) for r in got] == [("z", 0, True), ("y", 1, False), ("a", 0, False), ("c", 1, False), ("d", 2, False), ("b", 1, False)]


def test_snapshots(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        (d / "checkpoints").mkdir(parents=True)
        (d / "artifacts").mkdir()
    ev = lambda n: json.dumps({"run_id": "r", "event_id": f"e{n}", "parent_ids": [], "sequence": n, "type": "run.started", "timestamp": "t", "monotonic_offset_ms": 0.5, "actor": "x", "payload": {"k": n}, "security": {"side_effect": "read_only"}})
    (a / "events.jsonl").write_text(ev(1) + "\r\n\n{bad\n" + ev(2) + "\n")
    (b / "events.jsonl").write_text(ev(1) + "\n" + ev(2)[:20])
    (a / "manifest.json").write_text('{"run_id": "old"}')
    (a / "manifest.json.tmp").write_text('{"run_id": "new"}')
    (b / "manifest.json").write_text("{")
    (a / "checkpoints" / "000001.json").write_text('{"checkpoint_id": "c", "sequence": 1, "state": {"b": 1, "a": 2}}')
    (a / "artifacts" / ("sha256-" + "0" * 64)).write_bytes(b"x")
    got = snapshots.read_events(spark, str(tmp_path)).orderBy("folder", "pos").collect()
    assert [(r.pos, r.line, r.event_id, r.side_effect) for r in got] == [(0, 1, "e1", "read_only"), (1, 4, "e2", "read_only"), (0, 1, "e1", "read_only")]
    assert {(r.line, r.code) for r in snapshots.line_diagnostics(spark, str(tmp_path)).collect()} == {(3, "INVALID_JSONL_LINE"), (2, "PARTIAL_JSONL_TAIL")}
    assert {(r.run_id, r.error) for r in snapshots.read_manifests(spark, str(tmp_path)).collect()} == {("new", None), (None, "MISSING_MANIFEST")}
    assert [r.state_json for r in snapshots.read_checkpoints(spark, str(tmp_path)).collect()] == ['{"a":2,"b":1}']
    assert [r.valid for r in snapshots.read_artifacts(spark, str(tmp_path), verify=True).collect()] == [False]


def test_otlp(spark, tmp_path):
    span = {"traceId": "a" * 32, "spanId": "b" * 16, "name": "n", "startTimeUnixNano": "18446744073709551615", "endTimeUnixNano": "5", "status": {"code": 2}}
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, span]}]}]}))
    got = snapshots.read_otlp(spark, [str(tmp_path / "x.json")]).collect()
    assert len(got) == 2 and int(got[0].start_ns) == 2**64 - 1 and got[0].status_code == 2
