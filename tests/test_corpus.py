"""The facade, the command line, the queue and path checks."""

import hashlib
import http.server
import io
import json
import threading
import urllib.error

import pytest
from runweave import cli
from runweave.corpus import Corpus
from runweave.operators import live, redaction
from runweave.sources import paths, queue


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "runs" / "one"
    (d / "checkpoints").mkdir(parents=True)
    (d / "artifacts").mkdir()
    rows = [("run.started", [], {}), ("tool.requested", ["e1"], {"correlation_key": "k", "tool": "t", "arguments": {"api_key": "s"}}), ("tool.completed", ["e2"], {"correlation_key": "k", "output": 1}), ("state.changed", ["e3", "e2"], {"path": "/a", "operation": "set", "value": {"x": 1}}), ("run.completed", ["e4"], {})]
    event = lambda k, t, p, v: json.dumps({"schema_version": "0.2.0", "run_id": "r", "event_id": f"e{k}", "parent_ids": p, "sequence": k, "type": t, "timestamp": f"2024-01-01T00:00:0{k}Z", "monotonic_offset_ms": k, "actor": "x", "payload": v, "security": {"side_effect": "read_only"}})
    (d / "events.jsonl").write_text("\n".join(event(k + 1, *r) for k, r in enumerate(rows)) + "\n")
    m = {"schema_version": "0.2.0", "run_id": "r", "run_state": "finished", "source": "native", "completeness": "complete", "last_sequence": 5, "event_count": 5, "root_event_id": "e1"}
    (d / "manifest.json").write_text(json.dumps(m))
    return d.parent


def test_corpus(spark, folder):
    c = Corpus(spark, str(folder))
    assert c.validate().count() == 0
    assert c.inspect().first().event_count == 5 and c.find(min_sequence=2, type="tool.requested").count() == 1
    nodes, edges = c.graph()
    assert nodes.count() == 5 and {(r.from_id, r.to_id) for r in edges.collect()} == {("e1", "e2"), ("e2", "e3"), ("e3", "e4"), ("e2", "e4"), ("e4", "e5")}
    assert c.graph("call-tree")[1].count() == 4
    s = c.state().first()
    assert s.state_json == '{"a":{"x":1}}' and s.state_hash == hashlib.sha256(b'{"a":{"x":1}}').hexdigest()
    done, bad = c.replay()
    assert done.first().outcome == "completed" and bad.count() == 0
    assert json.loads(c.compile().first().doc)["nodes"] == [{"node_id": "node_tool_1", "kind": "tool_call", "tool": "t", "depends_on": [], "success_conditions": [{"kind": "output_schema", "schema": True}], "on_failure": "stop"}]
    spans, lost = c.export()
    assert {r.name: (r.parent_span_id is None, r.status_code, r.start_ns % 10**10 // 10**9, r.end_ns % 10**10 // 10**9) for r in spans.collect()} == {"agent.run": (True, 0, 1, 5), "tool.call": (False, 2, 2, 3)}
    assert {(r.code, r.n) for r in lost.collect()} == {("content_filtered", 3)}
    calls, differ, faults = c.verify(live.Registry([live.Adapter("tool", "t", lambda request: ("completed", len(request["input"])))]))
    assert calls.count() == 1 and differ.count() == 0 and faults.count() == 0
    bad = folder / "one" / "events.jsonl"
    whole = bad.read_text()
    bad.write_text(whole + "{\n")
    assert {(r.run_id, r.code) for r in Corpus(spark, str(folder)).verify(live.Registry([]))[2].collect()} == {("r", "SOURCE_TRACE_INVALID")}
    bad.write_text(whole)
    p = redaction.Pipeline(fields=(("/arguments/api_key", "api_key"),))
    assert c.redact(p).where("event_id = 'e2'").first().entries[0].path == "/payload/arguments/api_key"


def test_command_line(spark, folder):
    def run(*a):
        out = io.StringIO()
        return cli.main([*a], spark, out), out.getvalue()

    assert run("validate", str(folder)) == (0, "")
    assert json.loads(run("inspect", str(folder))[1])["tool_calls"] == 1
    assert run("graph", str(folder), "--format", "mermaid")[1].startswith("flowchart TD\n")
    assert run("replay", str(folder))[0] == 0
    assert json.loads(run("export-otel", str(folder), "--dry-run")[1])["spans"] == 2
    posted = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            posted.append((self.headers["x-key"], json.loads(self.rfile.read(int(self.headers["content-length"])))))
            self.send_response(200 if len(posted) > 1 else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = folder / "export.json"
    config.write_text(json.dumps({"endpoint": f"http://127.0.0.1:{server.server_port}/", "queueDir": str(folder.parent / "queue"), "headers": {"x-key": "1"}, "batchSpanLimit": 1}))
    code, text = run("export-otel", str(folder), "--config", str(config))
    told = json.loads(text)
    assert (code, told["state"], told["sent"], told["pending"]) == (1, "queued", 2, 0) and [k for k, _ in posted] == ["1", "1"]
    assert sorted(d["state"] for d in told["deliveries"]) == ["accepted", "rejected"]
    code, text = run("export-otel", str(folder), "--config", str(config), "--resume")
    assert code == 0 and json.loads(text)["sent"] == 0 and len(posted) == 2
    server.shutdown()
    config.write_text('{"endpoint": "x"}')
    assert run("export-otel", str(folder), "--config", str(config))[0] == 2 and run("export-otel", str(folder), "--config", "absent.json")[0] == 2
    assert run("nothing")[0] == 2 and run("export-otel", str(folder))[0] == 2
    attrs = [{"key": "password", "value": {"stringValue": "hunter2"}}]
    spans = [{"traceId": "1" * 32, "spanId": "2" * 16, "startTimeUnixNano": "5000000", "name": "n", "attributes": attrs}, {"traceId": "1" * 32, "spanId": "3" * 16, "parentSpanId": "2" * 16, "startTimeUnixNano": "7000000", "endTimeUnixNano": "9000000"}]
    (folder / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    assert run("import-otel", str(folder / "x.json"), "--output", str(folder / "out"))[0] == 0
    (made,) = (folder / "out").iterdir()
    m = json.loads((made / "manifest.json").read_text())
    assert (m["run_id"], m["event_count"], m["completeness"], m["limitations"]) == (made.name, 4, "unknown", []) and m["completed_at"] == "1970-01-01T00:00:00.009Z"
    lines = [json.loads(x) for x in (made / "events.jsonl").read_text().splitlines()]
    assert [(x["sequence"], x["type"], x["monotonic_offset_ms"]) for x in lines] == [(1, "run.started", 0), (2, "otel.span", 0), (3, "otel.span", 2), (4, "run.observed", 4)]
    assert [x["parent_ids"] for x in lines] == [[]] + [[x["event_id"]] for x in lines[:3]]
    assert "hunter2" not in (made / "events.jsonl").read_text() and lines[1]["security"]["redactions"][0]["path"] == "/attributes/password"
    code, said = run("validate", str(folder / "out"))
    assert code == 0 and [json.loads(x)["code"] for x in said.splitlines()] == ["SNAPSHOT_COMPLETENESS_UNKNOWN"]
    assert [x.status_code for x in Corpus(spark, str(folder / "out")).export()[0].collect()] == [0, 0]
    with pytest.raises(FileExistsError):
        run("import-otel", str(folder / "x.json"), "--output", str(folder / "out"))
    (folder / "one" / "events.jsonl").write_text("{bad}\n")
    assert run("validate", str(folder))[0] == 1


def test_batches(spark):
    d = spark.range(1100).selectExpr("'{}' AS resource", "CASE WHEN id < 5 THEN '{\"a\":1}' ELSE '{}' END AS scope", "id AS start_ns", "cast(id AS string) AS span_id", "struct(id AS k) AS span")
    got = queue.requests(d).collect()
    assert sorted(r.n_spans for r in got) == [5, 71, 512, 512]
    big = next(r for r in got if r.n_spans == 5)
    assert [s["k"] for s in json.loads(big.request)["resourceSpans"][0]["scopeSpans"][0]["spans"]] == [0, 1, 2, 3, 4]
    assert queue.dry_run(queue.requests(d)).agg({"spans": "sum"}).first()[0] == 1100


def test_queue(tmp_path):
    t = [100.0]
    q = queue.Queue(str(tmp_path), "a", max_entries=3, retention_s=50, now=lambda: t[0])
    for b in ("x", "y"):
        q.put(b, "{}", 1)
        t[0] += 1
    queue.Queue(str(tmp_path), "other", now=lambda: t[0]).put("z", "{}", 1)
    (tmp_path / "batch-bad.json").write_text("{")
    assert q.scan()[1] == {"pending": 2, "bytes": q.scan()[1]["bytes"], "expired": 0, "malformed": 1, "foreign": 1}
    with pytest.raises(queue.Full):
        q.put("w", "{}", 1)
    states = iter(("accepted", "unknown_delivery"))
    r = q.flush(lambda request: {"state": next(states), "attempts": 2})
    assert [d["batch"] for d in r["deliveries"]] == ["x", "y"] and r["pending"] == 1 and q.scan()[0][0][1]["attempts"] == 2
    assert q.flush(lambda request: 1 / 0)["deliveries"][0]["state"] == "unknown_delivery"
    (tmp_path / "consumer.lock").touch()
    with pytest.raises(FileExistsError):
        q.flush(lambda request: {"state": "accepted"})
    t[0] += 100
    assert q.scan(drop=True)[1]["expired"] == 2 and q.scan()[1]["expired"] == 0


def test_sender():
    calls, slept = [], []

    class Reply(io.BytesIO):
        pass

    def opener(q, timeout):
        calls.append(q)
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 503, "", {"Retry-After": "2"}, None)
        return Reply(b'{"partialSuccess": {"rejectedSpans": "3"}}')

    assert queue.sender("http://x", opener=opener, sleep=slept.append)("{}") == {"state": "accepted", "attempts": 2, "rejected_spans": 3} and slept == [2.0]

    def refuse(q, timeout):
        raise urllib.error.HTTPError("u", 400, "", {}, None)

    assert queue.sender("http://x", opener=refuse)("{}")["state"] == "rejected"

    def down(q, timeout):
        raise OSError

    assert queue.sender("http://x", opener=down, sleep=slept.append)("{}") == {"state": "unknown_delivery", "attempts": 3}


def test_paths(folder, tmp_path):
    d = folder / "one"
    assert paths.faults(d) == [] and paths.trusted(d, "events.jsonl").name == "events.jsonl"
    for bad, code in (("../x", "OUTSIDE_SNAPSHOT"), ("gone", "MISSING"), ("artifacts", "UNTRUSTED_ENTRY")):
        with pytest.raises(paths.PathError) as e:
            paths.trusted(d, bad)
        assert e.value.code == code
    (d / "artifacts" / "l").symlink_to(tmp_path)
    (d / "manifest.json").unlink()
    (d / "manifest.json").symlink_to(d / "events.jsonl")
    assert paths.faults(d) == [("UNTRUSTED_MANIFEST_FILE", "manifest.json"), ("UNTRUSTED_ARTIFACT_ENTRY", "artifacts/l")]
