"""Mock replays written as runs."""

import hashlib
import io
import json

from runweave import cli
from runweave.corpus import Corpus
from runweave.operators import schema

from .test_schema import EVT, MANIFEST, RUN, event, make  # noqa: F401

ERROR = {"code": "c", "message": "m", "retryable": True}
ROWS = [
    ("run.started", [], {"runtime": {"name": "n", "version": "1"}}),
    ("tool.requested", [1], {"correlation_key": "k", "tool": "t", "arguments": {"q": 1}}),
    ("state.changed", [2], {"path": "/a", "operation": "set", "value": {"x": [1]}}),
    ("tool.failed", [2], {"correlation_key": "k", "error": ERROR, "attempt": 1}),
    ("decision.recorded", [4], {"decision": "d", "basis_summary": "b", "success_conditions": ["s"]}),
    ("tool.requested", [5], {"correlation_key": "k", "tool": "t", "arguments": {"q": 1}}),
    ("tool.completed", [6], {"correlation_key": "k", "output": None, "more": 1}),
    ("state.changed", [7], {"path": "/a/x", "operation": "append", "value": 2}),
]


def written(folder):
    (d,) = folder.iterdir()
    return json.loads((d / "manifest.json").read_text()), [json.loads(x) for x in (d / "events.jsonl").read_text().splitlines()]


def test_replayed_run(spark, make, tmp_path):  # noqa: F811
    rows = [event(k + 1, *r) for k, r in enumerate(ROWS)]
    folder = make(rows, {**MANIFEST, "last_sequence": 8, "event_count": 8}, (), ())
    out = io.StringIO()
    assert cli.main(["replay", folder, "--output", str(tmp_path / "again")], spark, out) == 0
    r = json.loads(out.getvalue())
    digest = hashlib.sha256(b'{"a":{"x":[1,2]}}').hexdigest()
    assert (r["run_id"], r["codes"], r["state_hash"]) == (RUN, [], digest)
    m, lines = written(tmp_path / "again")
    assert m["run_id"] == r["replay_id"] and m["terminal_status"] == "completed" and not list(schema.problems(schema.MANIFEST, m))
    assert not [p for x in lines for p in schema.problems(schema.EVENT, x)]
    assert [x["type"] for x in lines] == ["run.started", *(ROWS[k][0] for k in (1, 2, 3, 5, 6, 7)), "run.completed"]
    assert lines[3]["payload"] == ROWS[3][2] and lines[5]["payload"] == {"correlation_key": "k", "output": None} and lines[4]["payload"] == ROWS[5][2]
    ids = [x["event_id"] for x in lines]
    assert [[ids.index(p) for p in x["parent_ids"]] for x in lines] == [[], [0], [0], [1], [0], [4], [0], [0]]
    assert lines[-1]["payload"] == {"final_state_hash": digest, "output": {"mode": "mock", "source_run_id": RUN}} and lines[0]["payload"]["input"]["source_run_id"] == RUN
    again = Corpus(spark, str(tmp_path / "again"))
    assert again.validate(schemas=True).count() == 0 and again.state().first().state_hash == digest


def test_failed_replays(spark, make, tmp_path):  # noqa: F811
    rows = [event(k + 1, *r) for k, r in enumerate(ROWS)]
    manifest = {**MANIFEST, "last_sequence": 8, "event_count": 8}
    # a checkpoint whose state the events don't give
    state = {"a": {"x": [5]}}
    text = json.dumps(state, separators=(",", ":"))
    saved = {"schema_version": "0.2.0", "checkpoint_id": "cp_1", "run_id": RUN, "last_event_id": EVT.format(5), "sequence": 5, "state_hash": hashlib.sha256(text.encode()).hexdigest(), "state": state}
    folder = make(rows, manifest, (saved,), ())
    assert Corpus(spark, folder).replay_runs(str(tmp_path / "a")).first().codes == ["FINAL_STATE_MISMATCH"]
    assert [x["type"] for x in written(tmp_path / "a")[1]][-1] == "run.failed"
    # a second result of the first request, of another type: the last is the recorded one
    rows[4] = event(5, "tool.completed", [2], {"correlation_key": "k", "output": 1})
    (tmp_path / "runs" / "one" / "checkpoints" / "000000.json").unlink()
    folder = make(rows, manifest, (), ())
    assert Corpus(spark, folder).replay_runs(str(tmp_path / "b")).first().codes == ["RECORDED_OUTCOME_MISMATCH"]
    assert [x["type"] for x in written(tmp_path / "b")[1]] == ["run.started", "tool.requested", "state.changed", "tool.completed", "run.failed"]
    # partial recordings may only be observed
    m, lines = (make(rows, {**manifest, "completeness": "partial", "source": "otel-import"}, (), ()), None)
    got = Corpus(spark, m).replay_runs(str(tmp_path / "c")).first()
    assert got.codes == ["SOURCE_TRACE_OBSERVATION_ONLY"] and got.state_hash is None
    m, lines = written(tmp_path / "c")
    assert m["terminal_status"] == "failed" and [x["type"] for x in lines] == ["run.started", "run.failed"] and lines[1]["payload"]["error"]["message"] == "SOURCE_TRACE_OBSERVATION_ONLY"
