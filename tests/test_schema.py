"""Schema rules, references to artifacts, the rules of whole snapshots, filters of graphs."""

import hashlib
import io
import json

import pytest
from runweave import cli
from runweave.corpus import Corpus
from runweave.operators import schema

UUID = "{:08x}-0000-4000-8000-000000000000"
EVT, RUN = "evt_" + UUID, "run_" + UUID.format(1)
BODY = b'{"answer": 42}'
REFERENCE = {"schema_version": "0.2.0", "digest": hashlib.sha256(BODY).hexdigest(), "media_type": "application/json", "byte_length": len(BODY), "preview": "answer"}
ROWS = [
    ("run.started", [], {"runtime": {"name": "n", "version": "1"}}),
    ("model.requested", [1], {"correlation_key": "k", "model": "m", "input": [REFERENCE, {"a/b": {"digest": "no"}}]}),
    ("model.delta", [2], {}),
    ("model.delta", [3], {}),
    ("model.completed", [4], {"correlation_key": "k", "output": None}),
    ("run.completed", [5], REFERENCE),
]


def event(k, type, parents, payload, **more):
    return {"schema_version": "0.2.0", "run_id": RUN, "event_id": EVT.format(k), "parent_ids": [EVT.format(p) for p in parents], "sequence": k, "type": type, "timestamp": f"2024-01-01T00:00:0{k}Z", "monotonic_offset_ms": k, "actor": "x" if k < 5 else "y", "payload": payload, "security": {"side_effect": "read_only", "redactions": []}, **more}


MANIFEST = {
    "schema_version": "0.2.0", "snapshot_type": "run-snapshot", "run_id": RUN, "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "run_state": "finished", "terminal_status": "completed",
    "runtime": {"name": "n", "version": "1"}, "source": "native", "completeness": "complete", "limitations": [], "last_sequence": 6, "event_count": 6, "root_event_id": EVT.format(1), "completed_at": "2024-01-01T00:00:06Z",
}
CHECKPOINT = {"schema_version": "0.2.0", "checkpoint_id": "cp_" + UUID.format(1), "run_id": RUN, "created_at": "2024-01-01T00:00:00Z", "last_event_id": EVT.format(2), "sequence": 2, "state_hash": "0" * 64, "state": {}}


@pytest.fixture
def make(tmp_path):
    def made(events=None, manifest=MANIFEST, checkpoints=(CHECKPOINT,), files=((REFERENCE["digest"], BODY),)):
        d = tmp_path / "runs" / "one"
        for sub in ("checkpoints", "artifacts"):
            (d / sub).mkdir(parents=True, exist_ok=True)
        if manifest is not None:
            (d / "manifest.json").write_text(json.dumps(manifest))
        rows = [event(k + 1, *r) for k, r in enumerate(ROWS)] if events is None else events
        (d / "events.jsonl").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
        for k, c in enumerate(checkpoints):
            (d / "checkpoints" / f"{k:06}.json").write_text(json.dumps(c))
        for digest, body in files:
            (d / "artifacts" / f"sha256-{digest}").write_bytes(body)
        return str(d.parent)

    return made


def found(spark, folder, **options):
    return sorted((r.code, r.path) for r in Corpus(spark, folder).validate(**options).collect())


@pytest.mark.parametrize(
    ("rule", "value", "expected"),
    [
        ({"type": "integer", "minimum": 1}, 1.0, []),
        ({"type": "integer"}, True, [("type", "")]),
        ({"minLength": 2, "pattern": "^a"}, "b", [("minLength", ""), ("pattern", "")]),
        ({"minLength": 2}, "\U0001f600", [("minLength", "")]),
        ({"required": ["a/b"]}, {}, [("required", "/a~1b")]),
        ({"additionalProperties": False, "properties": {"a": True}}, {"a": 1, "b": 1, "c": 1}, [("additionalProperties", "")] * 2),
        ({"uniqueItems": True}, [1, True, "1", [1], [1.0]], [("uniqueItems", "")]),
        ({"uniqueItems": True}, [0, False, None, "", [], {}], []),
        ({"items": {"type": "string"}, "minItems": 3}, ["a", 1], [("minItems", ""), ("type", "/1")]),
        ({"anyOf": [{"type": "string"}, {"const": 3}]}, 4, [("type", ""), ("const", ""), ("anyOf", "")]),
        ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, [("oneOf", "")]),
        ({"not": {}}, 3, [("not", "")]),
        ({"if": {"const": 1}, "then": False, "else": {"const": 2}}, 3, [("const", ""), ("if", "")]),
        ({"$ref": "#/$defs/x", "$defs": {"x": {"properties": {"n": {"$ref": "#/$defs/x"}}, "type": "object"}}}, {"n": {"n": 1}}, [("type", "/n/n")]),
        ({"format": "date-time"}, "2024-02-30T00:00:00Z", [("format", "")]),
        ({"format": "date-time"}, "2024-02-28T00:00:00.1234567Z", []),
        ({"enum": [[1], None]}, [True], [("enum", "")]),
        (False, 1, [("false schema", "")]),
    ],
)
def test_keywords(rule, value, expected):
    assert list(schema.problems(rule, value)) == expected


def test_references_of_any_depth():
    deep = {"x": REFERENCE}
    for _ in range(5000):
        deep = [deep]
    assert [at for at, _ in schema.found_references(deep)] == ["/0" * 5000 + "/x"]
    inside = {**REFERENCE, "more": REFERENCE}
    assert [at for at, _ in schema.found_references({"a~/": inside})] == ["/a~0~1"]
    loose = {**REFERENCE, "digest": "X"}
    assert not schema.is_reference(loose) and schema.is_reference(loose, strict=False) and not schema.is_reference({**REFERENCE, "byte_length": True})


def test_valid_snapshot(spark, make):
    folder = make()
    # model.delta isn't a known type
    assert found(spark, folder, schemas=True, contents=True) == [("UNKNOWN_EVENT_TYPE", None)] * 2
    (a,) = Corpus(spark, folder).artifacts(verify=True).collect()
    assert (a.exists, a.byte_length, a.actual_byte_length, a.media_types, a.previews, a.n_references, a.valid) == (True, 14.0, 14, ["application/json"], ["answer"], 2, True)


def test_broken_documents(spark, make):
    rows = [event(k + 1, *r) for k, r in enumerate(ROWS)]
    rows[0]["payload"] = {"runtime": {"name": ""}}
    del rows[1]["security"]
    rows[2].update(run_id="other", schema_version="0.1.0")
    rows[3]["parent_ids"] *= 2
    rows.append([])
    other = {**CHECKPOINT, "run_id": "run_" + UUID.format(2), "schema_version": "0.1.0", "last_event_id": EVT.format(99)}
    manifest = {**MANIFEST, "run_state": "running", "event_count": 7, "limitations": [{"code": "missing_root", "message": "m", "x": 1}]}
    got = found(spark, make(rows, manifest, (other,)), schemas=True)
    alternatives = [("SCHEMA_REQUIRED", f"/events/0/payload/{k}") for k in ("byte_length", "digest", "media_type", "schema_version")]
    expected = [
        ("SCHEMA_CONST", "/manifest/terminal_status"), ("SCHEMA_IF", "/manifest"), ("SCHEMA_ADDITIONALPROPERTIES", "/manifest/limitations/0"),
        ("SCHEMA_MINLENGTH", "/events/0/payload/runtime/name"), ("SCHEMA_REQUIRED", "/events/0/payload/runtime/version"), ("SCHEMA_ANYOF", "/events/0/payload"), ("SCHEMA_IF", "/events/0"), *alternatives,
        ("SCHEMA_REQUIRED", "/events/1/security"), ("SCHEMA_PATTERN", "/events/2/run_id"), ("RUN_ID_MISMATCH", "/events/2/run_id"), ("SCHEMA_VERSION_MISMATCH", "/events/2/schema_version"),
        ("SCHEMA_UNIQUEITEMS", "/events/3/parent_ids"), ("SCHEMA_TYPE", "/events/6"),
        ("CHECKPOINT_RUN_ID_MISMATCH", "/checkpoints/0/run_id"), ("SCHEMA_VERSION_MISMATCH", "/checkpoints/0/schema_version"), ("MISSING_CHECKPOINT_EVENT", "/checkpoints/0/last_event_id"),
    ]
    assert sorted(x for x in got if x[1]) == sorted(expected)


def test_artifact_faults(spark, make):
    absent = {**REFERENCE, "digest": "a" * 64}
    longer = {**REFERENCE, "byte_length": 15}
    rows = [event(1, "run.started", [], {"runtime": {"name": "n", "version": "1"}, "input": [absent, longer]})]
    folder = make(rows, {**MANIFEST, "last_sequence": 1, "event_count": 1}, (), ((REFERENCE["digest"], BODY), ("b" * 64, b"other")))
    faults = [("ARTIFACT_SIZE_MISMATCH", "/events/0/payload/input/1"), ("MISSING_ARTIFACT", "/events/0/payload/input/0")]
    assert found(spark, folder) == faults
    assert found(spark, folder, contents=True) == [("ARTIFACT_DIGEST_MISMATCH", f"/artifacts/{'b' * 64}"), *faults]
    assert ("ARTIFACT_TOO_LARGE", f"/artifacts/{REFERENCE['digest']}") in found(spark, folder, contents=True, max_bytes=13)
    rows = {r.digest[0]: r for r in Corpus(spark, folder).artifacts().collect()}
    assert not rows["a"].exists and rows["b"].n_references == 0 and rows["b"].media_types == []


def test_cycles_and_files(spark, make, tmp_path):
    rows = [event(1, "run.started", [3], {}), event(2, "tool.requested", [1], {}), event(3, "tool.completed", [2], {}), event(4, "tool.failed", [3], {}), event(5, "run.observed", [], {})]
    folder = make(rows, {**MANIFEST, "last_sequence": 5, "event_count": 5, "root_event_id": EVT.format(5)}, (), ())
    got = Corpus(spark, folder).validate().where("code = 'EVENT_CYCLE'").collect()
    assert sorted(r["at"] for r in got) == [0, 1, 2, 3]
    two, three = tmp_path / "runs" / "two", tmp_path / "runs" / "three"
    two.mkdir()
    (two / "manifest.json").write_text(json.dumps({**MANIFEST, "run_id": "two"}))
    three.mkdir()
    (three / "events.jsonl").symlink_to(tmp_path / "runs" / "one" / "events.jsonl")
    by_folder = {(r.run.rsplit("/", 1)[1], r.code, r.path) for r in Corpus(spark, folder).validate().where("run LIKE 'file:%'").collect()}
    assert by_folder == {("two", "MISSING_EVENTS_FILE", None), ("three", "MISSING_MANIFEST", None), ("three", "UNTRUSTED_EVENTS_FILE", "events.jsonl")}


def test_empty_folder_of_checkpoints(spark, make):
    assert Corpus(spark, make(checkpoints=())).state().count() == 1


def test_graph_filters(spark, make):
    c = Corpus(spark, make())
    ids = lambda d: {r.node_id for r in d.collect()}
    group = "group:" + EVT.format(3)
    every, edges = c.graph()
    assert ids(every) == {EVT.format(k) for k in (1, 2, 5, 6)} | {group} and edges.count() == 4
    assert c.graph(fold=False)[0].count() == 6 and c.graph(fold=False)[1].count() == 5
    nodes, edges = c.graph(type="model.delta")
    assert ids(nodes) == {group} and edges.count() == 0
    nodes, edges = c.graph(actor="x", min_sequence=2)
    assert ids(nodes) == {EVT.format(2), group} and [(r.from_id, r.to_id) for r in edges.collect()] == [(EVT.format(2), group)]
    assert {(r.from_id, r.to_id) for r in c.graph("call-tree", max_sequence=3)[1].collect()} == {(EVT.format(1), EVT.format(2)), (EVT.format(2), group)}
    assert {(r.from_id, r.to_id) for r in c.graph("timeline", status="completed")[1].collect()} == {(EVT.format(5), EVT.format(6))}


def test_options(spark, make):
    folder = make()

    def run(*a):
        out = io.StringIO()
        return cli.main([*a], spark, out), out.getvalue().splitlines()

    code, said = run("graph", folder, "--format", "mermaid", "--actor", "x", "--no-fold-noise", "--max-sequence=3")
    assert code == 0 and said == ["flowchart TD", *(f'  node_{k}["{ROWS[k - 1][0]} [{EVT.format(k)}]"]' for k in (1, 2, 3)), "  node_1 -->|causal| node_2", "  node_2 -->|causal| node_3"]
    assert run("graph", folder, "--format", "mermaid", "--json", "--status", "started")[1][0].startswith("{")
    assert run("graph", folder, "--min-sequence", "3", "--max-sequence", "2")[0] == 2 and run("graph", folder, "--min-sequence", "x")[0] == 2
    assert run("inspect", folder, "--actor", "x")[0] == 2
    assert run("validate", folder, "--schemas", "--contents")[0] == 0
