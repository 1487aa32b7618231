"""Checkpoints and migration against small cases worked by hand."""

import hashlib
import json

from runweave.corpus import Corpus
from runweave.operators import recovery as R


def test_reconstruction(spark):
    ch = [("r", f"e{k}", k - 1, k, "/a" if k != 2 else None, "set", str(k)) for k in range(1, 6)] + [("s", "x", 0, 1, "/a", "delete", None), ("t", "y", 0, 2, "/a", "set", "1"), ("u", "z", 0, 1, "/a", "set", "1")]
    c = spark.createDataFrame(ch, "run_id string, event_id string, pos long, sequence long, path string, operation string, value_json string")
    h = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    ck = [("r", "c1", 3, "e3", '{"b":7,"a":9}', h('{"a":9,"b":7}')), ("r", "c2", 4, "e4", '{"q":1}', "0" * 64), ("r", "c3", 5, "e1", "{}", h("{}")), ("r", "c4", 5, "e5", "{", h("{}")), ("u", "c5", 1, "z", '{"end":1}', h('{"end":1}'))]
    k = spark.createDataFrame(ck, "run_id string, checkpoint_id string, sequence long, last_event_id string, state_json string, state_hash string")
    assert {r.checkpoint_id: r.code for r in R.judged_checkpoints(k, c).collect()} == {"c1": None, "c2": "CHECKPOINT_STATE_HASH_MISMATCH", "c3": "CHECKPOINT_EVENT_MISMATCH", "c4": "CHECKPOINT_STATE_UNAVAILABLE", "c5": None}
    got = {r.run_id: (r.base_sequence, r.state_json, r.error) for r in R.reconstructed(c, k).collect()}
    assert got == {"r": (3, '{"a":5,"b":7}', None), "s": (0, None, "STATE_EVENT_INVALID"), "t": (0, None, "EVENT_SEQUENCE_INVALID"), "u": (1, '{"end":1}', None)}


def test_migration(spark):
    docs = [(v, json.dumps({"schema_version": v, "run_state": s, "a": [{"schema_version": v}, {"schema_version": "9"}]})) for v, s in (("0.0.0", "finished"), ("0.1.0", "incomplete"), ("0.2.0", "finished"), ("1.0.0", "x"))] + [(None, "{}"), ("0.1.0", "{")]
    got = R.migrated(spark.createDataFrame(docs, "version string, doc string")).collect()
    by = {(r.version, r.error): r for r in got}
    one, two, now = (json.loads(by[v, None].doc) for v in ("0.0.0", "0.1.0", "0.2.0"))
    assert one["a"] == [{"schema_version": "0.2.0"}, {"schema_version": "9"}] and one["completeness"] == "complete"
    assert two["completeness"] == "partial" and two["limitations"][0]["code"] == "recording_failed" and "source" not in now
    assert sum(r.error == "UNSUPPORTED_SCHEMA_VERSION" for r in got) == 3


def test_state_in_artifacts(spark, tmp_path):
    """Changes and checkpoints that are artifacts: read, missing, of another content; only referenced files are opened."""
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ref = lambda t: {"schema_version": "0.2.0", "digest": h(t), "media_type": "application/json", "byte_length": len(t)}
    change = json.dumps({"path": "/big", "operation": "set", "value": [1, 2]})
    base = '{"from":"checkpoint"}'

    def run(name, payloads, stored, checkpoints=()):
        d = tmp_path / name
        (d / "artifacts").mkdir(parents=True)
        (d / "checkpoints").mkdir()
        line = lambda k, p: json.dumps({"schema_version": "0.2.0", "run_id": name, "event_id": f"e{k}", "parent_ids": [], "sequence": k, "type": "state.changed" if p is not None else "note", "payload": p})
        (d / "events.jsonl").write_text("".join(line(k, p) + "\n" for k, p in enumerate(payloads, 1)))
        (d / "manifest.json").write_text(json.dumps({"schema_version": "0.2.0", "run_id": name}))
        for digest, content in stored:
            (d / "artifacts" / f"sha256-{digest}").write_text(content)
        for sequence, state, state_hash in checkpoints:
            c = {"checkpoint_id": f"c{sequence}", "run_id": name, "last_event_id": f"e{sequence}", "sequence": sequence, "state": state, "state_hash": state_hash}
            (d / "checkpoints" / f"{sequence}.json").write_text(json.dumps(c))

    small = {"path": "/a", "operation": "set", "value": 1}
    run("there", [small, ref(change), None], [(h(change), change), (h("other"), "tampered, but nobody asks")])
    run("missing", [small, ref(change)], [])
    run("tampered", [small, ref(change)], [(h(change), change + " ")])
    run("shapeless", [small, {"path": "/a"}], [])
    run("based", [small, small, {**small, "path": "/b"}], [(h(base), base)], [(2, ref(base), h(base))])
    run("unbased", [small, small], [], [(2, ref(base), h(base))])
    run("listed", [small, small], [(h("[1]"), "[1]")], [(2, ref("[1]"), h("[1]"))])
    got = {r.run_id: (r.base_sequence, r.state_json, r.error) for r in Corpus(spark, str(tmp_path)).state().collect()}
    assert got == {
        "there": (0, '{"a":1,"big":[1,2]}', None),
        "missing": (0, None, "STATE_VALUE_INVALID"),
        "tampered": (0, None, "STATE_VALUE_INVALID"),
        "shapeless": (0, None, "STATE_EVENT_INVALID"),
        "based": (2, '{"b":1,"from":"checkpoint"}', None),
        "unbased": (0, '{"a":1}', None),
        "listed": (0, '{"a":1}', None),
    }
    saved = R.with_states(spark.createDataFrame([("f", json.dumps(ref(base))), ("f", base)], "folder string, state_json string"))
    assert sorted(r.state_json or "" for r in saved.collect()) == ["", base]
