"""Files that tasks write."""

import hashlib
import json

import pytest
from runweave.corpus import Corpus
from runweave.operators import folders
from runweave.sources import files


def read(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc") and not p.relative_to(folder).parts[0].startswith("_")}


def test_runs(spark, tmp_path):
    e = spark.createDataFrame([("a", 2, "2"), ("a", 1, "1"), ("b", 1, "é")], "run_id string, sequence long, value string")
    m = spark.createDataFrame([("a", "A"), ("b", "B")], "run_id string, value string")
    out = tmp_path / "out"
    assert files.write_runs(e, m, str(out)) == 2
    want = {"a/events.jsonl": "1\n2\n", "a/manifest.json": "A\n", "b/events.jsonl": "é\n", "b/manifest.json": "B\n"}
    assert read(out) == want
    more = spark.createDataFrame([("c", 1, "1"), ("b", 1, "new")], "run_id string, sequence long, value string")
    with pytest.raises(FileExistsError):
        files.write_runs(more, spark.createDataFrame([("b", "B"), ("c", "C")], "run_id string, value string"), str(out))
    for manifests in ([("c", "C")], [("b", "B"), ("b", "B"), ("c", "C")]):
        with pytest.raises(ValueError, match="run b"):
            files.write_runs(more, spark.createDataFrame(manifests, "run_id string, value string"), str(tmp_path / f"other{len(manifests)}"))
    assert read(out) == want
    assert files.write_runs(e.limit(0), m.limit(0), str(tmp_path / "none")) == 0


def test_checkpoints_and_artifacts(spark, tmp_path):
    out = tmp_path / "out"
    c = spark.createDataFrame([("r", 5, 0, "{}"), ("r", 5, 1, "[]"), ("s", 1234567, 0, "{}")], "run_id string, sequence long, pos long, value string")
    assert [tuple(x) for x in folders.save_checkpoints(c, str(out)).collect()] == [("r", 5, 1, "CHECKPOINT_SEQUENCE_COLLISION")]
    assert {(x.run_id, x.pos, x.code) for x in folders.save_checkpoints(c, str(out)).collect()} == {("r", 0, "UNCHANGED"), ("r", 1, "CHECKPOINT_SEQUENCE_COLLISION"), ("s", 0, "UNCHANGED")}
    h = hashlib.sha256(b"x").hexdigest()
    a = spark.createDataFrame([("r", b"x", "t/a"), ("r", b"x", "t/b"), ("s", b"x", "t/a"), ("s", b"y", "")], "run_id string, content binary, media_type string")
    for _ in range(2):
        refs = folders.put_artifacts(a, str(out)).collect()
        assert sorted((x.run_id, x.digest, x.code) for x in refs if x.digest) == [("r", h, None), ("r", h, None), ("s", h, None)] and sum(x.code == "INVALID_MEDIA_TYPE" for x in refs) == 1
    assert read(out) == {"r/checkpoints/000005.json": "{}", "s/checkpoints/1234567.json": "{}", f"r/artifacts/sha256-{h}": "x", f"s/artifacts/sha256-{h}": "x"}


def test_migrate(spark, tmp_path):
    old, new = tmp_path / "old" / "one", tmp_path / "new"
    (old / "checkpoints").mkdir(parents=True)
    (old / "artifacts").mkdir()
    v = {"schema_version": "0.1.0", "run_id": "r"}
    (old / "manifest.json").write_text(json.dumps(v | {"run_state": "finished"}))
    (old / "events.jsonl").write_text("".join(json.dumps(v | {"event_id": f"e{k}", "sequence": k, "type": "note", "parent_ids": []}) + "\n" for k in (1, 2)))
    (old / "checkpoints" / "000002.json").write_text(json.dumps(v | {"sequence": 2, "state": {}}))
    h = hashlib.sha256(b"x").hexdigest()
    (old / "artifacts" / f"sha256-{h}").write_bytes(b"x")
    c = Corpus(spark, str(tmp_path / "old"))
    assert c.migrate(str(new)) == 1
    got = read(new)
    assert set(got) == {"one/manifest.json", "one/events.jsonl", "one/checkpoints/000002.json", f"one/artifacts/sha256-{h}"}
    m = json.loads(got["one/manifest.json"])
    assert (m["schema_version"], m["source"], m["completeness"]) == ("0.2.0", "native", "complete")
    assert [(e["schema_version"], e["event_id"]) for e in map(json.loads, got["one/events.jsonl"].splitlines())] == [("0.2.0", "e1"), ("0.2.0", "e2")]
    assert json.loads(got["one/checkpoints/000002.json"])["schema_version"] == "0.2.0" and got[f"one/artifacts/sha256-{h}"] == "x"
    with pytest.raises(FileExistsError):
        c.migrate(str(new))
    (old / "events.jsonl").write_text('{"a": 1}\n{')
    with pytest.raises(ValueError, match="PARTIAL_JSONL_TAIL"):
        Corpus(spark, str(tmp_path / "old")).migrate(str(tmp_path / "third"))
    assert not (tmp_path / "third").exists()
