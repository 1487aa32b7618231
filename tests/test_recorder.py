"""Recorded runs against small cases worked by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from runweave.corpus import Corpus
from runweave.operators import recorder as R
from runweave.streaming import append

APPENDS = "run_id string, pos long, event_id string, type string, parent_ids array<string>"


def test_judged(spark):
    rows = [
        ("r", 0, "early", "note", ["x"]), ("r", 1, "a", "run.started", []), ("r", 2, "b", "note", ["a"]), ("r", 3, "c", "run.started", []), ("r", 4, "d", "note", []), ("r", 5, "e", "note", None),
        ("r", 6, "f", "note", ["a", "gone"]), ("r", 7, "g", "note", ["h"]), ("r", 8, "h", "note", ["h"]), ("r", 9, "b", "note", ["a"]), ("r", 10, "i", "run.failed", ["b"]), ("r", 11, "j", "note", ["i"]), ("r", 12, "k", "run.started", []),
        ("s", 0, "a", "note", ["a"]), ("t", 0, "z", "run.completed", ["a"]), ("t", 1, "y", "run.started", []), ("t", 2, "x", "note", ["z"]),
    ]
    got = {(r.run_id, r.pos): r.code for r in R.judged(spark.createDataFrame(rows, APPENDS)).collect()}
    assert len(got) == len(rows) and {k for k, c in got.items() if c is None} == {("r", 1), ("r", 2), ("r", 10), ("t", 1)}
    assert [got["r", k] for k in (0, 3, 4, 5, 6, 7, 8, 9, 11, 12)] == ["RUN_NOT_FOUND", "DUPLICATE_RUN_ID", "MISSING_PARENT_CONTEXT", "MISSING_PARENT_CONTEXT", "MISSING_PARENT_EVENT", "MISSING_PARENT_EVENT", "MISSING_PARENT_EVENT", "DUPLICATE_EVENT_ID", "INVALID_LIFECYCLE_TRANSITION", "DUPLICATE_RUN_ID"]
    assert got["s", 0] == got["t", 0] == "RUN_NOT_FOUND" and got["t", 2] == "MISSING_PARENT_EVENT"
    assert R.judged(spark.createDataFrame([], APPENDS)).count() == 0


def test_recorded_and_manifests(spark):
    t = lambda s: f"2024-01-01T00:00:0{s}.500Z"
    rows = [("r", 0, "a", "run.started", t(1), None), ("r", 1, "b", "note", t(3), None), ("r", 2, "c", "note", t(2), ["a"]), ("r", 3, "d", "note", t(4), ["no"]), ("r", 4, "e", "run.observed", t(5), ["c"]), ("s", 0, "a", "run.started", t(1), None)]
    e = R.recorded(spark.createDataFrame(rows, "run_id string, pos long, event_id string, type string, timestamp string, parent_ids array<string>"))
    got = {(r.run_id, r.event_id): (r.sequence, r.parent_ids, r.monotonic_offset_ms) for r in e.collect()}
    assert got == {("r", "a"): (1, [], 0.0), ("r", "b"): (2, ["a"], 2000.0), ("r", "c"): (3, ["a"], 1000.0), ("r", "e"): (4, ["c"], 4000.0), ("s", "a"): (1, [], 0.0)}
    lim = R.limitations(spark.createDataFrame([("s", 3, "x", "1"), ("s", 1, "y", "1"), ("s", 2, "x", "1"), ("s", 4, "x", "2")], "run_id string, pos long, code string, message string"))
    runs = lim.withColumns({"source": F.lit("otel-import"), "completeness": F.lit("partial")})
    m = {r.run_id: r for r in R.manifests(e, runs).collect()}
    assert (m["r"].run_state, m["r"].terminal_status, m["r"].completeness, m["r"].source, m["r"].limitations, m["r"].completed_at) == ("finished", "unknown", "complete", "native", [], t(5))
    assert (m["r"].last_sequence, m["r"].event_count, m["r"].root_event_id, m["r"].created_at) == (4, 4, "a", t(1))
    assert (m["s"].run_state, m["s"].terminal_status, m["s"].completed_at, m["s"].source, m["s"].completeness) == ("running", None, None, "otel-import", "partial")
    assert [tuple(x) for x in m["s"].limitations] == [("y", "1"), ("x", "1"), ("x", "2"), R.UNFINISHED]


def test_intercepted(spark):
    rows = spark.createDataFrame([("r", "a", 1, "x"), ("r", "b", 2, "y"), ("r", None, 3, "z")], "run_id string, event_id string, sequence long, payload string")
    got = R.intercepted(rows, lambda d: d.withColumn("payload", F.upper("payload")), lambda d: d.withColumn("sequence", F.when(F.col("event_id") == "b", 9).otherwise(F.col("sequence")))).orderBy("sequence").collect()
    assert [(r.event_id, r.sequence, r.payload, r.code) for r in got] == [("a", 1, "X", None), ("b", 2, "Y", "INTERCEPTOR_IDENTITY_MUTATION"), (None, 3, "Z", None)]
    with pytest.raises(ValueError):
        R.intercepted(rows, lambda d: d.drop("event_id"))


def test_saved_checkpoints(spark):
    new = spark.createDataFrame([("r", 5, 0, "A"), ("r", 5, 1, "A"), ("r", 5, 2, "B"), ("r", 6, 0, "A"), ("r", 7, 0, "A"), ("s", 5, 0, "B")], "run_id string, sequence long, pos long, value string")
    there = spark.createDataFrame([("r", 6, "A"), ("r", 7, "B")], "run_id string, sequence long, value string")
    got = {(r.run_id, r.sequence, r.pos): r.code for r in R.saved_checkpoints(new, there).collect()}
    assert got == {("r", 5, 0): None, ("r", 5, 1): "UNCHANGED", ("r", 5, 2): "CHECKPOINT_SEQUENCE_COLLISION", ("r", 6, 0): "UNCHANGED", ("r", 7, 0): "CHECKPOINT_SEQUENCE_COLLISION", ("s", 5, 0): None}
    assert {r.code for r in R.saved_checkpoints(new).where("sequence > 5").collect()} == {None}


def test_put(spark):
    h = lambda b: hashlib.sha256(b).hexdigest()
    c = spark.createDataFrame([(1, b"x", "text/a"), (2, b"x", "text/b"), (3, b"y", "text/a"), (4, b"z", ""), (5, None, "text/a"), (6, b"", "text/a")], "id long, content binary, media_type string")
    refs, files = R.put(c, spark.createDataFrame([(h(b"y"),)], "digest string"))
    assert {(r.id, r.digest, r.byte_length, r.code) for r in refs.collect()} == {(1, h(b"x"), 1, None), (2, h(b"x"), 1, None), (3, h(b"y"), 1, None), (4, None, None, "INVALID_MEDIA_TYPE"), (5, None, None, "INVALID_ARTIFACT_CONTENT"), (6, h(b""), 0, None)}
    assert {(r.digest, bytes(r.content)) for r in files.collect()} == {(h(b"x"), b"x"), (h(b""), b"")}


def test_projections(spark):
    texts = spark.createDataFrame([("a b\U0001f600 c",), ("  ",), ("",), (None,)], "t string")
    assert [tuple(r) for r in texts.select(R.character_count(texts["t"]), R.word_count(texts["t"])).collect()] == [(7, 3), (2, 0), (0, 0), (None, None)]
    values = spark.createDataFrame([(v,) for v in ("null", "[1]", "{}", '"x"', "1.5", "true", "{", None)], "v string")
    of = lambda t: f'{{"type":"{t}"}}'
    assert [r[0] for r in values.select(R.inferred_schema(values["v"])).collect()] == [*map(of, ("null", "array", "object", "string", "number", "boolean")), "true", "true"]
    e = spark.createDataFrame([("r", "a", "tool.failed", 1, '{"error":{"code":"E","retryable":true,"kind":"tool"}}'), ("r", "b", "run.failed", 2, '{"error":{"code":5,"retryable":"no"}}'), ("r", "c", "x.failed", 3, None), ("r", "d", "note", 4, "{}")], "run_id string, event_id string, type string, sequence long, payload string")
    got = [(r.event_id, r.code, r.retryable, r.kind) for r in R.event_errors(e.withColumn("payload", F.try_parse_json("payload"))).orderBy("sequence").collect()]
    assert got == [("a", "E", True, "tool"), ("b", "UNKNOWN_ERROR", None, None), ("c", "UNKNOWN_ERROR", None, None)]


def test_folder(spark, tmp_path):
    event = lambda k: json.dumps({"run_id": "r", "event_id": f"e{k}", "sequence": k, "type": "note", "timestamp": "t", "parent_ids": []})
    for name, text in (("whole", event(1) + "\n" + event(2) + "\n"), ("open", event(1) + "\n" + event(3)), ("cut", event(4) + '\n{"run_id'), ("bad", "{\n" + event(5) + "\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.jsonl").write_text(text)
        (tmp_path / name / "manifest.json").write_text(json.dumps({"schema_version": "9", "run_id": name, "run_state": 5, "runtime": {"name": "n"}}))
    c = Corpus(spark, str(tmp_path))
    got = {r.folder.rsplit("/", 1)[1]: (r.run_id, r.last_sequence, r.ends_with_newline, r.tail_corrupt, r.bad_lines) for r in c.tails().collect()}
    assert got == {"whole": ("r", 2, True, False, 0), "open": ("r", 3, False, False, 0), "cut": ("r", 4, False, True, 0), "bad": ("r", 5, True, False, 1)}
    assert {(r.schema_version, r.run_id, r.run_state, r.runtime_name) for r in c.metadata().collect()} == {("9", n, None, "n") for n in got}
    assert c.errors().count() == 0


def test_written_stream(spark, tmp_path):
    """A second start goes on where the first ended."""
    schema = "run_id long, ts timestamp, event_id long, number long"
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    t = __import__("datetime").datetime(2024, 1, 1)
    for rows in ([(1, t, 1, 5), (2, t, 2, 1)], [(1, t, 3, 4), (1, t, 4, 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        append.written(spark.readStream.schema(schema).parquet(source), out, log).awaitTermination()
    assert {(r.run, json.loads(r.value)["event_id"]) for r in spark.read.text(out).collect()} == {(1, 1), (2, 2), (1, 4)}


def one_by_one(appends):
    """The codes of a run's appends, taken in order."""
    ids, ended, out = [], False, []
    for event_id, kind, parents in appends:
        if not ids and kind != "run.started":
            code = "RUN_NOT_FOUND"
        elif ids and kind == "run.started":
            code = "DUPLICATE_RUN_ID"
        elif ended:
            code = "INVALID_LIFECYCLE_TRANSITION"
        elif ids and not parents:
            code = "MISSING_PARENT_CONTEXT"
        elif ids and any(p not in ids for p in parents):
            code = "MISSING_PARENT_EVENT"
        else:
            code = "DUPLICATE_EVENT_ID" if event_id in ids else None
        if code is None:
            ids.append(event_id)
            ended |= kind in R.TERMINAL
        out.append(code)
    return out


def test_refusals_cascade(spark):
    """Children of refused appends go too, refused ids stay free, a refused end leaves the run open: drawn runs with few ids against a loop."""
    rng = random.Random(4)
    runs, table = {}, []
    for r in range(1000):
        ids = [f"e{k}" for k in range(rng.randint(2, 12))]
        appends = [] if rng.random() < 0.1 else [("e0", "run.started", [])]
        for _ in range(rng.randint(1, 16)):
            kind = rng.choice(["note"] * 20 + ["run.started", "run.completed", "run.failed"])
            appends.append((rng.choice(ids), kind, rng.sample([*ids[:3], *ids, "gone"], rng.choice([0, 1, 1, 1, 1, 2]))))
        runs[f"r{r}"] = one_by_one(appends)
        table += [(f"r{r}", k, *a) for k, a in enumerate(appends)]
    got = {(r.run_id, r.pos): r.code for r in R.judged(spark.createDataFrame(table, "run_id string, pos long, event_id string, type string, parent_ids array<string>")).collect()}
    want = {(run, k): c for run, codes in runs.items() for k, c in enumerate(codes)}
    assert got == want and {*want.values()} == {None, "RUN_NOT_FOUND", "DUPLICATE_RUN_ID", "INVALID_LIFECYCLE_TRANSITION", "MISSING_PARENT_CONTEXT", "MISSING_PARENT_EVENT", "DUPLICATE_EVENT_ID"}


def test_a_refused_chain(spark):
    """30,000 appends hang on one that is refused; they go in rounds of doubling, and the end that hangs on them doesn't end the run."""
    ids = spark.range(30_000)
    chain = ids.selectExpr("'r' AS run_id", "id + 1 AS pos", "concat('e', id) AS event_id", "if(id = 29999, 'run.completed', 'note') AS type", "array(if(id = 0, 'gone', concat('e', id - 1))) AS parent_ids")
    ends = spark.createDataFrame([("r", 0, "s", "run.started", []), ("r", 30_001, "u", "note", ["s"]), ("r", 30_002, "e5", "note", ["u"])], chain.schema)
    got = R.judged(chain.unionByName(ends))
    assert {(r.code, r["count"]) for r in got.groupBy("code").count().collect()} == {("MISSING_PARENT_EVENT", 30_000), (None, 3)}
