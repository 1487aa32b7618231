"""Event files read in byte ranges against the whole text split; filters decided while reading; writes that fail leave nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from runweave.sources import ranges, snapshots


def text(k):
    return json.dumps({"run_id": f"r{k % 3}", "sequence": k, "type": "note" if k % 2 else "tool.requested", "payload": "é\U0001f600" * (k % 5)}, ensure_ascii=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    files = {
        "a": "\n".join(map(text, range(1, 40))) + "\n",
        "b c": "\r\n".join([text(1), "", "   ", "{broken", text(5), '{"sequence": "7"}', "[1]", "x" * 300, text(8)]) + "\r\n\n\n" + text(9),
        "empty": "",
        "one": text(3),
        "ends": "\n\n" + text(4) + "\n\n",
    }
    for name, content in files.items():
        (top / name).mkdir()
        (top / name / "events.jsonl").write_bytes(content.encode())
    return str(top)


def rows(df):
    return sorted(map(tuple, df.select("folder", "line", "raw", "last").collect()))


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_any_range_gives_the_lines_of_the_file(spark, folder, size):
    want = rows(snapshots.read_lines(spark, folder))
    assert len(want) == 39 + 8 + 1 + 1 and sum(r[3] for r in want) == 2
    assert rows(ranges.read_lines(spark, folder, size=size)) == want == rows(snapshots.read_lines(spark, folder, size=size))


def test_one_file_is_many_tasks(spark, folder):
    assert ranges._source(spark, folder, "events.jsonl", 100).rdd.getNumPartitions() > 20


def test_filters_are_decided_while_reading(spark, folder):
    df = ranges.read_lines(spark, folder, size=200, where="run_id = 'r1' AND sequence >= 5 AND sequence < 20 AND type IN ('note', 'x')")
    assert sorted(r.sequence for r in df.where(F.col("folder").endswith("/a")).collect()) == [7, 13, 19]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "= r1" not in plan and "IN (note" not in plan  # Spark has no need to filter again
    asked = ranges.Condition()
    assert asked.takes(ranges.EqualTo(("run_id",), "r1")) and not asked.takes(ranges.EqualTo(("raw",), "x")) and not asked.takes(ranges.GreaterThan(("type",), "x"))
    assert asked.holds({"run_id": "r1"}) and not asked.holds({"run_id": None}) and not asked.holds({"run_id": "r2"})


def test_writes_are_committed_or_given_up(spark, tmp_path):
    top = str(tmp_path / "out")
    events = spark.range(2000).selectExpr("concat('run_', id % 7) AS run_id", "2000 - id AS sequence", "concat('{\"n\":', id, ',\"é\":1}') AS value")
    ranges.write_events(events, top)
    assert sorted(os.listdir(top)) == [f"run_{k}" for k in range(7)]
    back = ranges.read_lines(spark, top, size=500)
    assert back.count() == 2000
    first = back.where("line = 1").select(F.regexp_extract("folder", "[^/]+$", 0).alias("run"), "raw").collect()
    assert {r.run: json.loads(r.raw)["n"] for r in first} == {f"run_{k}": max(n for n in range(2000) if n % 7 == k) for k in range(7)}
    with pytest.raises(Exception, match="there already"):
        ranges.write_events(events.where("run_id = 'run_3'").unionByName(events.selectExpr("'new' AS run_id", "sequence", "value")), top)
    with pytest.raises(Exception, match="went wrong"):
        ranges.write_events(events.selectExpr("concat('late_', run_id) AS run_id", "sequence", "if(sequence = 77, raise_error('went wrong'), value) AS value"), top)
    assert sorted(os.listdir(top)) == [f"run_{k}" for k in range(7)]
