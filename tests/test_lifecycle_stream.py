"""The lifecycle as a stream: the same verdicts for any cut into micro-batches, runs found on disk, runs given up."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from runweave.operators import recorder
from runweave.streaming import lifecycle

APPENDS = "run_id string, pos long, event_id string, type string, parent_ids array<string>"


def drawn(rng, runs):
    for r in range(runs):
        ids = [f"e{k}" for k in range(8)]
        for k in range(rng.randint(1, 14)):
            kind = "run.started" if k == 0 and rng.random() < 0.9 else rng.choice(["note"] * 12 + ["run.started", "run.completed"])
            yield (f"r{r}", k, rng.choice(ids), kind, rng.sample([*ids, "gone"], rng.choice([0, 1, 1, 2])))


def streamed(spark, tmp, batches, patience_ms=None, found=None):
    """The rows of a stream that gets each list of appends as a micro-batch."""
    names = ("run_id", "pos", "event_id", "type", "parent_ids")
    tmp.joinpath("in").mkdir()
    for k, rows in enumerate(batches):
        path = tmp / "in" / f"{k:03d}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(APPENDS).option("maxFilesPerTrigger", 1).json(str(tmp / "in"))
    with lifecycle.rocks(spark):
        return lifecycle.judged(source, patience_ms, found).writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "log")), str(tmp / "out")


def test_any_cut_gives_the_same_verdicts(spark, tmp_path):
    rng = random.Random(6)
    table = list(drawn(rng, 40))
    want = {(r.run_id, r.pos): r.code for r in recorder.judged(spark.createDataFrame(table, APPENDS)).collect()}
    assert len({*want.values()}) == 7
    for k, cuts in enumerate(([0, 15], [0, 1, 2, 5, 9, 15])):
        (tmp_path / str(k)).mkdir()
        batches = [[r for r in table if lo <= r[1] < hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        for b in batches:
            rng.shuffle(b)
        with lifecycle.rocks(spark):
            writer, out = streamed(spark, tmp_path / str(k), batches)
            writer.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(lifecycle.SCHEMA).parquet(out).collect()
        assert {(r.run_id, r.pos): r.code for r in rows} == want and len(rows) == len(want)
        for run in {r.run_id for r in rows}:
            taken = [r.sequence for r in sorted(rows, key=lambda r: r.pos) if r.run_id == run and r.code is None]
            assert taken == list(range(1, len(taken) + 1))


def test_runs_found_on_disk_go_on_and_quiet_ones_are_given_up(spark, tmp_path):
    found = spark.createDataFrame([("a", "s", "run.started", 1), ("a", "x", "note", 2), ("b", "s", "run.started", 1), ("b", "t", "run.failed", 2), ("q", "s", "run.started", 1)], "run_id string, event_id string, type string, sequence long")
    rows = [("a", 0, "y", "note", ["x"]), ("a", 1, "x", "note", ["y"]), ("a", 2, "z", "run.started", []), ("b", 0, "u", "note", ["s"]), ("c", 0, "u", "note", ["s"])]
    with lifecycle.rocks(spark):
        writer, out = streamed(spark, tmp_path, [rows], 1500, found)
        q = writer.trigger(processingTime="500 milliseconds").start()
        end = time.time() + 60
        given_up = set()
        while time.time() < end and given_up != {"a", "q"}:
            time.sleep(1)
            if os.path.exists(f"{out}/_spark_metadata"):
                given_up = {r.run_id for r in spark.read.schema(lifecycle.SCHEMA).parquet(out).where(F.col("code") == lifecycle.ABANDONED).collect()}
        q.stop()
        q.awaitTermination()
    got = {(r.run_id, r.pos): (r.sequence, r.code) for r in spark.read.schema(lifecycle.SCHEMA).parquet(out).collect()}
    assert given_up == {"a", "q"}
    assert got["a", 0] == (3, None) and got["a", 1] == (None, "DUPLICATE_EVENT_ID") and got["a", 2] == (None, "DUPLICATE_RUN_ID")
    assert got["b", 0] == (None, "INVALID_LIFECYCLE_TRANSITION") and got["c", 0] == (None, "RUN_NOT_FOUND") and got["a", None] == (3, lifecycle.ABANDONED)
