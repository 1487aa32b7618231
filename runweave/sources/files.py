"""Files of given names written by tasks: each is written under another name and then moved, so that a file is whole or absent."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = pa.schema([("run", pa.string()), ("error", pa.string())])
LAST = 2**63 - 1


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def present(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def placed(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Moves a file or folder to its name; an attempt before that got there counts."""
    if present(fs, target) and not present(fs, source):
        return
    fs.move(source, target)


def _installed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for b in batches:
            for r in b.to_pylist():
                home, name = f"{root.rstrip('/')}/{r['name']}".rsplit("/", 1)
                fs.create_dir(home, recursive=True)
                spare = f"{home}/.{name}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(spare, compression=None) as out:
                    out.write(r["content"])
                if present(fs, f"{home}/{name}"):
                    fs.delete_file(f"{home}/{name}")
                fs.move(spare, f"{home}/{name}")
            yield pa.RecordBatch.from_pylist([{"run": r, "error": None} for r in b.column("name").to_pylist()], DONE)

    return run


def install(rows: DataFrame, folder: str) -> int:
    """Writes (name, content) as files below folder; a file of that name is replaced, so callers leave out what must stay. Returns their number."""
    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(_installed(folder), "run string, error string").count()


def _staged(staging: str):
    """Rows of (run, sequence, value) in order -> a folder of each run; the row numbered LAST is its manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(staging)
        attempt = uuid.uuid4().hex
        name = out = None
        events = manifests = 0

        def close():
            error = None if events and manifests == 1 else f"needs events and one manifest, there are {events} and {manifests}"
            out.close()
            if error is None:
                home = f"{root}/{attempt}/{name}"
                fs.move(f"{home}/.events", f"{home}/events.jsonl")
            return pa.RecordBatch.from_pylist([{"run": f"{attempt}/{name}", "error": error}], DONE)

        for b in batches:
            for r in b.to_pylist():
                if r["run"] != name:
                    if out is not None:
                        yield close()
                    name, events, manifests = r["run"], 0, 0
                    fs.create_dir(f"{root}/{attempt}/{name}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{attempt}/{name}/.events", compression=None)
                line = r["value"].encode("utf-8", "surrogatepass") + b"\n"
                if r["sequence"] == LAST:
                    manifests += 1
                    with fs.open_output_stream(f"{root}/{attempt}/{name}/manifest.json", compression=None) as m:
                        m.write(line)
                else:
                    events += 1
                    out.write(line)
        if out is not None:
            yield close()

    return run


def _each(folder: str, staging: str, move: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        spare = opened(staging)[1]
        for b in batches:
            found = []
            for run in b.column("run").to_pylist():
                target = f"{root.rstrip('/')}/{run.split('/', 1)[1]}"
                if move:
                    placed(fs, f"{spare}/{run}", target)
                elif present(fs, target):
                    found.append({"run": target, "error": "there"})
            yield pa.RecordBatch.from_pylist(found, DONE)

    return run


def write_runs(events: DataFrame, manifests: DataFrame, folder: str) -> int:
    """Writes <folder>/<run_id>/events.jsonl and manifest.json of each run, from (run_id, sequence, value) and (run_id, value); returns their number.

    Tasks write whole run folders into a staging folder beside them, in the order of sequence; those of the attempts that counted are then moved
    by other tasks, one rename a run. Runs that lack events or a manifest, or whose folder is there already, are refused before anything is moved;
    the staging folder of a failed write stays, hidden by its name.
    """
    spark = events.sparkSession
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    rows = events.select(F.col("run_id").cast("string").alias("run"), F.col("sequence").cast("long").alias("sequence"), "value")
    rows = rows.unionByName(manifests.select(F.col("run_id").cast("string").alias("run"), F.lit(LAST).alias("sequence"), "value"))
    rows.repartition("run").sortWithinPartitions("run", "sequence").mapInArrow(_staged(f"{staging}/runs"), "run string, error string").write.parquet(f"{staging}/index")
    index = spark.read.parquet(f"{staging}/index")
    if bad := index.where("error IS NOT NULL").head(1):
        raise ValueError(f"run {bad[0].run.split('/', 1)[1]} {bad[0].error}")
    step = lambda move: index.select("run").mapInArrow(_each(folder, f"{staging}/runs", move), "run string, error string")
    if there := step(False).head(1):
        raise FileExistsError(f"run folders are there already, such as {there[0].run}")
    n = index.count()
    step(True).count()
    fs, path = opened(staging)
    fs.delete_dir(path)
    return n
