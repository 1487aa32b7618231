"""Event files as a data source: byte ranges of them are read by many tasks, and written run folders are committed or given up as one.

A line belongs to the range in which it starts. Its physical number is its place in the range, plus the line ends before the range: these are
counted by a second, smaller pass over files that have several ranges.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .files import opened, present

#: Bytes of a range, and of a read.
RANGE, BLOCK = 64 << 20, 1 << 20
ROWS = 4096
SCHEMA = "folder string, part int, at long, raw string, last boolean, run_id string, sequence long, type string"
COUNTS = "folder string, part int, ends long, cut int"
_ARROW = pa.schema([("folder", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("raw", pa.string()), ("last", pa.bool_()), ("run_id", pa.string()), ("sequence", pa.int64()), ("type", pa.string())])


@dataclass
class Span:
    """Bytes start..stop of a file of `size` bytes."""

    path: str
    folder: str
    part: int
    start: int
    stop: int
    size: int


class Spans(InputPartition):
    def __init__(self, spans: list[Span]):
        self.spans = spans


def found(folder: str, name: str) -> list[tuple[str, str, int]]:
    """(path, folder as Spark would name it, bytes) of the files of that name below a folder."""
    fs, root = opened(folder)
    prefix = folder.split("://", 1)[0] + "://" if "://" in folder else "file:"
    infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return [(i.path, prefix + quote(i.path.rsplit("/", 1)[0]), i.size) for i in sorted(infos, key=lambda i: i.path) if i.type == pafs.FileType.File and i.base_name == name]


def large(folder: str, name: str, size: int = RANGE) -> bool:
    """Whether a file of that name is larger than a range; stores that only Spark can list have none as far as is known."""
    try:
        return any(length > size for *_, length in found(folder, name))
    except (OSError, pa.ArrowException):
        return False


def parts_of(files: list[tuple[str, str, int]], size: int) -> list[list[Span]]:
    """Ranges of large files, one each; small files share a task up to that size."""
    out: list[list[Span]] = []
    held: list[Span] = []
    for path, folder, length in files:
        if length > size:
            out += [[Span(path, folder, k, at, min(at + size, length), length)] for k, at in enumerate(range(0, length, size))]
        else:
            if sum(s.size for s in held) + length > size and held:
                out.append(held)
                held = []
            held.append(Span(path, folder, 0, 0, length, length))
    return [*out, held] if held else out


def lines(file, span: Span) -> Iterator[tuple[bytes, bool]]:
    """(line without its end, whether it lacks one) of the lines that start in the span."""
    at = max(0, span.start - 1)
    file.seek(at)
    rest, skipping = b"", span.start > 0  # up to and with the end of the line that began before
    while True:
        block = file.read(BLOCK)
        if not block:
            break
        rest += block
        if skipping:
            end = rest.find(b"\n")
            if end < 0:
                at, rest = at + len(rest), b""
                continue
            at, rest, skipping = at + end + 1, rest[end + 1 :], False
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= span.stop:
                return
            yield line, False
            at += len(line) + 1
        if at >= span.stop:
            return
    if not skipping and at < span.stop:
        yield rest, True


class Condition:
    """Filters on run, sequence and type, as far as they are pushed down; others stay with Spark."""

    RANGES = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def takes(self, f) -> bool:
        if isinstance(f, (EqualTo, In)) and f.attribute in (("run_id",), ("sequence",), ("type",)):
            self.tests.append((f.attribute[0], "in", frozenset(f.value if isinstance(f, In) else [f.value])))
        elif type(f) in self.RANGES and f.attribute == ("sequence",):
            self.tests.append(("sequence", type(f).__name__, f.value))
        else:
            return False
        return True

    def holds(self, envelope: dict) -> bool:
        by_name = {k.__name__: v for k, v in self.RANGES.items()}
        return all(envelope[c] is not None and (envelope[c] in v if how == "in" else by_name[how](envelope[c], v)) for c, how, v in self.tests)


def envelope(raw: str) -> dict:
    """run_id, sequence and type of a line; nulls where it isn't JSON or they are of another kind."""
    try:
        v = json.loads(raw)
    except ValueError:
        v = None
    get = lambda k, t: v.get(k) if isinstance(v, dict) and type(v.get(k)) is t else None
    sequence = get("sequence", int)
    return {"run_id": get("run_id", str), "sequence": sequence if sequence is not None and abs(sequence) < 2**63 else None, "type": get("type", str)}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.name, self.size = options["path"], options.get("name", "events.jsonl"), int(options.get("range", RANGE))
        self.counts, self.where = options.get("counts", "false") == "true", Condition()

    def pushFilters(self, filters):
        return [f for f in filters if self.counts or not self.where.takes(f)]

    def partitions(self):
        files = found(self.folder, self.name)
        if self.counts:
            files = [f for f in files if f[2] > self.size]
        return [Spans(s) for s in parts_of(files, self.size)] or [Spans([])]

    def read(self, partition: Spans):
        fs = opened(self.folder)[0]
        if self.counts:
            for s in partition.spans:
                with fs.open_input_file(s.path) as file:
                    file.seek(max(0, s.start - 1))
                    cut = int(s.start > 0 and file.read(1) != b"\n")
                    n, left = 0, s.stop - s.start
                    while left and (block := file.read(min(BLOCK, left))):
                        n, left = n + block.count(b"\n"), left - len(block)
                yield (s.folder, s.part, n, cut)
            return
        rows = []
        for s in partition.spans:
            with fs.open_input_file(s.path) as file:
                for at, (line, last) in enumerate(lines(file, s)):
                    raw = line.removesuffix(b"\r").decode("utf-8", "replace")
                    if raw.strip(" ") and self.where.holds(e := envelope(raw)):
                        rows.append({"folder": s.folder, "part": s.part, "at": at, "raw": raw, "last": last, **e})
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows = []
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Run folders that one attempt of a task has staged."""

    staged: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows of (run_id, sequence, value), each run's together and in order, as <folder>/<run_id>/events.jsonl. Nothing is seen before all tasks are through."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.staging = f"{self.folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = opened(self.staging)
        attempt, run, out, staged = uuid.uuid4().hex, None, None, []
        for batch in iterator:
            for r in zip(*(batch.column(c).to_pylist() for c in ("run_id", "value")), strict=True):
                if r[0] != run:
                    if out is not None:
                        out.close()
                    run = r[0]
                    home = f"{root}/{attempt}/{run}"
                    if any(run == there for there, _ in staged):
                        raise ValueError(f"events of run {run} don't stand together")
                    fs.create_dir(home, recursive=True)
                    out = fs.open_output_stream(f"{home}/events.jsonl", compression=None)
                    staged.append((run, home))
                out.write(r[1].encode("utf-8", "surrogatepass") + b"\n")
        if out is not None:
            out.close()
        return Written(staged)

    def commit(self, messages):
        fs, root = opened(self.folder)
        staged = [s for m in messages if m is not None for s in m.staged]
        twice = len({run for run, _ in staged}) < len(staged)
        if twice or any(present(fs, f"{root.rstrip('/')}/{run}") for run, _ in staged):
            self.abort(messages)
            raise FileExistsError("a run is there already, or was written by two tasks")
        for run, home in staged:
            fs.move(home, f"{root.rstrip('/')}/{run}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        fs, root = opened(self.staging)
        if present(fs, root):
            fs.delete_dir(root)


class EventFiles(DataSource):
    @classmethod
    def name(cls):
        return "run_events"

    def schema(self):
        return COUNTS if self.options.get("counts") == "true" else SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("run folders are never overwritten")
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventFiles)


def _source(spark: SparkSession, folder: str, name: str, size: int, **more: str) -> DataFrame:
    register(spark)
    r = spark.read.format("run_events").option("name", name).option("range", str(size))
    for k, v in more.items():
        r = r.option(k, v)
    return r.load(folder)


def read_lines(spark: SparkSession, folder: str, name: str = "events.jsonl", size: int = RANGE, where: str | None = None) -> DataFrame:
    """folder, line (physical, from 1), raw, last, run_id, sequence, type of every line that isn't blank, whatever the size of a file.

    where: a condition on run_id, sequence and type; comparisons of these with constants are decided while reading.
    """
    rows = _source(spark, folder, name, size)
    rows = rows if where is None else rows.where(where)
    ends = _source(spark, folder, name, size, counts="true")
    # a range that starts within a line has its first line after that line's end, so one more end lies before its lines
    before = F.coalesce(F.sum("ends").over(W.partitionBy("folder").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("folder").alias("of"), F.col("part").alias("in_part"), (before + F.col("cut")).alias("before"))
    out = rows.join(ends, (F.col("folder") == F.col("of")) & (F.col("part") == F.col("in_part")), "left")
    return out.select("folder", (F.col("at") + 1 + F.coalesce("before", F.lit(0))).alias("line"), "raw", "last", "run_id", "sequence", "type")


def write_events(events: DataFrame, folder: str) -> None:
    """(run_id, sequence, value) as run folders; on any failure none of them is there. One task writes a run."""
    register(events.sparkSession)
    rows = events.select("run_id", "sequence", "value").repartition("run_id").sortWithinPartitions("run_id", "sequence")
    rows.write.format("run_events").mode("append").save(folder)
