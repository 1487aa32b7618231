"""An exporter of spans: requests are committed to a spool, and a stream delivers them in the background.

A request is delivered by the task that reads it, and marked by a file once it was answered, so that a repeated epoch, task or flush
sends nothing twice (but for an answer whose mark was lost with its executor; such a request carries the same id again).
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queue
from .files import opened, present

SPOOL = "id string, group string, batch string, n_spans long, request string"
DELIVERY = "id string, state string, attempts int, n_spans long, rejected_spans long, message string"
_ARROW = pa.schema([("id", pa.string()), ("state", pa.string()), ("attempts", pa.int32()), ("n_spans", pa.int64()), ("rejected_spans", pa.int64()), ("message", pa.string())])
#: Fixed value: deliveries that are remembered.
HISTORY = 128
FINAL = ("accepted", "rejected")


def _delivered(marks: str, send: Callable[[str], dict]):
    """Requests -> their deliveries; those marked already give no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(marks)
        fs.create_dir(root, recursive=True)
        for b in batches:
            out = []
            for r in b.select(["id", "n_spans", "request"]).to_pylist():
                if present(fs, f"{root}/{r['id']}"):
                    continue
                try:
                    d = send(r["request"])
                except Exception as e:  # noqa: BLE001 - a sender that fails leaves the delivery unknown
                    d = {"state": "unknown_delivery", "attempts": 1, "message": str(e)}
                if d["state"] in FINAL:
                    with fs.open_output_stream(f"{root}/{r['id']}") as mark:
                        mark.write(d["state"].encode())
                out.append({"id": r["id"], "state": d["state"], "attempts": d.get("attempts", 1), "n_spans": r["n_spans"], "rejected_spans": d.get("rejected_spans", 0), "message": d.get("message")})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


class Exporter:
    """send: one request -> {state: accepted, rejected or unknown_delivery, ...}, such as queue.sender(url); it runs in tasks. folder: shared by all executors."""

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[str], dict], batch_spans: int = queue.SPANS_PER_BATCH, max_entries: int = queue.MAX_ENTRIES, max_bytes: int = queue.MAX_BYTES, history: int = HISTORY):
        self.spark, self.folder, self.send = spark, folder.rstrip("/"), send
        self.batch_spans, self.max_entries, self.max_bytes = max(1, batch_spans), max_entries, max_bytes
        self.history: deque[dict] = deque(maxlen=history)
        self.sent = 0
        spark.createDataFrame([], SPOOL).write.mode("append").parquet(f"{self.folder}/spool")
        self.stream = None

    def _spooled(self) -> DataFrame:
        return self.spark.read.schema(SPOOL).parquet(f"{self.folder}/spool")

    def pending(self) -> DataFrame:
        """Spooled requests that have no mark yet."""
        fs, root = opened(f"{self.folder}/marks")
        if not present(fs, root):
            return self._spooled()
        marks = self.spark.read.format("binaryFile").load(f"{self.folder}/marks").select(F.regexp_extract("path", "([^/]+)$", 1).alias("id"))
        return self._spooled().join(marks, "id", "left_anti")

    def export(self, spans: DataFrame) -> dict:
        """Commits the requests of spans (resource, scope, start_ns, span_id, span) to the spool, in order of group and batch, as far as they fit, and starts their delivery."""
        held = self.pending().agg(F.count("*"), F.coalesce(F.sum(F.octet_length("request")), F.lit(0))).first()
        export = uuid.uuid4().hex
        r = queue.requests(spans, self.batch_spans)
        r = r.withColumn("id", F.sha2(F.concat_ws("|", F.lit(export), "group", "batch"), 256))
        path = f"{self.folder}/exports/{export}"
        r.select("id", "group", "batch", "n_spans", "request").write.parquet(path)
        r = self.spark.read.schema(SPOOL).parquet(path)
        # of more requests than may wait none is looked at, so this is a bounded list
        order = r.select("id", "group", F.octet_length("request").alias("bytes"), F.col("batch").cast("long").alias("n")).orderBy("group", "n")
        first = order.limit(max(0, self.max_entries - held[0]) + 1).collect()
        fits, room = [], self.max_bytes - held[1]
        for row in first[: self.max_entries - held[0]]:
            if row.bytes > room:
                break
            room -= row.bytes
            fits.append((row.id,))
        taken = r.join(F.broadcast(self.spark.createDataFrame(fits, "id string")), "id", "left_semi")
        if fits:
            taken.coalesce(64).write.mode("append").parquet(f"{self.folder}/spool")
            self._start()
        whole = bool(first) and len(fits) == len(first)
        message = None if whole else "QUEUE_CAPACITY_EXCEEDED" if first else "no spans to send"
        return {"state": "queued" if whole else "not_queued", "batches": len(fits), "message": message}

    def _start(self) -> None:
        if self.stream is None or not self.stream.isActive:
            rows = self.spark.readStream.schema(SPOOL).parquet(f"{self.folder}/spool")
            self.stream = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/log").trigger(processingTime="200 milliseconds").start()

    def _batch(self, rows: DataFrame, epoch: int) -> None:
        self._deliver(rows, f"epoch-{epoch}")

    def _deliver(self, rows: DataFrame, name: str) -> None:
        """Sends what isn't marked, keeps the deliveries as a table, and the last of them in the history."""
        path = f"{self.folder}/deliveries/{name}-{uuid.uuid4().hex}"
        rows.mapInArrow(_delivered(f"{self.folder}/marks", self.send), DELIVERY).write.parquet(path)
        found = rows.sparkSession.read.schema(DELIVERY).parquet(path)
        self.sent += found.count()
        self.history += [r.asDict() for r in found.limit(self.history.maxlen).collect()]

    def flush(self, deadline_s: float | None = None) -> dict:
        """Waits for the stream, tries once more what got no final answer, and tells the deliveries since the last flush (the last of them, if they are many)."""
        start = time.monotonic()
        late = lambda: deadline_s is not None and time.monotonic() - start >= deadline_s
        if self.stream is not None and self.stream.isActive:
            while not late() and (self.stream.status["isDataAvailable"] or self.stream.status["isTriggerActive"] or self.stream.lastProgress is None):
                time.sleep(0.05)
            if not late():
                self.stream.processAllAvailable()
        left = self.pending()
        if not late() and not left.isEmpty():
            self._deliver(left, "again")
        n, deadline = self.pending().count(), late()
        out = {"deliveries": list(self.history), "sent": self.sent, "pending": n, "deadline_exceeded": deadline}
        self.history.clear()
        self.sent = 0
        return out

    def shutdown(self, deadline_s: float | None = None) -> dict:
        out = self.flush(deadline_s)
        if self.stream is not None:
            self.stream.stop()
        return out
