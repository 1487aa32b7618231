"""Appends of runs as a stream: which ones a run takes, with its ids and its end as state, a timer for runs that nobody goes on with, and runs found on disk to start from.

The verdicts are those of recorder.judged, however the appends are cut into micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.procedures import shared
from ..operators.recorder import ORACLES as RECORDED
from ..operators.recorder import TERMINAL, appends

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "run_id string, pos long, event_id string, type string, sequence long, code string"
#: The code of the row that tells that a run is given up.
ABANDONED = "UNFINISHED_RUN"


class Lifecycle(StatefulProcessor):
    """Per run: whether it is there and has ended, its last sequence, and the sequence of each event id that it has taken."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "ended boolean, sequence long")
        self.ids = handle.getMapState("ids", "event_id string", "sequence long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ended, top = self.run.get() if self.run.exists() else (False, 0)
        for r in initialState.sort_values("sequence").itertuples(index=False):
            self.ids.updateValue((r.event_id,), (int(r.sequence),))
            ended, top = ended or r.type in TERMINAL, max(top, int(r.sequence))
        self.run.update((ended, top))
        self._wait(timerValues, ended)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, top = self.run.get() if self.run.exists() else (False, 0)
        there, new = {}, {}  # ids asked for in this batch, and those taken in it

        def known(event_id: str) -> bool:
            if event_id not in there:
                there[event_id] = top > 0 and self.ids.containsKey((event_id,))
            return there[event_id]

        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values("pos", kind="stable").itertuples(index=False):
            parents = [] if r.parent_ids is None else list(r.parent_ids)
            if top == 0 and r.type != "run.started":
                code = "RUN_NOT_FOUND"
            elif top and r.type == "run.started":
                code = "DUPLICATE_RUN_ID"
            elif ended:
                code = "INVALID_LIFECYCLE_TRANSITION"
            elif top and not parents:
                code = "MISSING_PARENT_CONTEXT"
            elif top and not all(map(known, parents)):
                code = "MISSING_PARENT_EVENT"
            else:
                code = "DUPLICATE_EVENT_ID" if known(r.event_id) else None
            if code is None:
                top, ended = top + 1, ended or r.type in TERMINAL
                there[r.event_id], new[r.event_id] = True, top
            out.append((key[0], r.pos, r.event_id, r.type, None if code else top, code))
        for event_id, sequence in new.items():
            self.ids.updateValue((event_id,), (sequence,))
        if top:
            self.run.update((ended, top))
            self._wait(timerValues, ended)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for a run that hasn't ended: it counts as ended from now on."""
        ended, top = self.run.get()
        self.run.update((True, top))
        yield self._frame([] if ended else [(key[0], None, None, None, top, ABANDONED)])

    def _wait(self, timerValues, ended: bool) -> None:
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["run_id", "pos", "event_id", "type", "sequence", "code"], dtype=object)
        return frame.astype({"pos": "Int64", "sequence": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State of several variables needs this store; queries started inside use it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def judged(rows: DataFrame, patience_ms: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """A stream of appends (run_id, pos, event_id, type, parent_ids) -> run_id, pos, event_id, type, sequence (of those taken), code (of those refused).

    In a micro-batch, appends count in order of pos; batches count as they come. patience_ms: a run that takes nothing for that long is ended
    by a row of code UNFINISHED_RUN. found: run_id, event_id, type, sequence of the events that are there when the stream starts, such as those of
    files whose last line is broken. Start the query inside `rocks`.
    """
    grouped = rows.select("run_id", "pos", "event_id", "type", "parent_ids").groupBy("run_id")
    first = None if found is None else found.select("run_id", "event_id", "type", "sequence").groupBy("run_id")
    return grouped.transformWithStateInPandas(Lifecycle(patience_ms), SCHEMA, "Append", "None" if patience_ms is None else "ProcessingTime", first)


def run_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the stream over all appends, written as a table."""
    top = f"{shared(spark).rstrip('/')}/lifecycle-{uuid.uuid4().hex}"
    appends(spark, sf_dir).select("run_id", "pos", "event_id", "type", "parent_ids").write.parquet(f"{top}/appends")
    source = spark.readStream.schema(spark.read.parquet(f"{top}/appends").schema).parquet(f"{top}/appends")
    with rocks(spark):
        q = judged(source).writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{top}/rows").where(F.col("pos").isNotNull()).select("run_id", "pos", "event_id", "code")


QUERIES = {"run_lifecycle_stream": run_lifecycle_stream}
ORACLES = {"run_lifecycle_stream": RECORDED["run_lifecycle"]}
