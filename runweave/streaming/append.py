"""Ordered appends as a stream: an event is accepted if its number is above all that its run has accepted."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def _step(key, frames, state: GroupState):
    (top,) = state.get if state.exists else (0,)
    pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    ok = []
    for n in pdf["number"]:
        ok.append(n > top)
        top = max(top, n)
    state.update((int(top),))
    yield pd.DataFrame({"run_id": key[0], "event_id": pdf["event_id"], "number": pdf["number"], "accepted": ok})


def accept(events: DataFrame) -> DataFrame:
    """A stream of (run_id, ts, event_id, number) -> run_id, event_id, number, accepted."""
    return events.groupBy("run_id").applyInPandasWithState(_step, "run_id long, event_id long, number long, accepted boolean", "top long", "append", GroupStateTimeout.NoTimeout)


#: When accepted events become visible: as soon as they are there, all that is there now, or at an interval.
FLUSH = {"event": {"processingTime": "0 seconds"}, "batch": {"availableNow": True}}


def written(events: DataFrame, folder: str, log: str, flush: str = "batch") -> StreamingQuery:
    """Writes a stream of events as JSON lines below folder, by run, those that `accept` refuses left out; log holds offsets and state, so that a new start goes on.

    flush: event, batch, or an interval such as "10 seconds".
    """
    rows = accept(events).where("accepted").drop("accepted")
    lines = rows.select(F.col("run_id").alias("run"), F.to_json(F.struct("*")).alias("value"))
    trigger = FLUSH.get(flush) or {"processingTime": flush}
    return lines.writeStream.partitionBy("run").format("text").option("path", folder).option("checkpointLocation", log).outputMode("append").trigger(**trigger).start()


def _streamed(spark: SparkSession, sf_dir: str, accepted: bool) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.selectExpr("user_id AS run_id", "cast(ts AS timestamp) AS ts", "event_id", "cast(round(value * 100) AS bigint) AS number")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = accept(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").where(f"accepted = {str(accepted).lower()}").select("run_id", "event_id", "number")


def stream_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, True)


def stream_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, False)


_SQL = """SELECT run_id, event_id, number FROM (SELECT *, coalesce(max(number) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top
 FROM (SELECT user_id AS run_id, ts, event_id, cast(round(value * 100) AS bigint) AS number FROM events) x) y WHERE number """
QUERIES = {"stream_accept": stream_accept, "stream_reject": stream_reject}
ORACLES = {"stream_accept": _SQL + "> top", "stream_reject": _SQL + "<= top"}
