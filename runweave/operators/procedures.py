"""Operators whose rules depend on order or nesting: folds, cycles, span forests, redaction, hashes."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import adapters
from . import folding, forests
from .folding import StateError, apply_change  # noqa: F401

REDACTION_RULES = (("token", r"[0-9a-f]{32,}"), ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"))


# --- state -----------------------------------------------------------------------------------


def fold_state(changes: DataFrame, parts: int | None = None) -> DataFrame:
    """(run_id, pos, sequence, path, operation, value_json) -> run_id, state_json, state_hash, error. Runs are folded in stretches (see folding), whatever their length."""
    out = folding.fold(changes, settled, parts=parts).drop("broken")
    return out.withColumn("state_hash", F.sha2("state_json", 256))


def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    changes = te.select("run_id", "pos", "sequence", F.concat(F.lit("/"), F.translate("type", ".", "_")).alias("path"), F.when(F.col("type") == "tool.failed", "merge").otherwise("set").alias("operation"), F.when(F.col("type") == "tool.failed", F.format_string('{"n":%d}', "n")).otherwise(F.col("sequence").cast("string")).alias("value_json"))
    return fold_state(changes)


# --- graphs ----------------------------------------------------------------------------------


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names; on one machine, where none is named, a temporary one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder. Unlike a checkpoint's, its plan knows nothing of how they were made, so that plans of many rounds stay small."""
    path = f"{shared(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def peeled(pdf: pd.DataFrame) -> pd.DataFrame:
    """A small run: sources go, one after another; what is left is held up by a cycle."""
    ids = set(pdf.event_id)
    children: dict = {}
    degree = dict.fromkeys(ids, 0)
    for e, p in set(zip(pdf.event_id, pdf.parent_id, strict=True)):
        if p in ids:
            children.setdefault(p, []).append(e)
            degree[e] += 1
    ready = [e for e, d in degree.items() if not d]
    while ready:
        for c in children.get(ready.pop(), ()):
            degree[c] -= 1
            if not degree[c]:
                ready.append(c)
    run = pdf.run_id.iloc[0]
    return pd.DataFrame([(run, e) for e in sorted(e for e, d in degree.items() if d > 0)], columns=["run_id", "event_id"], dtype=object)


def known_edges(events: DataFrame) -> DataFrame:
    """run_id, event_id, parent_id of the parents that are events of their run."""
    ids = events.select("run_id", F.col("event_id").alias("parent_id")).distinct()
    return events.where("parent_id IS NOT NULL").select("run_id", "event_id", "parent_id").join(ids, ["run_id", "parent_id"], "left_semi").select("run_id", "event_id", "parent_id")


def cyclic_events(events: DataFrame, most: int = forests.SMALL) -> DataFrame:
    """run_id, event_id of the events (run_id, event_id, parent_id) whose parents never all resolve: members of cycles and what follows from them.

    With a column pos, only runs with a parent that doesn't stand before its child are looked into, as others can't hold a cycle.
    """
    edges = known_edges(events)
    if "pos" in events.columns:
        first = events.groupBy("run_id", "event_id").agg(F.min("pos").alias("at"))
        above = first.select("run_id", F.col("event_id").alias("parent_id"), F.col("at").alias("above"))
        risen = edges.join(first, ["run_id", "event_id"]).join(above, ["run_id", "parent_id"]).where("above >= at").select("run_id").distinct()
        edges = edges.join(risen, "run_id", "left_semi")
    return forests.held_up(edges, peeled, settled, most)


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyclic_events(adapters.views(spark, sf_dir, ("tf",))["tf"])


def span_forest(spans: DataFrame) -> DataFrame:
    """Pre-order of the span forest; of spans with one id the first counts, and the greatest id of each cycle loses its parent (otlp.forest)."""
    from . import otlp

    first = spans.groupBy("trace_id", "span_id").agg(F.min(F.struct("start_ns", "parent_span_id")).alias("x")).select("trace_id", "span_id", "x.start_ns", "x.parent_span_id")
    known = first.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("parent"))
    return otlp.forest(first.join(known, ["trace_id", "parent_span_id"], "left")).drop("parent")


def otlp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_forest(adapters.views(spark, sf_dir, ("sp",))["sp"])


# --- redaction and hashes --------------------------------------------------------------------


def redacted(text: F.Column, rules=REDACTION_RULES, strategy: str = "mask") -> F.Column:
    """Applies regex rules in order: mask leaves the category's mark, remove leaves nothing. References are made by redaction.Pipeline."""
    for name, pattern in rules:
        text = F.regexp_replace(text, pattern, "" if strategy == "remove" else f"[REDACTED:{name}]")
    return text


def redact_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", redacted(F.col("text")).alias("clean"))
    return d.where("clean <> text").select("doc_id", F.sha2("clean", 256).alias("digest"))


def redaction_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = [d.select("doc_id", F.lit(n).alias("category"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")).where("n > 0") for n, p in REDACTION_RULES]
    return parts[0].unionByName(parts[1])


def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalar.state_hash(F.col("props")).alias("state_hash"))


def otlp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = adapters.views(spark, sf_dir, ("sp",))["sp"]
    return sp.select("trace_id", "span_id", "n", F.concat(F.lit("run_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-run:"), "trace_id"))).alias("run_id"), F.concat(F.lit("evt_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-event:"), "trace_id", F.lit(":"), "span_id"))).alias("event_id"))


UUID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('4', substr(h, 14, 3)), concat(translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3)), substr(h, 21, 12))"
QUERIES = {f.__name__: f for f in (state_fold, event_cycles, otlp_forest, redact_regex, redaction_entries, state_hash, otlp_ids)}
_CLEAN = "text"
for _n, _p in REDACTION_RULES:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '[REDACTED:{_n}]', 'g')"
ORACLES = {
    "redact_regex": f"SELECT doc_id, sha256({_CLEAN}) AS digest FROM documents WHERE {_CLEAN} <> text",
    "redaction_entries": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents WHERE len(regexp_extract_all(text, '{p}')) > 0" for n, p in REDACTION_RULES),
    "state_hash": "SELECT event_id, sha256(replace(props, ' ', '')) AS state_hash FROM events",
    "otlp_ids": adapters.duck(
        f"SELECT trace_id, span_id, n, concat('run_', {UUID.replace('h,', 'hr,')}) AS run_id, concat('evt_', {UUID.replace('h,', 'he,')}) AS event_id FROM (SELECT *, sha256(concat('otlp-run:', trace_id)) AS hr, sha256(concat('otlp-event:', trace_id, ':', span_id)) AS he FROM sp) x",
        ("sp",),
    ),
}
