"""Command line: validate, inspect, graph, replay, import-otel, export-otel over snapshot folders. Exit codes: 0 well, 1 faults found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .corpus import KINDS, Corpus
from .operators import otlp, procedures, redaction
from .sources import exporter, queue, snapshots

#: States of nodes.
STATUSES = ("started", "completed", "failed", "changed", "recorded", "checkpointed", "verified", "unknown")


def sequence(text: str) -> int:
    """A whole number of 0 or more."""
    if not text.isascii() or not text.isdigit():
        raise argparse.ArgumentTypeError("must be a whole number of 0 or more")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("runweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "inspect", "graph", "replay", "export-otel"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        if name == "graph":
            c.add_argument("--kind", choices=sorted(KINDS), default="causal-dag")
            c.add_argument("--format", choices=("json", "mermaid"), default="json")
            for option in ("--actor", "--type"):
                c.add_argument(option)
            c.add_argument("--status", choices=STATUSES)
            c.add_argument("--min-sequence", type=sequence)
            c.add_argument("--max-sequence", type=sequence)
            c.add_argument("--no-fold-noise", dest="fold", action="store_false")
        if name == "validate":
            c.add_argument("--schemas", action="store_true", help="hold documents against their JSON schemas")
            c.add_argument("--contents", action="store_true", help="read artifacts and compare their digests")
        c.add_argument("--json", action="store_true", help="rows are JSON lines in any case; graphs too, instead of Mermaid")
        if name == "replay":
            c.add_argument("--mode", choices=("mock",), default="mock")
            c.add_argument("--output", help="folder for the replays, written as runs of their own")
        if name == "export-otel":
            way = c.add_mutually_exclusive_group(required=True)
            way.add_argument("--dry-run", action="store_true", help="tell what would be sent")
            way.add_argument("--config", help="JSON file with endpoint, queueDir and, if need be, headers, batchSpanLimit, queueMaxEntries, queueMaxBytes")
            c.add_argument("--resume", action="store_true", help="send only what waits in the queue")
    c = sub.add_parser("import-otel")
    c.add_argument("files", nargs="+")
    c.add_argument("--output", required=True)
    return p


def show(df, out) -> int:
    """Rows as JSON lines, fetched part by part."""
    n = 0
    for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(r.j, file=out)
        n += 1
    return n


def exported(corpus: Corpus):
    """All spans as they go into requests, metadata only."""
    s = corpus.export()[0]
    link = F.transform("links", lambda x: F.struct(F.when(x.contains("/"), F.substring_index(x, "/", 1)).otherwise(F.col("trace_id")).alias("traceId"), F.substring_index(x, "/", -1).alias("spanId")))
    text = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), F.struct(F.col("status_code").alias("code")).alias("status"), F.when(F.size("links") > 0, link).alias("links"))
    return s.select(F.lit('{"attributes":[]}').alias("resource"), F.lit('{"name":"runweave"}').alias("scope"), "start_ns", "span_id", text.alias("span"))


def settings(path: str) -> dict:
    """The settings of an exporter in a file; ValueError where they aren't right."""
    with open(path, encoding="utf-8") as f:
        s = json.load(f)
    if not isinstance(s, dict) or not all(isinstance(s.get(k), str) and s[k] for k in ("endpoint", "queueDir")):
        raise ValueError("endpoint and queueDir are needed")
    if bad := [k for k in ("batchSpanLimit", "queueMaxEntries", "queueMaxBytes") if not isinstance(s.get(k, 1), int) or s.get(k, 1) < 1]:
        raise ValueError(f"{bad[0]} must be a whole number above 0")
    return s


def delivered(corpus: Corpus, s: dict, resume: bool, out) -> int:
    """Exports all spans, or only goes on with what waits, and tells the deliveries."""
    e = exporter.Exporter(corpus.spark, s["queueDir"], queue.sender(s["endpoint"], s.get("headers")), s.get("batchSpanLimit", queue.SPANS_PER_BATCH), s.get("queueMaxEntries", queue.MAX_ENTRIES), s.get("queueMaxBytes", queue.MAX_BYTES))
    state = {"state": "resumed"} if resume else e.export(exported(corpus))
    report = {**state, **e.shutdown()}
    print(json.dumps(report, sort_keys=True), file=out)
    lost = any(d["state"] != "accepted" or d["rejected_spans"] for d in report["deliveries"])
    return int(state["state"] == "not_queued" or report["pending"] > 0 or lost)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "graph" and a.min_sequence is not None and a.max_sequence is not None and a.min_sequence > a.max_sequence:
        print("--min-sequence can't be greater than --max-sequence", file=sys.stderr)
        return 2
    try:
        chosen = settings(a.config) if a.command == "export-otel" and a.config else None
    except (OSError, ValueError) as e:
        print(f"{a.config}: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "import-otel":
        spans, found = otlp.import_files(spark, a.files)
        pipeline = redaction.Pipeline(fields=redaction.IMPORT_RULES)
        snapshots.write_snapshots(*otlp.snapshot(spans, found, pipeline.column), a.output)
        return int(show(found, out) > 0)
    c = Corpus(spark, a.folder)
    if a.command == "validate":
        d = procedures.checkpointed(c.validate(a.schemas, a.contents))  # asked twice below
        show(d, out)
        return int(bool(d.where("severity = 'error'").head(1)))
    if a.command == "inspect":
        show(c.inspect(), out)
    elif a.command == "graph":
        only = {"actor": a.actor, "type": a.type, "status": a.status, "min_sequence": a.min_sequence, "max_sequence": a.max_sequence}
        if a.format == "json" or a.json:
            for d in c.graph(a.kind, fold=a.fold, **only):
                show(d, out)
            return 0
        print("flowchart TD", file=out)
        for r in c.mermaid(a.kind, fold=a.fold, **only).orderBy("run_id", "part", "a", "b").toLocalIterator():
            print(r.line, file=out)
    elif a.command == "replay" and a.output:
        ended = c.replay_runs(a.output)
        show(ended, out)
        return int(bool(ended.where("size(codes) > 0").head(1)))
    elif a.command == "replay":
        done, bad = c.replay()
        show(done, out)
        return int(show(bad, out) > 0)
    else:
        if a.config:
            return delivered(c, chosen, a.resume, out)
        show(queue.dry_run(queue.requests(exported(c))), out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
