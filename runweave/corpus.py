"""Snapshot folders as one object: read once, then inspect, validate, project, compile, replay, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import ancestors, export, folders, live, plans, procedures, recorder, recovery, redaction, replay, rerun, schema, workflow
from .sources import paths, snapshots

KINDS = {"causal-dag": "dag_edges", "call-tree": "tree_edges", "timeline": "timeline_edges"}
#: Fixed value: largest files of events and artifacts that are read.
MAX_BYTES = 64 * 1024 * 1024


@dataclass
class Corpus:
    """All runs below a folder; every method runs over all of them at once."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.events = snapshots.read_events(self.spark, self.folder)
        self.manifests = snapshots.read_manifests(self.spark, self.folder)

    def flat(self) -> DataFrame:
        """Events with one row a parent, in the columns of the declarative operators."""
        e = self.events.where("event_id IS NOT NULL AND sequence IS NOT NULL")
        return e.select("run_id", "pos", "event_id", F.explode_outer("parent_ids").alias("parent_id"), "sequence", "type", "timestamp", F.col("monotonic_offset_ms").alias("offset_ms"), "actor", F.lit(0.0).alias("value"), F.col("sequence").alias("n"))

    def single(self) -> DataFrame:
        return self.flat().dropDuplicates(["run_id", "event_id", "pos"])

    def find(self, actor: str | None = None, type: str | None = None, min_sequence: int | None = None, max_sequence: int | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
        """Bounds of sequence are inclusive; those of time are exclusive and compared as text."""
        e = self.events
        for c in (
            None if actor is None else F.col("actor") == actor,
            None if type is None else F.col("type") == type,
            None if min_sequence is None else F.col("sequence") >= min_sequence,
            None if max_sequence is None else F.col("sequence") <= max_sequence,
            None if after is None else F.col("timestamp") > after,
            None if before is None else F.col("timestamp") < before,
        ):
            e = e if c is None else e.where(c)
        return e

    def inspect(self) -> DataFrame:
        return plans.run("inspect_summary", self.spark, te=self.single())

    def errors(self) -> DataFrame:
        """run_id, event_id, type, sequence, code, retryable, kind of failed events."""
        return recorder.event_errors(self.events)

    def metadata(self) -> DataFrame:
        """folder, schema_version, snapshot_type, run_id, run_state, runtime_name of snapshots of any version."""
        return recorder.metadata(snapshots.read_metadata(self.spark, self.folder)).drop("value")

    def tails(self) -> DataFrame:
        return snapshots.tails(self.spark, self.folder)

    def graph(self, kind: str = "causal-dag", actor: str | None = None, type: str | None = None, status: str | None = None, min_sequence: int | None = None, max_sequence: int | None = None, fold: bool = True) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges). The filters choose nodes: by their one actor (`multiple` where there are several), a type among their events, their status, and ranges that overlap the bounds; edges stand between nodes that stay. Without fold, each event is a node. Nodes come by sequence, edges by the ids of their ends in the order of the Unicode collation."""
        quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        only = [
            None if actor is None else f"actor = {quoted(actor)}",
            None if type is None else f"array_contains(types, {quoted(type)})",
            None if status is None else f"status = {quoted(status)}",
            None if min_sequence is None else f"last_sequence >= {int(min_sequence)}",
            None if max_sequence is None else f"first_sequence <= {int(max_sequence)}",
        ]
        shown = " AND ".join(c for c in only if c) or "true"
        te = self.flat() if kind != "timeline" else self.single()
        nodes = plans.run("graph_nodes", self.spark, fold=fold, shown=shown, te=self.single())
        edges = plans.run(KINDS[kind], self.spark, fold=fold, shown=shown, te=te)
        return nodes.orderBy("run_id", "first_sequence"), edges.orderBy("run_id", *(F.collate(c, "UNICODE") for c in ("from_id", "to_id")))

    def mermaid(self, kind: str = "causal-dag", **only) -> DataFrame:
        """run_id, part (1: nodes, 2: edges), a, b (numbers of nodes, in order of their first events), line of the graph's flow chart."""
        nodes, edges = self.graph(kind, **only)
        own = plans.run("node_members", self.spark, fold=only.get("fold", True), te=self.single())
        ids = own.groupBy("run_id", "node_id").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "event_id"))), lambda x: x.event_id), ", ").alias("ids"))
        n = nodes.join(ids, ["run_id", "node_id"]).withColumn("i", F.row_number().over(W.partitionBy("run_id").orderBy("first")))
        label = F.concat("label", F.lit(" ["), "ids", F.lit("]"))
        for raw, mark in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\r", " "), ("\n", " ")):
            label = F.replace(label, F.lit(raw), F.lit(mark))
        first = n.select("run_id", F.lit(1).alias("part"), F.col("i").alias("a"), F.lit(0).alias("b"), F.format_string('  node_%d["%s"]', "i", label).alias("line"))
        number = lambda c, to: n.select("run_id", F.col("node_id").alias(c), F.col("i").alias(to))
        e = edges.join(number("from_id", "a"), ["run_id", "from_id"]).join(number("to_id", "b"), ["run_id", "to_id"])
        word = "timeline" if kind == "timeline" else "causal"
        return first.unionByName(e.select("run_id", F.lit(2).alias("part"), "a", "b", F.format_string(f"  node_%d -->|{word}| node_%d", "a", "b").alias("line")))

    def validate(self, schemas: bool = False, contents: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
        """run (folder or run id), code, severity, at (line or position), path (pointer or file) of every rule that a snapshot breaks.

        schemas: documents are held against their JSON schemas too (ids must then have the format's own shape); contents: artifacts are read and
        their digests compared.
        """
        lines = snapshots.line_diagnostics(self.spark, self.folder).select(F.col("folder").alias("run"), "code", F.lit("error").alias("severity"), F.col("line").cast("long").alias("at"))
        missing = self.manifests.where("error IS NOT NULL").select(F.col("folder").alias("run"), F.col("error").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("long").alias("at"))
        out = lines.unionByName(missing)
        frames = {"tf": self.flat(), "te": self.single(), "mf": self.manifests.where("error IS NULL")}
        for name in ("val_duplicate_ids", "val_sequence"):
            out = out.unionByName(plans.run(name, self.spark, tf=self.single()).selectExpr("run_id AS run", "code", "severity", "cast(pos AS bigint) AS at"))
        for name in ("val_parent_missing", "val_parent_not_earlier", "val_unknown_types", "val_manifest_counts", "val_orphan_roots", "val_completeness"):
            needs = plans.PLANS[name][0]
            out = out.unionByName(plans.run(name, self.spark, **{k: frames[k] for k in needs}).selectExpr("run_id AS run", "code", "severity", "cast(pos AS bigint) AS at"))
        out = out.unionByName(self._cycles()).withColumn("path", F.lit(None).cast("string"))
        for rows in (self._mismatches(), self._file_faults(max_bytes), self._artifact_faults(contents, max_bytes)):
            out = out.unionByName(rows)
        if schemas:
            out = out.unionByName(schema.diagnostics(self.documents()).select(F.col("folder").alias("run"), "code", F.lit("error").alias("severity"), "at", "path"))
        return out.distinct()

    def documents(self) -> DataFrame:
        return snapshots.read_documents(self.spark, self.folder)

    def _cycles(self) -> DataFrame:
        """EVENT_CYCLE for each event on a cycle or after one."""
        e = self.flat()
        where = e.groupBy("run_id", "event_id").agg(F.min("pos").cast("long").alias("at"))
        held = procedures.cyclic_events(e)
        return held.join(where, ["run_id", "event_id"]).select(F.col("run_id").alias("run"), F.lit("EVENT_CYCLE").alias("code"), F.lit("error").alias("severity"), "at")

    def _mismatches(self) -> DataFrame:
        """Ids and versions of events and checkpoints that differ from their manifest's, and checkpoints of unknown events."""
        get = lambda k: F.expr(f"try_variant_get(try_parse_json(raw), '$.{k}', 'string')").alias(k)
        record = F.ltrim("raw").startswith("{")
        d = self.documents().where(record & (F.col("part") != "manifest")).select("folder", "part", "prefix", "at", get("run_id"), get("schema_version"), get("last_event_id"))
        m = self.manifests.where("error IS NULL").select("folder", F.col("run_id").alias("own_run"), F.col("schema_version").alias("own_version"), F.lit(True).alias("managed"))
        d = d.join(m, "folder", "left")
        saved = F.col("part") == "checkpoints"
        other_run = F.col("managed") & ~F.col("run_id").eqNullSafe(F.col("own_run")) & (~saved | F.col("run_id").isNotNull())
        other_version = F.when(saved, F.col("managed") & F.col("schema_version").isNotNull()).otherwise(F.col("own_version").isNotNull()) & ~F.col("schema_version").eqNullSafe(F.col("own_version"))
        known = self.events.select("folder", F.col("event_id").alias("last_event_id")).distinct().withColumn("known", F.lit(True))
        d = d.join(known, ["folder", "last_event_id"], "left")
        lost = saved & F.col("last_event_id").isNotNull() & F.col("known").isNull()
        codes = F.array(
            F.when(other_run, F.struct(F.when(saved, "CHECKPOINT_RUN_ID_MISMATCH").otherwise("RUN_ID_MISMATCH").alias("code"), F.lit("/run_id").alias("field"))),
            F.when(other_version, F.struct(F.lit("SCHEMA_VERSION_MISMATCH").alias("code"), F.lit("/schema_version").alias("field"))),
            F.when(lost, F.struct(F.lit("MISSING_CHECKPOINT_EVENT").alias("code"), F.lit("/last_event_id").alias("field"))),
        )
        found = d.select("folder", "prefix", "at", F.explode(F.array_compact(codes)).alias("x"))
        return found.select(F.col("folder").alias("run"), "x.code", F.lit("error").alias("severity"), "at", F.concat("prefix", "x.field").alias("path"))

    def _file_faults(self, max_bytes: int) -> DataFrame:
        """Files that are absent, too large, or (in folders of a file system) must not be read."""
        f = self.manifests.select("folder", F.lit(True).alias("managed")).join(snapshots.event_files(self.spark, self.folder), "folder", "full")
        codes = F.array(F.when(F.col("byte_length").isNull(), "MISSING_EVENTS_FILE"), F.when(F.col("managed").isNull(), "MISSING_MANIFEST"), F.when(F.col("byte_length") > max_bytes, "EVENT_FILE_TOO_LARGE"))
        named = f.select("folder", F.explode(F.array_compact(codes)).alias("code"), F.lit(None).cast("string").alias("path"))
        local = f.where(F.col("folder").startswith("file:")).select("folder").repartition("folder")
        barred = local.select("folder", F.explode(paths.barred("folder")).alias("x")).select("folder", "x.code", "x.path")
        return named.unionByName(barred).select(F.col("folder").alias("run"), "code", F.lit("error").alias("severity"), F.lit(None).cast("long").alias("at"), "path")

    def artifacts(self, verify: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
        """folder, digest, exists, byte_length (declared; null unless all references agree), actual_byte_length, media_types, previews, n_references, and valid with verify."""
        refs = schema.references(self.documents()).groupBy("folder", "digest").agg(
            F.when(F.countDistinct("byte_length") == 1, F.first("byte_length")).alias("byte_length"), F.sort_array(F.collect_set("media_type")).alias("media_types"), F.sort_array(F.collect_set("preview")).alias("previews"), F.count("*").alias("n_references")
        )
        files = snapshots.read_artifacts(self.spark, self.folder, verify, max_bytes).withColumnRenamed("byte_length", "actual_byte_length").drop("path")
        both = refs.join(files, ["folder", "digest"], "full")
        none = F.array().cast("array<string>")
        return both.select("folder", "digest", F.col("actual_byte_length").isNotNull().alias("exists"), "byte_length", "actual_byte_length", F.coalesce("media_types", none).alias("media_types"), F.coalesce("previews", none).alias("previews"), F.coalesce("n_references", F.lit(0)).alias("n_references"), *(["valid"] if verify else []))

    def _artifact_faults(self, contents: bool, max_bytes: int) -> DataFrame:
        refs = schema.references(self.documents())
        files = snapshots.read_artifacts(self.spark, self.folder, contents, max_bytes).withColumnRenamed("byte_length", "actual")
        met = refs.join(files.select("folder", "digest", "actual"), ["folder", "digest"], "left")
        code = F.when(F.col("actual").isNull(), "MISSING_ARTIFACT").when(F.col("actual") != F.col("byte_length"), "ARTIFACT_SIZE_MISMATCH")
        out = met.select(F.col("folder").alias("run"), code.alias("code"), F.lit("error").alias("severity"), "at", "path")
        own = F.when(F.col("actual") > max_bytes, "ARTIFACT_TOO_LARGE")
        own = own.when(~F.col("valid"), "ARTIFACT_DIGEST_MISMATCH") if contents else own
        out = out.unionByName(files.select(F.col("folder").alias("run"), own.alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("long").alias("at"), F.concat(F.lit("/artifacts/"), "digest").alias("path")))
        return out.where("code IS NOT NULL")

    def state(self) -> DataFrame:
        """run_id, base_sequence, state_json, state_hash, error. Changes and checkpoints whose content is an artifact are read from the run's artifacts, no others."""
        e = self.events.select("folder", "run_id", "event_id", "pos", "sequence", "type", F.to_json("payload").alias("payload"))
        saved = snapshots.read_checkpoints(self.spark, self.folder).where("error IS NULL").withColumn("folder", F.regexp_extract("path", "^(.*)/checkpoints/[^/]+$", 1))
        digests = [e.where("type = 'state.changed'").select("folder", recovery.referenced(F.col("payload")).alias("digest")), saved.select("folder", recovery.referenced(F.col("state_json")).alias("digest"))]
        wanted = procedures.settled(digests[0].unionByName(digests[1]).where("digest IS NOT NULL").distinct())
        contents = None if wanted.isEmpty() else procedures.settled(snapshots.read_referenced(self.spark, self.folder, wanted))
        return recovery.reconstructed(recovery.state_changes(e, contents), recovery.with_states(saved, contents))

    def calls(self) -> DataFrame:
        """Events in the columns of replay.schedule and replay.recorded."""
        get = lambda k: F.expr(f"try_variant_get(payload, '$.{k}', 'string')")
        body = F.to_json(F.coalesce(*[F.expr(f"try_variant_get(payload, '$.{k}')") for k in ("input", "arguments", "output", "result", "error")]))
        return self.events.select("run_id", "event_id", "sequence", "type", get("correlation_key").alias("correlation_key"), F.coalesce(get("model"), get("tool")).alias("target"), body.alias("input"))

    def parents(self) -> DataFrame:
        return self.events.select("run_id", "event_id", F.posexplode("parent_ids").alias("ordinal", "parent_id"))

    def replay(self) -> tuple[DataFrame, DataFrame]:
        return replay.mock(self.calls(), self.parents())

    def _barred(self) -> DataFrame:
        """run_id, code of the runs that may not be replayed."""
        # faults of files stand under their folder
        own = self.manifests.select(F.col("folder").alias("run"), F.col("run_id").alias("named"))
        wrong = self.validate().where("severity = 'error'").join(own, "run", "left").select(F.coalesce("named", "run").alias("run_id"), F.lit("SOURCE_TRACE_INVALID").alias("code"))
        seen = plans.run("eligibility", self.spark, mf=self.manifests.where("error IS NULL")).where("NOT executable").select("run_id", F.lit("SOURCE_TRACE_OBSERVATION_ONLY").alias("code"))
        return wrong.unionByName(seen).distinct()

    def replay_runs(self, output: str | None = None) -> DataFrame:
        """run_id, replay_id, codes (empty: ended in the source's state), state_hash of a mock replay of each run; with output, the replays are written there as snapshots."""
        saved = snapshots.read_checkpoints(self.spark, self.folder).where("error IS NULL")
        made, manifests, results = rerun.runs_of(self.events.where("event_id IS NOT NULL AND sequence IS NOT NULL"), self.calls(), self.parents(), self.state(), saved, self._barred())
        if output is not None:
            snapshots.write_snapshots(made, manifests, output)
        return results

    def verify(self, registry: live.Registry, checkpoints: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(calls, differences, diagnostics) of live.verify; invalid runs and runs that may only be observed make no call.

        checkpoints: run_id, checkpoint_id to resume from.
        """
        point = None if checkpoints is None else live.resume_points(checkpoints, snapshots.read_checkpoints(self.spark, self.folder).where("error IS NULL"), self.events)
        return live.verify(self.calls(), self.parents(), registry, resume=point, barred=self._barred(), **options)

    def compile(self) -> DataFrame:
        """workflow_id, doc."""
        calls = self.calls()
        s = replay.schedule(calls)
        done = replay.recorded(calls, self.parents())[0].where("outcome = 'completed'").select("run_id", "kind", "correlation_key").distinct().withColumn("ok", F.lit(True))
        g = s.groupBy("run_id", "kind", "correlation_key").agg(F.min("sequence").alias("first"), F.count("*").alias("max_attempts"), F.min_by("target", "sequence").alias("target")).join(done, ["run_id", "kind", "correlation_key"], "left")
        number = F.row_number().over(W.partitionBy("run_id").orderBy("first"))
        nodes = g.select("run_id", F.concat(F.lit("node_"), "kind", F.lit("_"), number.cast("string")).alias("node_id"), "correlation_key", "max_attempts", "target", F.when(F.col("ok"), "stop").otherwise("continue").alias("on_failure"))
        return workflow.compiled(nodes, ancestors.dependencies(self.events, workflow.calls_of(calls, nodes)))

    def export(self, policy: str = "metadata-only", redact=None) -> tuple[DataFrame, DataFrame]:
        """(spans, losses) of all runs: imported runs keep the ids of their source."""
        get = lambda k: F.expr(f"try_variant_get(payload, '$.{k}', 'string')")
        e = self.events.select("run_id", "event_id", "sequence", "type", "timestamp", "parent_ids", get("correlation_key").alias("correlation_key"), F.coalesce(get("model"), get("tool")).alias("target"), F.to_json("payload").alias("payload"))
        m = self.manifests
        absent = {"terminal_status": "string", "source": "string", "completeness": "string", "limitations": "array<string>"}
        m = m.select("run_id", *[(F.col("limitations.code") if c == "limitations" and m.schema[c].dataType.typeName() == "array" else F.col(c)).cast(t).alias(c) if c in m.columns else F.lit(None).cast(t).alias(c) for c, t in absent.items()])
        foreign = m.where("source = 'otel-import'").select("run_id")
        spans, _, losses = export.native(e.join(foreign, "run_id", "left_anti"), m, policy, redact)
        again, lost = export.imported(e.join(foreign, "run_id", "left_semi"), policy, redact)
        return spans.unionByName(again), losses.unionByName(lost)

    def migrate(self, output: str) -> int:
        """Writes the snapshots, brought to the current version, into another folder, and returns their number; nothing is written where one has no way forward."""
        return folders.migrate(self.spark, self.folder, output)

    def redact(self, pipeline: redaction.Pipeline) -> DataFrame:
        """run_id, event_id, json, entries, error of each event's payload, by the event's type."""
        e = self.events.select("run_id", "event_id", pipeline.events(F.col("type"), F.to_json("payload")).alias("r"))
        return e.select("run_id", "event_id", "r.*")

    def redact_checkpoints(self, pipeline: redaction.Pipeline) -> DataFrame:
        return pipeline.checkpoints(snapshots.read_checkpoints(self.spark, self.folder).where("error IS NULL").drop("error"))

    def redact_artifacts(self, pipeline: redaction.Pipeline, max_bytes: int = MAX_BYTES) -> DataFrame:
        """folder, old_digest, digest, byte_length, media_type, content, preview, entries, error of each artifact that is there and not above max_bytes, once for each type and preview it is referred to with."""
        refs = schema.references(self.documents()).select("folder", F.col("digest").alias("old_digest"), "media_type", "preview").distinct()
        return pipeline.artifacts(snapshots.read_contents(self.spark, self.folder, max_bytes).join(refs, ["folder", "old_digest"]))
