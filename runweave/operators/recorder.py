"""Runs as they are recorded: which appends a run takes, its envelopes, manifest, checkpoints, artifacts and limitations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import adapters
from . import forests
from .procedures import peeled, settled
from .recovery import CURRENT

#: Types that end a run, and the status that a manifest then has.
TERMINAL = {"run.completed": "completed", "run.failed": "failed", "run.observed": "unknown"}
#: Columns that an interceptor leaves alone.
IDENTITY = ("schema_version", "run_id", "event_id", "parent_ids", "sequence", "type", "timestamp", "monotonic_offset_ms", "actor")
CHECKPOINT_IDENTITY = ("schema_version", "checkpoint_id", "run_id", "created_at", "last_event_id", "sequence")
#: Fixed value: the limitation of a run that hasn't ended.
UNFINISHED = ("recording_failed", "Run has not reached a terminal state.")
LIMITATIONS = "array<struct<code:string,message:string>>"
#: Fixed value: what separates words (the white space of the format's own language).
SPACE = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


# --- appends ---------------------------------------------------------------------------------


def judged(events: DataFrame) -> DataFrame:
    """Adds `code` to appends (run_id, pos, event_id, type, parent_ids), in order of pos: why the run doesn't take one, null where it does.

    A run is there from its first run.started on, up to the first terminal event that it takes. Parents and ids are looked for among the appends
    that it took: one that is refused takes its children with it, leaves its id free and doesn't end the run. No run is gathered: what
    refusals take with them is found by doubling (forests.held_up), and only repeated ids need further rounds.
    """
    starts = events.where("type = 'run.started'").groupBy("run_id").agg(F.min("pos").alias("_start"))
    e = settled(events.join(starts, "run_id", "left"))
    later = F.col("pos") > F.col("_start")
    bare = F.coalesce(F.size("parent_ids"), F.lit(0)) <= 0
    inside = e.where(((F.col("pos") == F.col("_start")) & (F.col("type") == "run.started")) | later & (F.col("type") != "run.started") & ~bare)
    refused = _refused(inside.select("run_id", "pos", "event_id", F.when(later, F.col("parent_ids")).alias("parent_ids")))
    e = e.join(refused.withColumn("_lost", F.lit(True)), ["run_id", "pos"], "left")
    e = e.withColumn("_in", F.col("_lost").isNull() & F.coalesce(F.when(F.col("type") == "run.started", F.col("pos") == F.col("_start")).otherwise(later & ~bare), F.lit(False)))
    taken = e.where("_in").groupBy("run_id", "event_id").agg(F.min("pos").alias("_first"))
    e = e.join(taken, ["run_id", "event_id"], "left")
    ends = e.where(F.col("_in") & F.col("type").isin(*TERMINAL) & (F.col("_first") == F.col("pos"))).groupBy("run_id").agg(F.min("pos").alias("_end"))
    e = e.join(ends, "run_id", "left")
    code = (
        F.when(F.col("_start").isNull() | (F.col("pos") < F.col("_start")), "RUN_NOT_FOUND")
        .when(later & (F.col("type") == "run.started"), "DUPLICATE_RUN_ID")
        .when(F.col("pos") > F.col("_end"), "INVALID_LIFECYCLE_TRANSITION")
        .when(later & bare, "MISSING_PARENT_CONTEXT")
        .when(F.col("_lost"), "MISSING_PARENT_EVENT")
        .when(F.col("_first") < F.col("pos"), "DUPLICATE_EVENT_ID")
    )
    return e.withColumn("code", code).drop("_start", "_end", "_first", "_lost", "_in")


def _refused(appends: DataFrame) -> DataFrame:
    """run_id, pos of appends one of whose parents isn't an earlier append that is taken; repeated ids aside.

    An append is refused with a parent if that parent's id has no other append before it that may be taken. Where it has, the append waits for
    a round in which all but one of these are refused; each round's refusals are final.
    """
    wants = appends.select("run_id", "pos", F.explode("parent_ids").alias("event_id")).distinct()
    refused = appends.select("run_id", "pos").where("false")
    while True:
        alive = appends.select("run_id", "pos", "event_id").join(refused, ["run_id", "pos"], "left_anti")
        first = alive.groupBy("run_id", "event_id").agg(F.min("pos").alias("first"))
        second = alive.join(first, ["run_id", "event_id"]).where("pos > first").groupBy("run_id", "event_id").agg(F.min("pos").alias("second"))
        known = settled(first.join(second, ["run_id", "event_id"], "left"))
        links = wants.join(refused, ["run_id", "pos"], "left_anti").join(known, ["run_id", "event_id"], "left")
        there = F.coalesce(F.col("first") < F.col("pos"), F.lit(False))
        only = F.coalesce(F.col("second") >= F.col("pos"), F.lit(True))
        # one without a parent hangs on itself, and so do all that hang on it
        up = F.when(~there, F.col("pos")).when(only, F.col("first"))
        edges = links.select("run_id", F.col("pos").cast("string").alias("event_id"), up.cast("string").alias("parent_id")).where("parent_id IS NOT NULL")
        # only runs with such a one are looked into
        bad = edges.where("event_id = parent_id").select("run_id").distinct()
        found = settled(forests.held_up(edges.join(bad, "run_id", "left_semi"), peeled, settled).select("run_id", F.col("event_id").cast("long").alias("pos")))
        if found.isEmpty():
            return refused
        refused = settled(refused.unionByName(found))
        if known.where("second IS NOT NULL").isEmpty():
            return refused


def recorded(rows: DataFrame) -> DataFrame:
    """Envelopes of the appends (run_id, pos, event_id, type, timestamp, actor, parent_ids, ...) that their runs take: sequence from 1, time since the start, version.

    A null parent_ids stands for the append before; an empty one is refused as such.
    """
    order = W.partitionBy("run_id").orderBy("pos")
    r = rows.withColumn("parent_ids", F.coalesce("parent_ids", F.array_compact(F.array(F.lag("event_id").over(order)))))
    # the first event of a run has no parent, whatever was refused before it
    first = F.col("type") == "run.started"
    r = judged(r.withColumn("parent_ids", F.when(first, F.array().cast("array<string>")).otherwise(F.col("parent_ids")))).where("code IS NULL").drop("code")
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    begun = F.first(at).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.withColumns({"sequence": F.row_number().over(order).cast("long"), "monotonic_offset_ms": F.greatest(F.lit(0.0), (at - begun) / 1000), "schema_version": F.lit(CURRENT)})


def intercepted(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame], identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Rows after each step in turn, with `code` INTERCEPTOR_IDENTITY_MUTATION where one changed a column of identity; those columns then have their old values.

    A step keeps the columns it doesn't know, so no join is needed to compare.
    """
    keys = [c for c in identity if c in rows.columns]
    out = rows.withColumns({"_was": F.struct(*keys), "code": F.lit(None).cast("string")})
    for step in steps:
        out = step(out)
        if missing := {*keys, "_was", "code"} - {*out.columns}:
            raise ValueError(f"a step dropped {sorted(missing)}")
        same = F.struct(*keys).eqNullSafe(F.col("_was"))
        out = out.withColumn("code", F.when(~same, "INTERCEPTOR_IDENTITY_MUTATION").otherwise(F.col("code"))).withColumns({k: F.col(f"_was.{k}") for k in keys})
    return out.drop("_was")


# --- manifests -------------------------------------------------------------------------------


def limitations(rows: DataFrame) -> DataFrame:
    """(run_id, pos, code, message) -> run_id, limitations: each pair of code and message once, in order of its first place."""
    once = rows.groupBy("run_id", "code", "message").agg(F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "code", "message")))
    return once.groupBy("run_id").agg(F.transform(listed, lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"))).alias("limitations"))


def manifests(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The manifest of each run, from the events (run_id, pos, event_id, type, sequence, timestamp) that it took.

    runs: run_id, source, completeness, limitations (as of `limitations`) of those that aren't native and complete. A run without a terminal
    event is partial and says so.
    """
    ended = F.col("type").isin(*TERMINAL)
    m = events.groupBy("run_id").agg(
        F.min_by("timestamp", "pos").alias("created_at"),
        F.max_by("timestamp", "pos").alias("updated_at"),
        F.max_by(F.when(ended, F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv])[F.col("type")]), "pos").alias("terminal_status"),
        F.max_by("sequence", "pos").alias("last_sequence"),
        F.count("*").alias("event_count"),
        F.min_by("event_id", "pos").alias("root_event_id"),
    )
    known = {"source": (F.lit("native"), "string"), "completeness": (F.lit("complete"), "string"), "limitations": (F.array().cast(LIMITATIONS), LIMITATIONS)}
    if runs is not None:
        m = m.join(runs.select("run_id", *[c for c in known if c in runs.columns]), "run_id", "left")
    m = m.withColumns({c: F.coalesce(F.col(c).cast(t), default) if c in m.columns else default for c, (default, t) in known.items()})
    going = F.col("terminal_status").isNull()
    note = F.array(F.struct(F.lit(UNFINISHED[0]).alias("code"), F.lit(UNFINISHED[1]).alias("message")))
    return m.withColumns(
        {
            "schema_version": F.lit(CURRENT),
            "snapshot_type": F.lit("run-snapshot"),
            "run_state": F.when(going, "running").otherwise("finished"),
            "completeness": F.when(going, "partial").otherwise(F.col("completeness")),
            "limitations": F.when(going, F.concat("limitations", note)).otherwise(F.col("limitations")),
            "completed_at": F.when(~going, F.col("updated_at")),
        }
    )


def metadata(documents: DataFrame, doc: str = "value") -> DataFrame:
    """Adds schema_version, snapshot_type, run_id, run_state and runtime_name of manifests of any version: only texts, and nothing of the payload."""
    field = lambda path: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(try_parse_json({doc}), '$.{path}')) = 'STRING' THEN try_variant_get(try_parse_json({doc}), '$.{path}', 'string') END")
    return documents.withColumns({"schema_version": field("schema_version"), "snapshot_type": field("snapshot_type"), "run_id": field("run_id"), "run_state": field("run_state"), "runtime_name": field("runtime.name")})


# --- checkpoints and artifacts ---------------------------------------------------------------


def saved_checkpoints(new: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """Adds `code` to checkpoints (run_id, sequence, pos, value): null for those to be written, UNCHANGED where the same text is saved already, else CHECKPOINT_SEQUENCE_COLLISION.

    there: run_id, sequence, value of the saved ones. Of several new ones for one sequence, the first (by pos, then value) is written and the others are held against it.
    """
    first = new.groupBy("run_id", "sequence").agg(F.min(F.struct("pos", "value")).alias("_first"))
    out = new.join(first, ["run_id", "sequence"])
    saved = F.lit(None).cast("string")
    if there is not None:
        out = out.join(there.select("run_id", "sequence", F.col("value").alias("_saved")), ["run_id", "sequence"], "left")
        saved = F.col("_saved")
    leads = saved.isNull() & (F.col("pos") == F.col("_first.pos")) & F.col("value").eqNullSafe(F.col("_first.value"))
    code = F.when(leads, F.lit(None).cast("string")).when(F.col("value") == F.coalesce(saved, F.col("_first.value")), "UNCHANGED").otherwise("CHECKPOINT_SEQUENCE_COLLISION")
    return out.withColumn("code", code).drop("_first", "_saved")


def put(contents: DataFrame, there: DataFrame | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(references, files): a reference for each of (content, media_type, preview, ...), with code INVALID_MEDIA_TYPE where there is no type; and digest, content of those to be written, each once.

    there: digest of the artifacts that are stored. by: columns, such as the run, within which artifacts are one store. Only digests are compared and joined; a content crosses the shuffle once for each distinct digest and input task.
    """
    typed = F.coalesce(F.col("media_type") != "", F.lit(False)) & F.col("content").isNotNull()
    code = F.when(F.col("content").isNull(), "INVALID_ARTIFACT_CONTENT").when(~typed, "INVALID_MEDIA_TYPE")
    digest = F.sha2(F.col("content").cast("binary"), 256)
    refs = contents.withColumns({"code": code, "schema_version": F.lit(CURRENT), "digest": F.when(typed, digest), "byte_length": F.when(typed, F.octet_length("content").cast("long"))})
    files = contents.where(typed).select(*by, digest.alias("digest"), F.col("content").cast("binary").alias("content"))
    files = files if there is None else files.join(there.select(*by, "digest"), [*by, "digest"], "left_anti")
    return refs.drop("content"), files.groupBy(*by, "digest").agg(F.first("content").alias("content"))


# --- small projections -----------------------------------------------------------------------


def event_errors(events: DataFrame) -> DataFrame:
    """run_id, event_id, type, sequence, code, retryable, kind of failed events (payload: a variant); UNKNOWN_ERROR where the payload names no code."""
    typed = lambda path, kind, name: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(payload, '$.error.{path}')) = '{kind}' THEN try_variant_get(payload, '$.error.{path}', '{kind}') END").alias(name)
    e = events.where(F.col("type").endswith(".failed")).select("run_id", "event_id", "type", "sequence", typed("code", "STRING", "code"), typed("retryable", "BOOLEAN", "retryable"), typed("kind", "STRING", "kind"))
    return e.withColumn("code", F.coalesce("code", F.lit("UNKNOWN_ERROR")))


def character_count(c: Column) -> Column:
    """UTF-16 units, as the format counts them."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+")).cast("long")


def inferred_schema(c: Column) -> Column:
    """The shallow JSON schema of JSON texts; `true` for what isn't JSON."""
    t = F.schema_of_variant(F.try_parse_json(c))
    of = lambda name: F.lit(f'{{"type":"{name}"}}')
    known = F.when(t == "VOID", of("null")).when(t.startswith("ARRAY"), of("array")).when(t.startswith("OBJECT"), of("object")).when(t == "STRING", of("string")).when(t == "BOOLEAN", of("boolean"))
    return F.when(t.isNull(), F.lit("true")).otherwise(known.otherwise(of("number")))


# --- queries ---------------------------------------------------------------------------------


def appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = adapters.views(spark, sf_dir, ("lc",))["lc"]
    return lc.withColumn("parent_ids", F.array_compact(F.array("parent_id")))


def run_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(appends(spark, sf_dir)).select("run_id", "pos", "event_id", "code")


def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(judged(appends(spark, sf_dir)).where("code IS NULL"))
    return m.select("run_id", "created_at", "updated_at", "completed_at", "run_state", "terminal_status", "completeness", "last_sequence", "event_count", "root_event_id", F.to_json("limitations").alias("limitations"))


def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    kind = F.when(F.col("pos") == 0, "run.started").otherwise(F.col("type"))
    r = recorded(te.select("run_id", "pos", "event_id", kind.alias("type"), "timestamp", "actor", F.lit(None).cast("array<string>").alias("parent_ids")))
    return r.select("run_id", "event_id", "sequence", F.array_join("parent_ids", ",").alias("parent_ids"), F.round("monotonic_offset_ms", 3).alias("offset_ms"))


def checkpoint_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = adapters.views(spark, sf_dir, ("cn", "cs"))
    return saved_checkpoints(made["cn"], made["cs"]).select("run_id", "sequence", "pos", "code")


def artifact_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("media_type"))
    there = adapters.views(spark, sf_dir, ("fl",))["fl"]
    files = put(d, there)[1]
    return files.select("digest", F.octet_length("content").cast("long").alias("byte_length"))


def run_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    return limitations(te.where("error_code IS NOT NULL").select("run_id", "pos", F.col("error_code").alias("code"), F.col("correlation_key").alias("message"))).select("run_id", F.to_json("limitations").alias("limitations"))


def event_error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    error = F.struct(F.col("error_code").alias("code"), F.when(F.col("n") % 2 == 0, F.col("n") % 3 == 0).alias("retryable"), F.col("actor").alias("kind"))
    return event_errors(te.withColumn("payload", F.parse_json(F.to_json(F.struct(error.alias("error"))))))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", character_count(F.col("text")).alias("character_count"), word_count(F.col("text")).alias("word_count"))


def inferred_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", inferred_schema(F.col("props")).alias("schema"), inferred_schema(F.to_json(F.expr("try_variant_get(try_parse_json(props), '$.k')"))).alias("k_schema"))


QUERIES = {f.__name__: f for f in (run_lifecycle, run_manifests, recorded_events, checkpoint_saves, artifact_puts, run_limitations, event_error_details, text_counts, inferred_schemas)}
# each run's appends one by one, with the ids that it has taken
_JUDGED = """WITH RECURSIVE nth AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS k FROM lc),
 walk AS (SELECT DISTINCT run_id, 0::BIGINT AS k, 0::BIGINT AS pos, false AS ended, []::VARCHAR[] AS ids, NULL::VARCHAR AS code FROM lc
 UNION ALL SELECT run_id, k, pos, ended OR code IS NULL AND type IN ('run.completed', 'run.failed', 'run.observed'), if(code IS NULL, list_append(ids, event_id), ids), code FROM (
  SELECT n.run_id, n.k, n.pos, n.type, n.event_id, w.ended, w.ids, CASE WHEN len(w.ids) = 0 AND n.type <> 'run.started' THEN 'RUN_NOT_FOUND' WHEN len(w.ids) > 0 AND n.type = 'run.started' THEN 'DUPLICATE_RUN_ID'
   WHEN w.ended THEN 'INVALID_LIFECYCLE_TRANSITION' WHEN len(w.ids) = 0 THEN NULL WHEN n.parent_id IS NULL THEN 'MISSING_PARENT_CONTEXT' WHEN NOT list_contains(w.ids, n.parent_id) THEN 'MISSING_PARENT_EVENT' WHEN list_contains(w.ids, n.event_id) THEN 'DUPLICATE_EVENT_ID' END AS code
  FROM walk w JOIN nth n ON n.run_id = w.run_id AND n.k = w.k + 1) s)
 SELECT nth.* EXCLUDE (k), walk.code FROM nth JOIN walk ON walk.run_id = nth.run_id AND walk.k = nth.k"""
ORACLES = {
    "run_lifecycle": adapters.duck(f"SELECT run_id, pos, event_id, code FROM ({_JUDGED}) j", ("lc",)),
    "run_manifests": adapters.duck(
        f"""SELECT f.run_id, f.timestamp AS created_at, l.timestamp AS updated_at, CASE WHEN l.type LIKE 'run.%ed' AND l.type <> 'run.started' THEN l.timestamp END AS completed_at,
 CASE l.type WHEN 'run.completed' THEN 'finished' WHEN 'run.failed' THEN 'finished' ELSE 'running' END AS run_state, CASE l.type WHEN 'run.completed' THEN 'completed' WHEN 'run.failed' THEN 'failed' END AS terminal_status,
 CASE WHEN l.type IN ('run.completed', 'run.failed') THEN 'complete' ELSE 'partial' END AS completeness, l.sequence AS last_sequence, f.k + l.b - 1 AS event_count, f.event_id AS root_event_id,
 CASE WHEN l.type IN ('run.completed', 'run.failed') THEN '[]' ELSE '[{{"code":"recording_failed","message":"Run has not reached a terminal state."}}]' END AS limitations
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS k FROM ({_JUDGED}) j WHERE code IS NULL) f
JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS k, count(*) OVER (PARTITION BY run_id) AS b FROM ({_JUDGED}) j WHERE code IS NULL) l ON l.run_id = f.run_id AND l.k = 1 AND f.k = 1""",
        ("lc",),
    ),
    "recorded_events": adapters.duck("SELECT a.run_id, a.event_id, cast(a.n_before AS bigint) + 1 AS sequence, coalesce(b.event_id, '') AS parent_ids, round(a.offset_ms, 3) AS offset_ms FROM (SELECT t.*, pos AS n_before FROM te t) a LEFT JOIN te b ON b.run_id = a.run_id AND b.pos = a.pos - 1", ("te",)),
    "checkpoint_saves": adapters.duck(
        """SELECT c.run_id, c.sequence, c.pos, CASE WHEN s.value IS NOT NULL THEN CASE WHEN s.value = c.value THEN 'UNCHANGED' ELSE 'CHECKPOINT_SEQUENCE_COLLISION' END
 WHEN NOT EXISTS (SELECT 1 FROM cn o WHERE o.run_id = c.run_id AND o.sequence = c.sequence AND o.pos < c.pos) THEN NULL
 WHEN c.value = (SELECT arg_min(o.value, o.pos) FROM cn o WHERE o.run_id = c.run_id AND o.sequence = c.sequence) THEN 'UNCHANGED' ELSE 'CHECKPOINT_SEQUENCE_COLLISION' END AS code
FROM cn c LEFT JOIN cs s ON s.run_id = c.run_id AND s.sequence = c.sequence""",
        ("cn", "cs"),
    ),
    "artifact_puts": adapters.duck("SELECT DISTINCT digest, cast(byte_length AS bigint) AS byte_length FROM ar WHERE digest NOT IN (SELECT digest FROM fl)", ("ar", "fl")),
    "run_limitations": adapters.duck("""SELECT run_id, '[' || string_agg('{"code":"' || error_code || '","message":"' || correlation_key || '"}', ',' ORDER BY pos) || ']' AS limitations FROM te t WHERE error_code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM te o WHERE o.run_id = t.run_id AND o.error_code = t.error_code AND o.correlation_key = t.correlation_key AND o.pos < t.pos) GROUP BY run_id""", ("te",)),
    "event_error_details": adapters.duck("SELECT run_id, event_id, type, sequence, CASE WHEN value < 10 THEN 'E' || (n % 10) ELSE 'UNKNOWN_ERROR' END AS code, CASE WHEN n % 6 IN (2, 4) THEN false WHEN n % 6 = 0 THEN true END AS retryable, actor AS kind FROM te WHERE type = 'tool.failed'", ("te",)),
    "text_counts": """SELECT doc_id, cast(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS bigint) AS character_count,
 cast(len(regexp_extract_all(text, '[^\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+')) AS bigint) AS word_count FROM documents""",
    "inferred_schemas": """SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN '{"type":"object"}' ELSE 'true' END AS schema, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN '{"type":"number"}' WHEN 'BIGINT' THEN '{"type":"number"}' WHEN 'DOUBLE' THEN '{"type":"number"}' WHEN 'VARCHAR' THEN '{"type":"string"}' WHEN 'BOOLEAN' THEN '{"type":"boolean"}' ELSE 'true' END AS k_schema FROM events""",
}
