"""Snapshot directories: readers of manifests, events, checkpoints and artifacts, and a writer."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files, ranges

EVENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("parent_ids", T.ArrayType(T.StringType())),
        T.StructField("sequence", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("monotonic_offset_ms", T.DoubleType()),
        T.StructField("actor", T.StringType()),
    ]
)
MANIFEST = "schema_version string, run_id string, run_state string, terminal_status string, source string, completeness string, last_sequence long, event_count long, root_event_id string, created_at string, completed_at string, limitations array<struct<code:string,message:string>>"


def _files(spark: SparkSession, folder: str, pattern: str, binary: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of repeated keys of an object, the last counts
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if binary:
        return r.format("binaryFile").load(folder)
    return r.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _run_folder(path: F.Column, below: str) -> F.Column:
    return F.regexp_extract(path, f"^(.*)/{below}$", 1)


def _raw_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """folder, value, ok: of manifest.json.tmp and manifest.json the first that parses."""
    f = _files(spark, folder, "manifest.json*").withColumn("folder", _run_folder(F.col("path"), "manifest\\.json(?:\\.tmp)?"))
    ok = F.try_parse_json("value").isNotNull()
    return f.groupBy("folder").agg(F.min_by("value", F.when(ok, F.when(F.col("path").endswith(".tmp"), 0).otherwise(1))).alias("value"), F.max(ok).alias("ok"))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """folder, value of the manifests that parse, whatever their version."""
    return _raw_manifests(spark, folder).where("ok").select("folder", "value")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run folder: of manifest.json.tmp and manifest.json the first that parses; error MISSING_MANIFEST where neither does."""
    best = _raw_manifests(spark, folder)
    return best.select("folder", F.when(F.col("ok"), F.from_json("value", MANIFEST)).alias("m"), F.when(~F.col("ok"), "MISSING_MANIFEST").alias("error")).select("folder", "m.*", "error", F.coalesce(F.array_size("m.limitations"), F.lit(0)).alias("n_limitations"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """folder, part (manifest, events, checkpoints), prefix (pointer of the document in its snapshot), at (position among its like), raw: every document that parses."""
    manifests = _raw_manifests(spark, folder).where("ok").selectExpr("folder", "'manifest' AS part", "'/manifest' AS prefix", "0L AS at", "value AS raw")
    lines = read_lines(spark, folder).where(F.try_parse_json("raw").isNotNull()).select("folder", F.col("line").cast("long").alias("order"), "raw")
    saved = _checkpoint_files(spark, folder).where(F.try_parse_json("value").isNotNull()).select(_run_folder(F.col("path"), "checkpoints/[^/]+").alias("folder"), F.col("path").alias("order"), F.col("value").alias("raw"))
    out = manifests
    for part, rows in (("events", lines), ("checkpoints", saved)):
        at = (F.row_number().over(W.partitionBy("folder").orderBy("order")) - 1).cast("long")
        rows = rows.select("folder", F.lit(part).alias("part"), at.alias("at"), "raw")
        out = out.unionByName(rows.withColumn("prefix", F.concat(F.lit(f"/{part}/"), F.col("at").cast("string"))))
    return out


def event_files(spark: SparkSession, folder: str) -> DataFrame:
    """folder, byte_length of each file of events; contents aren't read."""
    f = _files(spark, folder, "events.jsonl", binary=True)
    return f.select(_run_folder(F.col("path"), "events\\.jsonl").alias("folder"), F.col("length").alias("byte_length"))


def read_lines(spark: SparkSession, folder: str, name: str = "events.jsonl", size: int = ranges.RANGE) -> DataFrame:
    """folder, line (physical, from 1), raw, last (unterminated last line) of every line that isn't blank. Where a file is above that size, files are read in ranges (see ranges)."""
    if ranges.large(folder, name, size):
        return ranges.read_lines(spark, folder, name, size).select("folder", "line", "raw", "last")
    f = _files(spark, folder, name).withColumn("folder", _run_folder(F.col("path"), name.replace(".", "\\.")))
    parts = F.split("value", "\n")
    lines = f.select("folder", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "raw"))
    return lines.select("folder", (F.col("k") + 1).alias("line"), F.regexp_replace("raw", "\r$", "").alias("raw"), (F.col("k") + 1 == F.col("n")).alias("last")).where("trim(raw) <> ''")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The envelope columns, with pos (order of the parsed lines), line and raw."""
    good = read_lines(spark, folder).where(F.try_parse_json("raw").isNotNull())
    good = good.withColumn("pos", F.row_number().over(W.partitionBy("folder").orderBy("line")) - 1)
    return good.select("folder", "pos", "line", F.from_json("raw", EVENT).alias("e"), F.try_parse_json("raw").alias("v"), "raw").select("folder", "pos", "line", "e.*", F.expr("try_variant_get(v, '$.payload')").alias("payload"), F.expr("try_variant_get(v, '$.security.side_effect', 'string')").alias("side_effect"), "raw")


def line_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """folder, line, code of the lines that don't parse."""
    bad = read_lines(spark, folder).where(F.try_parse_json("raw").isNull())
    return bad.select("folder", "line", F.when(F.col("last"), "PARTIAL_JSONL_TAIL").otherwise("INVALID_JSONL_LINE").alias("code"))


def tails(spark: SparkSession, folder: str) -> DataFrame:
    """folder, run_id, last_sequence (0: none), ends_with_newline, tail_corrupt, bad_lines of each file of events with a line: where a recorder goes on.

    Run and number are those of the last line that parses; a file that doesn't end with a line's end needs one before the next event.
    """
    lines = read_lines(spark, folder).withColumn("v", F.try_parse_json("raw"))
    good, get = F.col("v").isNotNull(), lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')")
    last = F.max_by(F.struct(get("run_id", "string").alias("run_id"), get("sequence", "long").alias("sequence")), F.when(good, F.col("line")))
    t = lines.groupBy("folder").agg(last.alias("l"), (~F.bool_or("last")).alias("ends_with_newline"), F.bool_or(F.col("last") & ~good).alias("tail_corrupt"), F.count_if(~good & ~F.col("last")).alias("bad_lines"))
    return t.select("folder", "l.run_id", F.coalesce("l.sequence", F.lit(0)).cast("long").alias("last_sequence"), "ends_with_newline", "tail_corrupt", "bad_lines")


def _checkpoint_files(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder, "*.json").where(F.col("path").rlike("/checkpoints/[^/]+$"))


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    f = _checkpoint_files(spark, folder)
    v = F.try_parse_json("value")
    get = lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')").alias(k)
    return f.select("path", v.alias("v")).select("path", get("checkpoint_id", "string"), get("run_id", "string"), get("last_event_id", "string"), get("sequence", "long"), get("state_hash", "string"), F.to_json(F.expr("try_variant_get(v, '$.state')")).alias("state_json"), F.when(F.col("v").isNull(), "CHECKPOINT_FILE_INVALID_JSON").alias("error"))


def read_artifacts(spark: SparkSession, folder: str, verify: bool = False, max_bytes: int | None = None) -> DataFrame:
    """folder, path, digest, byte_length, and with verify whether the content has that digest; contents aren't read otherwise, nor those above max_bytes (valid is null)."""
    f = _files(spark, folder, "sha256-*", binary=True)
    named = [_run_folder(F.col("path"), "artifacts/sha256-[^/]*").alias("folder"), F.col("path"), F.regexp_extract("path", "sha256-([^/]*)$", 1).alias("digest"), F.col("length").alias("byte_length")]
    if not verify:
        return f.select(*named)
    small = f if max_bytes is None else f.where(F.col("length") <= max_bytes)
    out = small.select(*named, (F.sha2("content", 256) == F.regexp_extract("path", "sha256-([^/]*)$", 1)).alias("valid"))
    return out if max_bytes is None else out.unionByName(f.where(F.col("length") > max_bytes).select(*named, F.lit(None).cast("boolean").alias("valid")))


def read_contents(spark: SparkSession, folder: str, max_bytes: int) -> DataFrame:
    """folder, old_digest, content of the artifacts that aren't above max_bytes."""
    f = _files(spark, folder, "sha256-*", binary=True).where(F.col("length") <= max_bytes)
    return f.select(_run_folder(F.col("path"), "artifacts/sha256-[^/]*").alias("folder"), F.regexp_extract("path", "sha256-([^/]*)$", 1).alias("old_digest"), "content")


def read_referenced(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """folder, digest, content (text) of the artifacts of (folder, digest) in wanted that are there and have that digest. Only these files are opened, by tasks."""
    paths = read_artifacts(spark, folder).select("folder", "path", "digest").join(wanted.select("folder", "digest").distinct(), ["folder", "digest"], "left_semi")

    def read(batches):
        fs = files.opened(folder)[0]
        for b in batches:
            out = []
            for r in b.to_pylist():
                with fs.open_input_file(files.opened(unquote(r["path"]))[1]) as f:
                    content = f.read()
                if hashlib.sha256(content).hexdigest() == r["digest"]:
                    out.append({"folder": r["folder"], "digest": r["digest"], "content": content.decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("folder", pa.string()), ("digest", pa.string()), ("content", pa.string())]))

    return paths.mapInArrow(read, "folder string, digest string, content string")


def write_events(events: DataFrame, folder: str) -> None:
    """JSON lines, one folder a run, in order of sequence; refuses to overwrite."""
    cols = [c for c in events.columns if c != "run_id"]
    rows = events.withColumn("value", F.to_json(F.struct("run_id", *cols))).select(F.col("run_id").alias("run"), "sequence", "value")
    rows.repartition("run").sortWithinPartitions("run", "sequence").select("run", "value").write.partitionBy("run").mode("errorifexists").text(folder)


def write_snapshots(events: DataFrame, manifests: DataFrame, folder: str) -> int:
    """Run folders from (run_id, sequence, value) and (run_id, value); see files.write_runs."""
    return files.write_runs(events, manifests, folder)


def saved_values(spark: SparkSession, folder: str) -> DataFrame:
    """run_id (the folder's name), sequence, value of the checkpoints below a folder."""
    f = _checkpoint_files(spark, folder)
    return f.select(F.regexp_extract("path", "([^/]+)/checkpoints/[^/]+$", 1).alias("run_id"), F.regexp_extract("path", "([0-9]+)[.]json$", 1).cast("long").alias("sequence"), "value")


def _otlp_items(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, r, rs: the resource items of OTLP/JSON files, whatever they are."""
    v = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    return v.selectExpr("path", "v", "posexplode(try_variant_get(v, '$.resourceSpans', 'array<variant>')) AS (r, rs)").drop("v")


def read_otlp(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spans of OTLP/JSON files in order: path, r, s, k (positions), ids, name, kind, start_ns, end_ns, status_code, has_drops; attributes, events, links, resource, scope and raw (the whole span, keys sorted) as JSON."""
    r = _otlp_items(spark, paths)
    s = r.selectExpr("path", "r", "to_json(try_variant_get(rs, '$.resource')) AS resource", "posexplode(try_variant_get(rs, '$.scopeSpans', 'array<variant>')) AS (s, ss)")
    k = s.selectExpr("path", "r", "s", "resource", "to_json(try_variant_get(ss, '$.scope')) AS scope", "posexplode(try_variant_get(ss, '$.spans', 'array<variant>')) AS (k, span)")
    get = lambda p, t="string": f"try_variant_get(span, '$.{p}', '{t}')"
    part = lambda p: f"to_json(try_variant_get(span, '$.{p}')) AS {p}"
    drops = " OR ".join(f"coalesce({get(f'dropped{c}Count', 'double')}, 0) > 0" for c in ("Attributes", "Events", "Links"))
    return k.selectExpr("path", "r", "s", "k", f"{get('traceId')} AS trace_id", f"{get('spanId')} AS span_id", f"{get('parentSpanId')} AS parent_span_id", f"{get('name')} AS name", f"{get('kind', 'int')} AS kind", f"try_cast({get('startTimeUnixNano')} AS decimal(20,0)) AS start_ns", f"try_cast({get('endTimeUnixNano')} AS decimal(20,0)) AS end_ns", f"coalesce({get('status.code', 'int')}, 0) AS status_code", f"{drops} AS has_drops", part("attributes"), part("events"), part("links"), "resource", "scope", "to_json(span) AS raw")


def otlp_faults(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, at (pointer), code of files, resource items and scope items that aren't objects."""
    is_object = lambda c: f"coalesce(schema_of_variant({c}) LIKE 'OBJECT%', false)"
    v = spark.read.text(paths, wholetext=True).selectExpr("_metadata.file_path AS path", "try_parse_json(value) AS v")
    r = _otlp_items(spark, paths)
    s = r.selectExpr("path", "r", "posexplode(try_variant_get(rs, '$.scopeSpans', 'array<variant>')) AS (s, ss)")
    out = v.where(f"NOT {is_object('v')}").selectExpr("path", "'' AS at", "'INVALID_REQUEST' AS code")
    out = out.unionByName(r.where(f"NOT {is_object('rs')}").selectExpr("path", "concat('/resourceSpans/', r) AS at", "'INVALID_RESOURCE_SPANS' AS code"))
    return out.unionByName(s.where(f"NOT {is_object('ss')}").selectExpr("path", "concat('/resourceSpans/', r, '/scopeSpans/', s) AS at", "'INVALID_SCOPE_SPANS' AS code"))
