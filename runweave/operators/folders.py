"""What is written into folders of snapshots: checkpoints, artifacts, and whole folders of another version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import files, snapshots
from . import recorder, recovery
from .procedures import checkpointed


def save_checkpoints(new: DataFrame, folder: str) -> DataFrame:
    """Writes <folder>/<run_id>/checkpoints/<sequence>.json of the checkpoints (run_id, sequence, pos, value) whose number is free; returns run_id, sequence, pos, code of the others (see recorder.saved_checkpoints)."""
    spark = new.sparkSession
    there = snapshots.saved_values(spark, folder) if files.present(*files.opened(folder)) else None
    judged = checkpointed(recorder.saved_checkpoints(new, there))  # what is there is read before the folder changes
    name = F.concat("run_id", F.lit("/checkpoints/"), scalar.file_name(F.col("sequence")))
    files.install(judged.where("code IS NULL").select(name.alias("name"), F.col("value").alias("content")), folder)
    return judged.where("code IS NOT NULL").select("run_id", "sequence", "pos", "code")


def put_artifacts(contents: DataFrame, folder: str) -> DataFrame:
    """Writes <folder>/<run_id>/artifacts/sha256-<digest> of (run_id, content, media_type, ...), each content once a run; files of that name and length stay as they are. Returns the references (see recorder.put)."""
    spark, there = contents.sparkSession, None
    if files.present(*files.opened(folder)):
        f = snapshots.read_artifacts(spark, folder)
        there = checkpointed(f.select(F.regexp_extract("folder", "([^/]+)$", 1).alias("run_id"), "digest", "byte_length"))
    refs, new = recorder.put(contents, there, ("run_id",))
    files.install(new.select(F.concat("run_id", F.lit("/artifacts/sha256-"), "digest").alias("name"), "content"), folder)
    return refs


def migrate(spark: SparkSession, folder: str, output: str) -> int:
    """Copies snapshot folders, brought to the current version, with their checkpoints and artifacts; returns their number.

    Every document takes the steps of its manifest's version. Nothing is written if one has no way forward, or if output is there. Folders keep
    their names, so these must differ. Lines that don't parse make a snapshot unfit too.
    """
    if files.present(*files.opened(output)):
        raise FileExistsError(output)
    name = F.regexp_extract("folder", "([^/]+)$", 1)
    version = F.expr("try_variant_get(try_parse_json(value), '$.schema_version', 'string')")
    versions = snapshots.read_metadata(spark, folder).select("folder", version.alias("version"))
    docs = snapshots.read_documents(spark, folder).withColumnRenamed("raw", "doc").join(versions, "folder", "left").withColumn("run_id", name)
    done = recovery.migrated(docs.where("part = 'manifest'")).unionByName(recovery.migrated(docs.where("part <> 'manifest'"), "other"))
    done = checkpointed(done.select("run_id", "part", "at", "doc", "error"))
    lines = snapshots.line_diagnostics(spark, folder).select(name.alias("run_id"), F.col("code").alias("error"))
    if bad := done.select("run_id", "error").where("error IS NOT NULL").unionByName(lines).head(1):
        raise ValueError(f"snapshot {bad[0].run_id}: {bad[0].error}")
    part = lambda p: done.where(F.col("part") == p)
    n = files.write_runs(part("events").select("run_id", F.col("at").alias("sequence"), F.col("doc").alias("value")), part("manifest").select("run_id", F.col("doc").alias("value")), output)
    number = F.expr("try_variant_get(try_parse_json(doc), '$.sequence', 'long')")
    files.install(part("checkpoints").select(F.concat("run_id", F.lit("/checkpoints/"), scalar.file_name(number)).alias("name"), F.col("doc").alias("content")), output)
    held = snapshots.read_contents(spark, folder, 2**31 - 1)
    files.install(held.select(F.concat(name, F.lit("/artifacts/sha256-"), "old_digest").alias("name"), "content"), output)
    return n
