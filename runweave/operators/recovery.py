"""State from checkpoints and events, and migration of snapshots between schema versions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import adapters
from . import folding, schema
from .procedures import settled
from .redaction import canonical

CURRENT = "0.2.0"
#: Each version with a way forward, and the next one.
STEPS = {"0.0.0": "0.1.0", "0.1.0": "0.2.0"}


# --- checkpoints -----------------------------------------------------------------------------


def judged_checkpoints(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Adds `code` to checkpoints (run_id, checkpoint_id, sequence, last_event_id, state_json, state_hash): why one can't be a base, null for those that can.

    The folder's run may be given as `owner`; else the own run is taken.
    """
    c = checkpoints if "owner" in checkpoints.columns else checkpoints.withColumn("owner", F.col("run_id"))
    e = events.groupBy(F.col("run_id").alias("owner"), "sequence").agg(F.first("event_id").alias("there"))
    j = c.join(e, ["owner", "sequence"], "left")
    code = (
        F.when(~F.col("run_id").eqNullSafe(F.col("owner")), "CHECKPOINT_RUN_ID_MISMATCH")
        .when(~F.col("there").eqNullSafe(F.col("last_event_id")), "CHECKPOINT_EVENT_MISMATCH")
        .when(scalar.canonical_json(F.col("state_json")).isNull(), "CHECKPOINT_STATE_UNAVAILABLE")
        .when(~scalar.state_hash(F.col("state_json")).eqNullSafe(F.col("state_hash")), "CHECKPOINT_STATE_HASH_MISMATCH")
    )
    return j.withColumn("code", code).drop("there")


def bases(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, base_sequence, base_state of the latest valid checkpoint of each run."""
    good = judged_checkpoints(checkpoints, events).where("code IS NULL")
    return good.groupBy("run_id").agg(F.max_by(F.struct(F.col("sequence").alias("base_sequence"), F.col("state_json").alias("base_state")), "sequence").alias("b")).select("run_id", "b.*")


def reconstructed(changes: DataFrame, checkpoints: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """run_id, base_sequence (0: none), state_json, state_hash, error: each run from its latest valid checkpoint on.

    changes: every event of the runs as run_id, event_id, pos, sequence, path (null: no change), operation, value_json. Sequences must be 1..n in
    file order. Only events after the base reach the fold.
    """
    base = bases(checkpoints, changes if events is None else events)
    c = changes.join(base.select("run_id", "base_sequence"), "run_id", "left")
    # events up to the base stay in, without their changes, as sequences count from the run's start
    c = c.withColumn("path", F.when(F.col("sequence") > F.coalesce("base_sequence", F.lit(0)), F.col("path")))
    out = folding.fold(c, settled, base, text=canonical).join(base.select("run_id", "base_sequence"), "run_id", "left")
    kept = lambda c: F.when(~F.col("broken"), F.col(c))
    out = out.select("run_id", F.coalesce(kept("base_sequence"), F.lit(0)).cast("long").alias("base_sequence"), kept("state_json").alias("state_json"), F.when(F.col("broken"), "EVENT_SEQUENCE_INVALID").otherwise(F.col("error")).alias("error"))
    return out.withColumn("state_hash", F.sha2("state_json", 256))


# --- state in artifacts ----------------------------------------------------------------------


def referenced(doc: F.Column) -> F.Column:
    """The digest, if a JSON text is a reference to an artifact; else null."""
    v = F.try_parse_json(doc)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    digest = F.try_variant_get(v, "$.digest", "string")
    fits = F.try_variant_get(v, "$.schema_version", "string").isin(*schema.VERSIONS) & (kind("digest") == "STRING") & digest.rlike("^[a-f0-9]{64}$") & (kind("media_type") == "STRING") & kind("byte_length").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(F.coalesce(fits, F.lit(False)), digest)


def spliced(rows: DataFrame, doc: str, contents: DataFrame | None) -> DataFrame:
    """rows (folder, ...) with references in the column doc replaced by what they refer to, and `lost` where that isn't there.

    contents: folder, digest, content (text) of artifacts that have that digest. Content that is a reference itself isn't followed.
    """
    r = rows.withColumn("_digest", referenced(F.col(doc)))
    if contents is None:
        return r.withColumn("lost", F.col("_digest").isNotNull()).drop("_digest")
    there = contents.select("folder", F.col("digest").alias("_digest"), F.col("content").alias("_content"))
    r = r.join(there, ["folder", "_digest"], "left")
    new = F.when(F.col("_digest").isNull(), F.col(doc)).otherwise(F.col("_content"))
    return r.withColumns({"lost": F.col("_digest").isNotNull() & F.col("_content").isNull(), doc: new}).drop("_digest", "_content")


def state_changes(events: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """The changes of events (run_id, event_id, pos, sequence, type, folder, payload: JSON), for `reconstructed`: payloads that are artifacts are looked up in contents.

    A payload that isn't there can't be taken by any state (STATE_VALUE_INVALID), nor one without path and operation (STATE_EVENT_INVALID).
    """
    changed = F.col("type") == "state.changed"
    e = spliced(events.withColumn("payload", F.when(changed, F.col("payload"))), "payload", contents)
    v = F.try_parse_json("payload")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    good = F.coalesce((kind("path") == "STRING") & (kind("operation") == "STRING"), F.lit(False))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    # no state takes a merge with what isn't an object, nor a path without a name
    return e.select(
        "run_id", "event_id", "pos", "sequence",
        F.when(changed, F.when(F.col("lost"), "/-").when(good, get("path")).otherwise("")).alias("path"),
        F.when(changed, F.when(F.col("lost"), "merge").otherwise(get("operation"))).alias("operation"),
        F.when(changed, F.when(F.col("lost"), "null").otherwise(F.to_json(F.try_variant_get(v, "$.value", "variant")))).alias("value_json"),
    )


def with_states(checkpoints: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Checkpoints (folder, state_json, ...) whose states that are artifacts are looked up; those that aren't there, or aren't objects, are null, so they can't be a base."""
    c = spliced(checkpoints.withColumn("_own", F.col("state_json")), "state_json", contents)
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("state_json")).startswith("OBJECT"), F.lit(False))
    return c.withColumn("state_json", F.when((~F.col("lost") & whole), F.col("state_json"))).drop("lost", "_own")


# --- migration -------------------------------------------------------------------------------


def path_of(version: str | None) -> list[str]:
    out = []
    while version in STEPS:
        version = STEPS[version]
        out.append(version)
    return out


def compatibility(version) -> F.Column:
    return F.when(version == CURRENT, "executable").when(version.isin(*STEPS), "migratable").otherwise("view_only")


def rewritten(value, before: str, after: str):
    """Every schema_version equal to `before`, at any depth, becomes `after`."""
    if isinstance(value, list):
        return [rewritten(v, before, after) for v in value]
    if isinstance(value, dict):
        return {k: after if k == "schema_version" and v == before else rewritten(v, before, after) for k, v in value.items()}
    return value


def migrated(documents: DataFrame, kind: str = "manifest") -> DataFrame:
    """(version, doc JSON, ...) with doc brought to the current version, and `steps`; documents without a way forward have null doc and an error.

    A manifest gets what observation needs: source, completeness, limitations.
    """

    @F.pandas_udf("string")
    def run(doc: pd.Series, version: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(doc, version, strict=True):
            d = json.loads(t)
            at = v
            for nxt in path_of(v):
                d, at = rewritten(d, at, nxt), nxt
            if kind == "manifest" and v != CURRENT:
                cut = d.get("run_state") == "incomplete"
                d |= {"source": "native", "completeness": "partial" if cut else "complete", "limitations": [{"code": "recording_failed", "message": "The snapshot was recorded as incomplete."}] if cut else []}
            out.append(canonical(d))
        return pd.Series(out, dtype=object)

    ok = F.col("version").isin(CURRENT, *STEPS) & F.try_parse_json("doc").isNotNull()
    steps = F.when(F.col("version") == "0.0.0", 2).when(F.col("version") == "0.1.0", 1).otherwise(0)
    good = documents.where(ok).withColumn("doc", run("doc", "version")).withColumns({"steps": steps, "error": F.lit(None).cast("string")})
    bad = documents.where(~F.coalesce(ok, F.lit(False))).withColumns({"doc": F.lit(None).cast("string"), "steps": F.lit(0), "error": F.lit("UNSUPPORTED_SCHEMA_VERSION")})
    return good.unionByName(bad)


# --- queries ---------------------------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sets of two keys a run, and checkpoints at every fifth event: some with a wrong hash, some of another event."""
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    key = F.concat(F.lit("k"), (F.col("n") % 2).cast("string"))
    ch = te.select("run_id", "event_id", "pos", "sequence", "n", F.concat(F.lit("/"), key).alias("path"), F.lit("set").alias("operation"), F.col("sequence").cast("string").alias("value_json"))
    seen = W.partitionBy("run_id").orderBy("sequence")
    last = [F.max(F.when(F.col("n") % 2 == k, F.col("sequence"))).over(seen).alias(f"k{k}") for k in (0, 1)]
    ck = ch.select("run_id", "event_id", "sequence", "n", *last).where("sequence % 5 = 0").withColumn("state_json", F.to_json(F.struct("k0", "k1")))
    ck = ck.select("run_id", F.concat(F.lit("cp_"), F.col("n")).alias("checkpoint_id"), "sequence", F.when(F.col("n") % 13 == 5, "evt_gone").otherwise(F.col("event_id")).alias("last_event_id"), "state_json", F.when(F.col("n") % 17 == 4, "0" * 64).otherwise(F.sha2("state_json", 256)).alias("state_hash"))
    return ch, ck


def state_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstructed(*_changes(spark, sf_dir)).select("run_id", "base_sequence", "state_json", "error")


def state_in_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose every third change is an artifact, some of which are lost."""
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    doc = F.format_string('{"operation":"set","path":"/k%d","value":%d}', F.col("n") % 5, "sequence")
    stored = te.where("n % 3 = 0 AND n % 37 <> 5").select(F.col("run_id").alias("folder"), F.sha2(doc, 256).alias("digest"), doc.alias("content")).distinct()
    ref = F.to_json(F.struct(F.lit("0.2.0").alias("schema_version"), F.sha2(doc, 256).alias("digest"), F.lit("application/json").alias("media_type"), F.octet_length(doc).alias("byte_length")))
    e = te.select("run_id", "event_id", "pos", "sequence", F.lit("state.changed").alias("type"), F.col("run_id").alias("folder"), F.when(F.col("n") % 3 == 0, ref).otherwise(doc).alias("payload"))
    return folding.fold(state_changes(e, stored), settled).select("run_id", "state_json", "error")


def checkpoint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch, ck = _changes(spark, sf_dir)
    return judged_checkpoints(ck, ch).where("code IS NOT NULL").select("run_id", "checkpoint_id", "code")


def migrated_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    mf = adapters.views(spark, sf_dir, ("mf",))["mf"]
    d = mf.select("run_id", F.col("schema_version").alias("version"), F.to_json(F.struct("schema_version", "run_id", F.struct("schema_version").alias("inner"))).alias("doc"))
    m = migrated(d)
    return m.select("run_id", F.get_json_object("doc", "$.schema_version").alias("version"), F.get_json_object("doc", "$.inner.schema_version").alias("inner_version"), F.get_json_object("doc", "$.completeness").alias("completeness"), F.col("steps").cast("long").alias("steps"))


QUERIES = {f.__name__: f for f in (state_reconstruction, state_in_artifacts, checkpoint_faults, migrated_manifests)}
ORACLES = {
    # a fold of sets from any valid base is the last write of each key; the base is the latest checkpoint without a fault
    "state_reconstruction": adapters.duck(
        """SELECT t.run_id, coalesce(max(b), 0) AS base_sequence, concat('{', concat_ws(',', '"k0":' || cast(max(CASE WHEN n % 2 = 0 THEN sequence END) AS varchar), '"k1":' || cast(max(CASE WHEN n % 2 = 1 THEN sequence END) AS varchar)), '}') AS state_json, cast(NULL AS varchar) AS error
FROM te t LEFT JOIN (SELECT run_id, max(sequence) AS b FROM te WHERE sequence % 5 = 0 AND n % 13 <> 5 AND n % 17 <> 4 GROUP BY run_id) c ON c.run_id = t.run_id GROUP BY t.run_id""",
        ("te",),
    ),
    "state_in_artifacts": adapters.duck(
        """WITH k AS (SELECT run_id, n % 5 AS k, max(sequence) AS s FROM te GROUP BY ALL), bad AS (SELECT DISTINCT run_id FROM te WHERE n % 3 = 0 AND n % 37 = 5)
SELECT run_id, if(run_id IN (SELECT run_id FROM bad), NULL, '{' || string_agg('"k' || k || '":' || s, ',' ORDER BY k) || '}') AS state_json, if(run_id IN (SELECT run_id FROM bad), 'STATE_VALUE_INVALID', NULL) AS error FROM k GROUP BY run_id""",
        ("te",),
    ),
    "checkpoint_faults": adapters.duck("SELECT run_id, concat('cp_', cast(n AS varchar)) AS checkpoint_id, CASE WHEN n % 13 = 5 THEN 'CHECKPOINT_EVENT_MISMATCH' ELSE 'CHECKPOINT_STATE_HASH_MISMATCH' END AS code FROM te WHERE sequence % 5 = 0 AND (n % 13 = 5 OR n % 17 = 4)", ("te",)),
    "migrated_manifests": adapters.duck("SELECT run_id, '0.2.0' AS version, '0.2.0' AS inner_version, CASE WHEN schema_version <> '0.2.0' THEN 'complete' END AS completeness, cast(CASE schema_version WHEN '0.0.0' THEN 2 WHEN '0.1.0' THEN 1 ELSE 0 END AS bigint) AS steps FROM mf", ("mf",)),
}
