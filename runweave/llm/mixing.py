"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpoint

SEED = 17
BUCKET_ROWS = 4096
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs) -> the same with weight, target.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Sources are clamped in the
    order of cap over weight; the water level is the first at which no further source is above
    its cap, so one pass over the sorted table reaches the fixed point of redistribution.
    The table has one row per source; windows run over it, never over documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1).cast("double")
    caps = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    caps = (
        caps.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("capped_before")) / F.col("weight_left"))
    )
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    return caps.withColumn("water", level).withColumn(
        "target", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    ).select("source", "source_size", "n_docs", "weight", "target")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size) -> doc_id, size, source_size, target, taken; any further columns stay.

    Every document of a source is repeated floor(target / source_size) times. What is left of
    the target is filled in a seeded random order of the documents; the one at the border takes
    part of its words. A source is dealt into buckets of about BUCKET_ROWS documents, each filled
    to the same share, so a hot source never meets in one task.
    Null text and null source count as size 0 and a source of their own; empty tables give no
    rows; rows that repeat are dealt as separate documents.
    """
    per_source = checkpoint(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), share, max_epochs))
    per_source = per_source.select(F.col("source").alias("mix_source"), "source_size", "n_docs", "target")
    d = sizes.join(per_source, sizes["source"].eqNullSafe(F.col("mix_source")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    number = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    d = d.withColumn("draw", draw).withColumn("bucket", number % F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS)).cast("long"))
    of = W.partitionBy("mix_source", "bucket")
    ends = F.sum("size").over(of.orderBy("draw", "size").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("ends", ends).withColumn("bucket_size", F.sum("size").over(of))
    times = F.col("target") / F.col("source_size")
    whole = F.floor(times).cast("long")
    part = F.round((times - whole) * F.col("bucket_size")).cast("long") - (F.col("ends") - F.col("size"))
    taken = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.col("size") * whole + F.least(F.col("size"), F.greatest(F.lit(0), part)))
    return d.withColumn("taken", taken.cast("long")).drop("mix_source", "n_docs", "draw", "bucket", "ends", "bucket_size")


def repeated(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """Rows of docs, each as often as the mix takes it (a document taken in part counts as whole from half its words on)."""
    columns = docs.columns
    sizes = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    times = F.when(F.col("size") == 0, 0).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    return mix(sizes, share, max_epochs, seed).withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, list_element([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM r),
t AS (SELECT *, (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) AS water FROM l),
g AS (SELECT source, source_size, n_docs, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE water * weight END AS target FROM t),
b AS (SELECT d.*, source_size, target, ('0x' || substr(draw, 1, 8))::BIGINT % ceil(n_docs / {BUCKET_ROWS}.0)::BIGINT AS bucket
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends,
             sum(size) OVER (PARTITION BY source, bucket) AS bucket_size FROM b)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * floor(target / source_size)
         + least(size, greatest(0, round((target / source_size - floor(target / source_size)) * bucket_size) - (ends - size))) END::BIGINT AS taken
FROM e"""
