"""Places of rows within groups of any size: rows are dealt by ranges, numbered there, and shifted by what lies before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(rows: DataFrame, group: list[str], order: list[str], kept: Callable[[DataFrame], DataFrame], name: str = "place") -> DataFrame:
    """rows with their place (from 0) in their group by order. Only one row for each group and range is looked at together; rows alike in order come in any order."""
    keys = [*group, *order]
    dealt = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = ranges.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_in")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return dealt.join(shift, same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_in", "_shift", *[f"_{g}" for g in group])
