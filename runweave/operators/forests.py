"""Cycles and orders of parent links in rounds of joins: pointers double their reach, so a chain of n events needs as many rounds as n has bits.

Runs and traces that are small are settled in one group each, all others by rounds; the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events of a run, or spans of a trace, that one group may hold.
SMALL = 20_000


def numbered(rows: DataFrame, kept: Callable, name: str = "v") -> DataFrame:
    """rows with a number each; they don't change after, as the table is kept."""
    return kept(rows.withColumn(name, F.monotonically_increasing_id()))


def sized(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows"))


# --- cycles of single parents ----------------------------------------------------------------


def circling(links: DataFrame, kept: Callable) -> DataFrame:
    """Of links (v, up, label): rows v, up, label that lead into a cycle; `up` is then on the cycle, and label the greatest from v to there and all around it.

    Each round doubles the way; what reaches an end drops out.
    """
    left = kept(links.where("up IS NOT NULL").select("v", "up", "label"))
    reach, most = 1, left.count()
    while reach <= most and not left.isEmpty():
        further = left.select(F.col("v").alias("up"), F.col("up").alias("next"), F.col("label").alias("other"))
        left = kept(left.join(further, "up").select("v", F.col("next").alias("up"), F.greatest("label", "other").alias("label")))
        reach *= 2
    return left


def cut_cycles(spans: DataFrame, kept: Callable) -> DataFrame:
    """Spans (trace_id, span_id, v, up, start_ns) with `detached`: the greatest span id of each cycle, which loses its parent.

    Only traces with a parent that doesn't stand before its child, by (start_ns, span_id), can hold a cycle.
    """
    above = spans.select(F.col("v").alias("up"), F.struct("start_ns", "span_id").alias("at"))
    risen = spans.where("up IS NOT NULL").join(above, "up").where(F.col("at") >= F.struct("start_ns", "span_id")).select("trace_id").distinct()
    left = circling(spans.join(risen, "trace_id", "left_semi").withColumn("label", F.col("span_id")), kept)
    # from a span on a cycle, the label is that of the whole cycle
    on = left.select(F.col("up").alias("v")).distinct().join(left.select("v", "label"), "v")
    cut = on.select("v", F.col("label").alias("span_id"), F.lit(True).alias("detached"))
    out = spans.join(cut, ["v", "span_id"], "left").withColumn("detached", F.coalesce("detached", F.lit(False)))
    return kept(out.withColumn("up", F.when(~F.col("detached"), F.col("up"))))


# --- order of a forest -----------------------------------------------------------------------


def followed(rows: DataFrame, group: list[str], order: list[str], kept: Callable) -> DataFrame:
    """rows (with v) and `next`: the v that follows in its group by order. A group of any size is spread over ranges; only one row a range is looked at together."""
    keys = [*group, *order]
    dealt = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    within = W.partitionBy("range").orderBy("at")
    one = F.struct(*group, "v")
    heads = dealt.groupBy("range").agg(F.min_by(one, "at").alias("head"))
    heads = heads.select("range", F.lead("head").over(W.orderBy("range")).alias("beyond"))
    after = F.coalesce("inside", "beyond")
    same = F.lit(True)
    for g in group:
        same = same & (after[g] == F.col(g))
    out = dealt.withColumn("inside", F.lead(one).over(within)).join(heads, "range")
    return out.withColumn("next", F.when(same, after["v"])).drop("at", "range", "inside", "beyond")


def ranked(elements: DataFrame, kept: Callable, sums: tuple[str, ...]) -> DataFrame:
    """(e, next, sums...) with each sum taken from e to the end of its list."""
    left, done = kept(elements), None
    while True:
        ends = left.where("next IS NULL")
        done = ends if done is None else done.unionByName(ends)
        left = left.where("next IS NOT NULL")
        if left.isEmpty():
            return done
        # what lies behind is either a list's rest, summed up already, or a stretch as long as the own one
        known = done.unionByName(left).select(F.col("e").alias("next"), F.col("next").alias("beyond"), *(F.col(c).alias(f"{c}_there") for c in sums))
        left = kept(left.join(known, "next").select("e", F.col("beyond").alias("next"), *((F.col(c) + F.col(f"{c}_there")).alias(c) for c in sums)))


def in_order(spans: DataFrame, kept: Callable) -> DataFrame:
    """Spans (trace_id, span_id, v, up, start_ns) of forests with sequence (from 2, in pre-order; siblings and roots by start_ns, span_id) and depth.

    The tour around a trace's forest enters each span and leaves it again; what is left of the tour from a span on, counted in doubling steps, gives its place and depth.
    """
    s = followed(spans.withColumn("above", F.coalesce("up", F.lit(-1))), ["trace_id", "above"], ["start_ns", "span_id"], kept)
    first = s.where("up IS NOT NULL").groupBy(F.col("up").alias("v")).agg(F.min(F.struct("start_ns", "span_id", F.col("v").alias("child"))).alias("f")).select("v", F.col("f.child").alias("child"))
    s = kept(s.join(first, "v", "left"))
    enter = s.select((F.col("v") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("v") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("spans"), F.lit(1).cast("long").alias("rise"))
    leave = s.select((F.col("v") * 2 + 1).alias("e"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("spans"), F.lit(-1).cast("long").alias("rise"))
    tour = ranked(enter.unionByName(leave), kept, ("spans", "rise"))
    place = tour.where("e % 2 = 0").select((F.col("e") / 2).cast("long").alias("v"), "spans", (-F.col("rise")).alias("depth"))
    total = sized(spans, "trace_id").withColumnRenamed("rows", "total")
    return s.join(place, "v").join(total, "trace_id").withColumn("sequence", F.col("total") - F.col("spans") + 2)


def forest(spans: DataFrame, small: Callable[[pd.DataFrame], pd.DataFrame], kept: Callable, most: int = SMALL) -> DataFrame:
    """trace_id, span_id, parent (after cuts), sequence (from 2), depth, detached of spans (trace_id, span_id, parent, start_ns).

    small: the same for one trace of at most `most` spans, as a frame. Larger traces are never gathered.
    """
    schema = "trace_id string, span_id string, parent string, sequence long, depth long, detached boolean"
    s = kept(spans.select("trace_id", "span_id", "parent", F.col("start_ns").cast("long").alias("start_ns")))
    large = kept(sized(s, "trace_id").where(F.col("rows") > most).select("trace_id"))
    if large.isEmpty():
        return s.groupBy("trace_id").applyInPandas(small, schema)
    few = s.join(large, "trace_id", "left_anti").groupBy("trace_id").applyInPandas(small, schema)
    big = numbered(s.join(large, "trace_id", "left_semi"), kept)
    above = big.select("trace_id", F.col("span_id").alias("parent"), F.col("v").alias("up"))
    big = cut_cycles(kept(big.join(above, ["trace_id", "parent"], "left")), kept)
    placed = in_order(big, kept)
    return few.unionByName(placed.select("trace_id", "span_id", F.when(~F.col("detached"), F.col("parent")).alias("parent"), F.col("sequence").cast("long").alias("sequence"), F.col("depth").cast("long").alias("depth"), "detached"))


# --- what cycles hold up ---------------------------------------------------------------------


def held_up(edges: DataFrame, small: Callable[[pd.DataFrame], pd.DataFrame], kept: Callable, most: int = SMALL) -> DataFrame:
    """run_id, event_id whose parents never all resolve: events on cycles and all that follow from them.

    edges: run_id, event_id, parent_id, both known events of the run. small: the same for one run of at most `most` edges, as a frame.

    An event of one parent shares that parent's fate, so chains shrink to the event above them that has no parent or several; then events none of
    whose parents is open are resolved. This repeats, on fewer events each time, until nothing resolves: what is left is held up. Rings and chains
    take as many rounds as their length has bits; each level of events with several parents takes a pass, unless the rest of its run is small.
    """
    schema = "run_id string, event_id string"
    e = kept(edges.select("run_id", "event_id", "parent_id").distinct())
    large = kept(sized(e, "run_id").where(F.col("rows") > most).select("run_id"))
    if large.isEmpty():
        return e.groupBy("run_id").applyInPandas(small, schema)
    few = e.join(large, "run_id", "left_anti").groupBy("run_id").applyInPandas(small, schema)
    e = kept(e.join(large, "run_id", "left_semi"))
    names = numbered(e.select("run_id", "event_id").unionByName(e.select("run_id", F.col("parent_id").alias("event_id"))).distinct(), kept)
    number = lambda c, v: names.select("run_id", F.col("event_id").alias(c), F.col("v").alias(v))
    open_ = kept(e.join(number("event_id", "v"), ["run_id", "event_id"]).join(number("parent_id", "up"), ["run_id", "parent_id"]).select("run_id", "v", "up"))
    lost, shared = open_.select("v").where("false"), []
    while True:
        count = open_.groupBy("v").agg(F.count("*").alias("n"))
        tops, rings = _tops(open_.join(count.where("n = 1"), "v").select("v", "up"), kept)
        shared.append(tops)
        lost = lost.unionByName(rings)
        # a parent within a chain stands for what is above the chain
        several = open_.join(count.where("n > 1"), "v").select("run_id", "v", "up")
        moved = kept(several.join(tops.select(F.col("v").alias("up"), "top"), "up", "left").select("run_id", "v", F.coalesce("top", "up").alias("up")).distinct())
        # a parent stays open if it has open parents itself or is lost
        still = moved.select(F.col("v").alias("up")).unionByName(lost.select(F.col("v").alias("up"))).distinct()
        now = kept(moved.join(still, "up", "left_semi").select("run_id", "v", "up"))
        rest = sized(now, "run_id").where(F.col("rows") <= most).select("run_id")
        light = now.join(rest, "run_id", "left_semi")
        # in a group, a lost parent follows from itself
        loops = light.join(lost.select(F.col("v").alias("up")).distinct(), "up", "left_semi").select("run_id", F.col("up").alias("v"), "up").distinct()
        text = lambda d: d.select("run_id", F.col("v").cast("string").alias("event_id"), F.col("up").cast("string").alias("parent_id"))
        settled = text(light.unionByName(loops)).groupBy("run_id").applyInPandas(small, schema)
        lost = kept(lost.unionByName(settled.select(F.col("event_id").cast("long").alias("v"))).distinct())
        now = kept(now.join(rest, "run_id", "left_anti"))
        n = now.count()
        if n == open_.count():
            lost = lost.unionByName(now.select("v"))
        if n in (0, open_.count()):
            break
        open_ = now
    for tops in reversed(shared):
        lost = kept(lost.unionByName(tops.join(lost.select(F.col("v").alias("top")).distinct(), "top", "left_semi").select("v")).distinct())
    return few.unionByName(names.join(lost, "v").select("run_id", "event_id"))


def _tops(chains: DataFrame, kept: Callable) -> tuple[DataFrame, DataFrame]:
    """Links (v, up) of events with one parent each -> (v, top): the event above the chain, which has no link itself; and v of those that circle for ever."""
    left = kept(chains.select("v", F.col("up").alias("top")))
    done, reach, most = left.where("false"), 1, left.count()
    while reach <= 2 * most and not left.isEmpty():
        known = done.unionByName(left).select(F.col("v").alias("top"), F.col("top").alias("next"))
        step = kept(left.join(known, "top", "left").select("v", F.coalesce("next", "top").alias("top"), F.col("next").isNull().alias("ended")))
        done, left, reach = done.unionByName(step.where("ended").select("v", "top")), step.where("NOT ended").select("v", "top"), reach * 2
    return done, left.select("v")
