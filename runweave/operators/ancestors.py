"""The nearest ancestors that belong to something: a call's span, a workflow's node.

The walk doubles its reach each round, so that a run of any depth needs as many rounds as its length has bits and no run is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .procedures import checkpointed, settled


def nearest_owned(edges: DataFrame, owned: DataFrame, starts: DataFrame) -> DataFrame:
    """(run_id, event_id, owner) of the owned events met first on each way up from the starts; a start's own owner counts only if a way meets it.

    edges: run_id, event_id, parent_id; owned: run_id, event_id, owner; starts: run_id, event_id. Missing parents end a way. A way through a
    cycle ends when as many steps were made as the longest run has events, so all ways without repeats are walked.
    """
    key = ["run_id", "event_id"]
    edges = edges.where("parent_id IS NOT NULL").select("run_id", "event_id", "parent_id").distinct()
    mine = owned.select("run_id", F.col("event_id").alias("parent_id"), "owner").distinct()
    from_start = edges.join(starts.select(*key).distinct(), key, "left_semi").withColumn("start", F.lit(True))
    # owned events end every way, so only starts and events that nobody owns are walked from
    inner = edges.join(owned.select(*key).distinct(), key, "left_anti").withColumn("start", F.lit(False))
    up = settled(from_start.unionByName(inner).join(mine, ["run_id", "parent_id"], "left"))
    met = up.where("owner IS NOT NULL").select(*key, "start", "owner").distinct()
    ways = up.where("owner IS NULL").select(*key, "start", F.col("parent_id").alias("at")).distinct()
    if up.where("NOT start").isEmpty():  # then no way goes on behind its first step
        return met.where("start").select(*key, "owner")
    longest = edges.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if ways.isEmpty():
            break
        # the second half of a way starts at an event without owner, so never at a start's own row
        on = lambda d, *c: d.where("NOT start").select("run_id", F.col("event_id").alias("at"), *c)
        further = ways.join(on(met, "owner"), ["run_id", "at"]).select(*key, "start", "owner")
        beyond = ways.join(on(ways, F.col("at").alias("next")), ["run_id", "at"]).select(*key, "start", F.col("next").alias("at"))
        met, ways = checkpointed(met.unionByName(further).distinct()), checkpointed(beyond.distinct())
    return met.where("start").select(*key, "owner").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(run_id, event_id, ancestor_id, depth) of all ancestors, each with the length of the shortest way to it.

    edges: run_id, event_id, parent_id. Ways double in each round, so a run of any depth needs as many rounds as its depth has bits. An event on
    a cycle is its own ancestor.
    """
    key = ["run_id", "event_id", "ancestor_id"]
    found = checkpointed(edges.where("parent_id IS NOT NULL").select("run_id", "event_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")).distinct())
    before = -1
    while (now := found.agg(F.count("*"), F.sum("depth")).first()) != before:
        before = now
        up = found.select("run_id", F.col("event_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("depth").alias("more"))
        longer = found.join(up, ["run_id", "ancestor_id"]).select("run_id", "event_id", F.col("next").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))
        found = checkpointed(found.unionByName(longer).groupBy(*key).agg(F.min("depth").alias("depth")))
    return found


def dependencies(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, node_id, depends_on): the nodes of the calls that stand nearest above a node's requests.

    events: run_id, event_id, parent_ids; nodes: run_id, event_id, node_id, is_request.
    """
    edges = events.select("run_id", "event_id", F.explode("parent_ids").alias("parent_id"))
    near = nearest_owned(edges, nodes.withColumnRenamed("node_id", "owner"), nodes.where("is_request"))
    return near.join(nodes.where("is_request"), ["run_id", "event_id"]).where("owner <> node_id").select("run_id", "node_id", F.col("owner").alias("depends_on")).distinct()
