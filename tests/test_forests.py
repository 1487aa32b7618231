"""Cycles and forests by doubling pointers: drawn graphs against one group a run, long chains and rings, wide stars."""

import random

import pandas as pd
from pyspark.sql import functions as F

from runweave.operators import forests, otlp, procedures
from runweave.operators.procedures import settled


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def residue(edges):
    """Events left when those without open parents go, again and again."""
    left = set(edges)
    while True:
        open_ = {e for e, _ in left}
        now = {(e, p) for e, p in left if p in open_}
        if now == left:
            return open_
        left = now


def test_what_cycles_hold_up_in_drawn_runs(spark):
    """Single and several parents, self loops, rings with tails, ladders; some rests are small enough for groups."""
    rng, most = random.Random(0), 3
    table, want = [], set()
    for r in range(40):
        n = rng.randint(2, 9)
        back = rng.choice([0, 0.03, 0.1])
        edges = set()
        for k in range(n):
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                p = rng.randrange(n) if rng.random() < back else rng.randrange(max(0, k - 4), k) if k else None
                if p is not None:
                    edges.add((f"e{k}", f"e{p}"))
        table += [(f"r{r}", e, p) for e, p in edges]
        want |= {(f"r{r}", e) for e in residue(edges)}
    e = spark.createDataFrame(table, "run_id string, event_id string, parent_id string")
    assert 0 < len(want) < len(table)
    assert rows(forests.held_up(e, procedures.peeled, settled, most), "run_id", "event_id") == sorted(want)


def test_long_chain_ring_and_ladder(spark):
    ids = spark.range(1000)
    chain = ids.where("id > 0").selectExpr("'chain' AS run_id", "concat('e', id) AS event_id", "concat('e', id - 1) AS parent_id")
    ring = ids.where("id < 500").selectExpr("'ring' AS run_id", "concat('e', id) AS event_id", "concat('e', (id + 1) % 500) AS parent_id")
    tail = spark.createDataFrame([("ring", "tail", "e5"), ("ring", "after", "tail"), ("ring", "free", "top")], "run_id string, event_id string, parent_id string")
    ladder = ids.where("id >= 2 AND id < 12").selectExpr("'ladder' AS run_id", "concat('e', id) AS event_id", "explode(array(concat('e', id - 1), concat('e', id - 2))) AS parent_id")
    e = chain.unionByName(ring).unionByName(tail).unionByName(ladder)
    got = forests.held_up(e, procedures.peeled, settled, 8)
    assert got.count() == 502 and got.where("run_id = 'ring' AND event_id IN ('tail', 'after')").count() == 2


def forest(spans):
    by = {}
    for s in spans:
        by.setdefault(s[0], []).append(s)
    frames = [otlp._ordered(pd.DataFrame(v, columns=["trace_id", "span_id", "parent", "start_ns"])) for v in by.values()]
    return sorted(map(tuple, pd.concat(frames).astype(object).where(lambda d: d.notna(), None).to_numpy().tolist()), key=str)


def test_drawn_forests_and_cycles(spark):
    rng = random.Random(8)
    spans = []
    for t in range(40):
        n = rng.randint(1, 40)
        names = [f"{rng.getrandbits(64):016x}" for _ in range(n)]
        for k in range(n):
            parent = None if rng.random() < 0.15 else names[rng.randrange(n)] if rng.random() < 0.2 else names[rng.randrange(max(0, k - 5), k)] if k else None
            spans.append((f"t{t}", names[k], parent if parent != names[k] else None, rng.randrange(12)))
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent string, start_ns long")
    want = forest(spans)
    assert any(w[-1] for w in want)
    names = "trace_id", "span_id", "parent", "sequence", "depth", "detached"
    assert rows(otlp.forest(df, most=12), *names) == want == rows(otlp.forest(df), *names)
    assert otlp.forest(df.where("false"), most=0).count() == 0


def test_large_trace(spark):
    """A chain, a star and a ring of one trace, none of which a group may hold."""
    ids = spark.range(3000)
    name = "lpad(hex({}), 16, '0')"
    chain = ids.selectExpr("'t' AS trace_id", f"{name.format('id')} AS span_id", f"if(id > 0, {name.format('id - 1')}, NULL) AS parent", "id AS start_ns").where("start_ns < 500")
    star = ids.selectExpr("'t' AS trace_id", f"{name.format('id + 100000')} AS span_id", f"{name.format('0')} AS parent", "10000 - id AS start_ns").where("start_ns > 8000")
    ring = ids.where("id < 200").selectExpr("'t' AS trace_id", f"{name.format('id + 200000')} AS span_id", f"{name.format('(id + 1) % 200 + 200000')} AS parent", "id + 20000 AS start_ns")
    got = otlp.forest(chain.unionByName(star).unionByName(ring), most=100).withColumn("n", F.conv("span_id", 16, 10).cast("long")).toPandas().set_index("n")
    assert len(got) == 2700 and sorted(got.sequence) == list(range(2, 2702))
    assert (got.loc[range(500)].sequence == range(2, 502)).all() and (got.loc[range(500)].depth == range(500)).all()
    leaves = got.loc[range(100_000, 102_000)]
    assert (leaves.depth == 1).all() and (leaves.sequence == 2501 - pd.Series(range(2000), leaves.index)).all()
    circle = got.loc[range(200_000, 200_200)]
    assert circle.detached.sum() == 1 and circle.detached[200_199] and circle.depth[200_000] == 199 and circle.sequence[200_000] == 2701
