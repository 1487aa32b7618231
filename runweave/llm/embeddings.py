"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, partitions

PIVOTS, PREFIX, SHARED = 256, 7, 3
THRESHOLD = 0.9
DRAWN, APART = 4, 0.8
ROWS, MOST_PIVOTS = 10_000, 4096
BLOCK = 512
PLACES = 1 << 13  # above MOST_PIVOTS: a key holds SHARED pivots and the number of a length


def pick_pivots(units: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Up to n reference vectors with cosines below APART between them, from the DRAWN * n distinct unit vectors of the smallest hashes (the index's bounded sample).

    Without the distance, a large group of near copies would hold many of the pivots, whose order is noise to the group's own members.
    """
    rows = [r[0] for r in units.orderBy(F.xxhash64("unit"), "cls").limit(DRAWN * n).select("unit").collect()]
    drawn = np.array(rows, float)
    chosen = np.empty((min(n, len(drawn)), drawn.shape[1]))
    k = 0
    for v in drawn:
        if k == len(chosen):
            break
        if not k or (chosen[:k] @ v).max() < APART:
            chosen[k] = v
            k += 1
    return chosen[:k]


def pivots_for(rows: int) -> int:
    """PIVOTS up to ROWS rows, then with the cube root of the rows, up to MOST_PIVOTS.

    Two unrelated vectors share SHARED = 3 pivots with a chance that falls with the third power of the number of pivots, so candidate
    pairs grow with the rows up to there.
    """
    return min(MOST_PIVOTS, max(PIVOTS, math.ceil(PIVOTS * (rows / ROWS) ** (1 / 3))))


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Numbers of the nearest pivots in order of distance."""
    k = min(prefix, len(pivots))
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


def _described(pivots: dict[int, np.ndarray]):
    """Keys of vectors: the number of their length, then SHARED of their nearest pivots."""

    def run(batches):
        for b in batches:
            size = b.column("unit").value_lengths().to_numpy()
            for number, (length, own) in enumerate(pivots.items()):
                if (size == length).any():
                    yield described(b.filter(pa.array(size == length)), own, number)

    def described(b: pa.RecordBatch, pivots: np.ndarray, number: int) -> pa.RecordBatch:
        x = np.array(b.column("unit").to_pylist(), float)
        near = nearest(x, pivots)
        order = np.sort(near, axis=1)
        sets = np.array(list(combinations(range(order.shape[1]), min(SHARED, order.shape[1]))))
        keys = np.full((len(x), len(sets)), number, np.int64)
        for c in range(sets.shape[1]):
            keys = keys * PLACES + order[:, sets[:, c]]
        keys = keys * PLACES ** (SHARED - sets.shape[1])
        rows = np.repeat(np.arange(len(x)), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column("cls").take(pa.array(rows)), b.column("copies").take(pa.array(rows))], names=["key", "cls", "copies"])

    return run


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (null unless all components are finite and one is not zero)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.when(good, F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).alias("vec"))


SMALL, STEP = 64, 50_000


def _links(u: np.ndarray, begin: np.ndarray, end: np.ndarray, side: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (p, q) of the tiles begin..end whose cosine reaches the threshold. own: the tile is a block with itself; else side 0 meets side 1."""
    found = []
    size = end - begin
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    rows = np.concatenate([np.arange(begin[k], end[k]) for k in few]) if len(few) else np.empty(0, np.int64)
    tile = np.repeat(few, size[few])
    after = end[tile] - rows - 1
    p = np.repeat(rows, after)
    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(after) - after, after)
    meet = own[np.repeat(tile, after)] | (side[p] != side[q])
    p, q = p[meet], q[meet]
    for s in range(0, len(p), STEP):
        x, y = p[s : s + STEP], q[s : s + STEP]
        near = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
        found.append((x[near], y[near]))
    for k in np.flatnonzero(size > SMALL):
        r = np.arange(begin[k], end[k])
        x, y = (r, r) if own[k] else (r[side[r] == 0], r[side[r] == 1])
        i, j = np.nonzero(u[x] @ u[y].T >= threshold)
        if own[k]:
            i, j = i[i < j], j[i < j]
        found.append((x[i], y[j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _shared_first(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The key of the k smallest pivots that stand in both rows of sorted pivots; rows that share fewer have -1."""
    both = (x[:, :, None] == y[:, None, :]).any(axis=2)
    at = np.argsort(~both, axis=1, kind="stable")[:, :k]
    out = np.zeros(len(x), np.int64)
    for c in range(k):
        out = out * PLACES + x[np.arange(len(x)), at[:, c]]
    return np.where(both.sum(axis=1) >= k, out, -1)


def _tiles(t: pa.Table, pivots: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Compares all tiles of a table sorted by tile.

    A pair counts in the first of its shared keys only. What leaves is for each vector
    the copies that it links to, and a spanning forest of the links.
    """
    key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
    side, cls, copies = (t.column(c).to_numpy() for c in ("side", "cls", "copies"))
    u = np.array(t.column("vec").to_pylist(), float)
    u /= np.abs(u).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    begin = np.flatnonzero(new)
    p, q = _links(u, begin, np.r_[begin[1:], len(key)], side, (i == j)[begin], threshold)
    if len(p):
        ends, back = np.unique(np.r_[p, q], return_inverse=True)
        order = np.sort(nearest(u[ends], pivots), axis=1)
        k = min(SHARED, order.shape[1])
        own_key = key % PLACES**SHARED // PLACES ** (SHARED - k)
        mine = np.zeros(len(p), bool)
        for s in range(0, len(p), STEP):
            x, y = order[back[s : min(s + STEP, len(p))]], order[back[len(p) + s : len(p) + min(s + STEP, len(p))]]
            mine[s : s + STEP] = _shared_first(x, y, k) == own_key[p[s : s + STEP]]
        p, q = p[mine], q[mine]
    ids, at = np.unique(cls, return_inverse=True)
    n = np.bincount(at[p], copies[q], len(ids)) + np.bincount(at[q], copies[p], len(ids))
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    ea, eb = [], []
    for s, e in zip(at[p].tolist(), at[q].tolist(), strict=True):
        r, o = find(s), find(e)
        if r != o:
            root[max(r, o)] = min(r, o)
            ea.append(ids[s])
            eb.append(ids[e])
    some = np.flatnonzero(n)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(ids[some], pa.int64()), none(len(ea))]),
            pa.concat_arrays([pa.array(n[some].astype(np.int64)), none(len(ea))]),
            pa.concat_arrays([none(len(some)), pa.array(ea, pa.int64())]),
            pa.concat_arrays([none(len(some)), pa.array(eb, pa.int64())]),
        ],
        names=["cls", "links", "a", "b"],
    )


def _compared(pivots: dict[int, np.ndarray], threshold: float):
    """Whole tiles of a sorted partition, as many at a time as a batch holds; the last tile of a batch waits for the next."""

    numbered = list(pivots.values())

    def each(t: pa.Table):
        """Tables of vectors of one length; the keys bring them together."""
        number = t.column("key").to_numpy() // PLACES**SHARED
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for s, e in zip(edges, edges[1:], strict=False):
            yield _tiles(t.slice(s, e - s), numbered[number[s]], threshold)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = int(last.argmax())
            if cut:
                yield from each(t.slice(0, cut))
            held = t.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from each(held)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, n_pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding.

    Equal vectors are one class from the start. Classes are described by their PREFIX nearest of n_pivots reference vectors (default: pivots_for the classes), and
    retrieved through inverted lists: sharing SHARED pivots is sharing one of the lists of their triples. A list
    is dealt in blocks of BLOCK rows and compared block against block, so no task holds
    a whole hot list. Retrieved pairs are verified by cosine in doubles. Vectors of each length have pivots and lists of their own and
    link with nothing of another length; null, zero and non-finite ones link with nothing. Rows that share an id count as rows of their own.
    """
    spark = vectors.sparkSession
    v = units(vectors)
    v = checkpoint(v.withColumn("code", F.when(F.col("vec").isNotNull(), F.sha2(F.to_json("vec"), 256))))
    classes = v.where("code IS NOT NULL").groupBy("code").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    classes = checkpoint(classes.withColumn("unit", F.transform("vec", lambda x: x / norm)).withColumn("cls", F.col("least")))
    shared = not classes.groupBy("least").count().where("count > 1 OR least IS NULL").isEmpty()
    if shared:  # rows of different vectors share an id, so classes get numbers of their own
        classes = checkpoint(classes.withColumn("cls", F.monotonically_increasing_id()))
    pivots = {}
    for length, rows in sorted(classes.groupBy(F.size("unit")).count().collect()):  # one row for each length
        pivots[length] = pick_pivots(classes.where(F.size("unit") == length), n_pivots or pivots_for(rows))
    if not pivots:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    good = classes
    lists = checkpoint(good.select("unit", F.col("cls").cast("long").alias("cls"), "copies").mapInArrow(_described(pivots), "key long, cls long, copies long"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = lists.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # tile (i, j), i <= j: block i is side 0, block j side 1
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), (k < F.col("block")).cast("int").alias("side")))
    rows = rows.select("key", "cls", F.explode(tiles).alias("t")).select("key", "cls", "t.*")
    rows = rows.join(good.select(F.col("cls").cast("long").alias("cls"), "copies", "vec"), "cls")
    found = checkpoint(rows.select("key", "i", "j", "side", "cls", "copies", "vec").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared(pivots, threshold), "cls long, links long, a long, b long"))
    links = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    if shared:
        smallest = comp.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("low"))
        comp = comp.join(smallest, "component").select("node", "low")
    else:
        comp = comp.withColumnRenamed("component", "low")
    per_class = classes.select("code", "copies", "cls", "least").join(links, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
    per_class = per_class.select(F.col("code").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("low", "least").alias("comp"))
    d = v.join(per_class, v["code"] == per_class["of"], "left")
    component = F.coalesce("comp", F.col("vec_id").cast("long"))
    return d.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id").cast("long")).alias("kept"))
