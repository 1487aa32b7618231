"""Nearest neighbours by inner product: multi-index hashing of learned rotated binary codes, floats reranked.

Vectors become codes of BITS bits, cut into substrings of PIECE bits. Two codes within a radius agree in one substring up to
radius // substrings bits, so probing all values that near finds every code within the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

BITS, PIECE = 64, 16
PIECES = BITS // PIECE
EVERY, NEAREST = 20, 20
#: Vectors on which the rotation and the radii are fitted, at most (those of smallest hash); all vectors are indexed.
FIT_ROWS = 16_384
ROUNDS = 40
#: Bits in which substrings may differ in the first search, which only sets each query's radius.
FIRST = 3
#: Standard deviations that a radius leaves for the distance of the last neighbour's code.
MARGIN = 1.3
#: Postings of a block, about; queries stream past it.
BLOCK = 32_768


# --- codes -----------------------------------------------------------------------------------


class Coder:
    """Principal axes, then a rotation by iterative quantisation; vectors are lifted to one length first, so that angles order inner products."""

    def __init__(self, sample: np.ndarray, longest: float, rounds: int = ROUNDS, seed: int = 7):
        self.longest = longest
        x = self._lifted(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
        x, rng, turns = x @ axes, np.random.default_rng(seed), []
        while sum(t.shape[1] for t in turns) < BITS:
            turn = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            turns.append(turn)
        self.turn = axes @ np.concatenate(turns, axis=1)[:, :BITS]
        self.radius = self._fitted(sample)

    def _lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        bits = (self._lifted(x, query) - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def _fitted(self, sample: np.ndarray) -> tuple[float, float, float] | None:
        """Line and spread of code distances over the angle of score, on the nearest hundredth of pairs of the sample."""
        n = len(sample)
        if n < 200:
            return None
        asked = sample[:512]
        scores = asked @ sample.T
        np.fill_diagonal(scores, -np.inf)
        near = np.argpartition(-scores, max(20, n // 100), axis=1)[:, : max(20, n // 100)]
        apart = np.bitwise_count(self.codes(asked, True)[:, None] ^ self.codes(sample)[near]).astype(float)
        angles = np.arccos(np.clip(np.take_along_axis(scores, near, 1) / (np.linalg.norm(asked, axis=1)[:, None] * self.longest), -1, 1))
        slope, base = np.polyfit(angles.ravel(), apart.ravel(), 1)
        return float(base), float(slope), float((apart - base - slope * angles).std())

    def radii(self, length: np.ndarray, last: np.ndarray, margin: float) -> np.ndarray:
        """The radius that holds the last neighbour found, as a rule; all codes where there's none (nan) or nothing is fitted."""
        if self.radius is None:
            return np.full(len(last), BITS)
        base, slope, spread = self.radius
        angle = np.arccos(np.clip(last / (length * self.longest), -1, 1))
        return np.where(np.isnan(last), BITS, np.clip(np.ceil(base + slope * angle + margin * spread), 0, BITS)).astype(int)


def pieces(codes: np.ndarray) -> np.ndarray:
    """A row of substrings for each code."""
    return np.stack([(codes >> np.uint64(PIECE * j)).astype(np.uint64) & np.uint64((1 << PIECE) - 1) for j in range(PIECES)], axis=1).astype(np.int64)


def reach(radius: int) -> list[int]:
    """Bits in which each substring may differ so that no code within the radius is missed: those after the remainder need one less."""
    whole, left = divmod(radius, PIECES)
    return [whole if j <= left else whole - 1 for j in range(PIECES)]


# --- rows ------------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, h of the rows with a vector that is neither null, zero nor empty and whose components are finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.select("vec_id", "embedding").where("vec_id IS NOT NULL").where(F.coalesce(fine, F.lit(False))).withColumn("h", F.xxhash64("embedding"))


def kinds(rows: DataFrame, nearest: int) -> DataFrame:
    """One row for each distinct vector: v, h, embedding and the ids of its first rows, one more than are asked for: later ones can't be among the nearest."""
    rank = F.row_number().over(W.partitionBy("h", "embedding").orderBy("vec_id"))
    first = rows.withColumn("place", rank).where(F.col("place") <= nearest + 1)
    return checkpoint(first.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("v", F.monotonically_increasing_id()))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Blocks:
    """Where postings lie: by substring, the first bits of its value, and a part where many vectors share these."""

    def __init__(self, bits: int, counts: dict[tuple[int, int], int], block: int):
        self.bits = bits
        self.parts = {k: -(-n // block) for k, n in counts.items()}
        self.heads = [np.array(sorted(h for j, h in self.parts if j == i), np.int64) for i in range(PIECES)]

    def near(self, j: int, value: int, within: int) -> Iterator[tuple[int, int, int]]:
        heads = self.heads[j]
        for h in heads[np.bitwise_count(heads ^ (value >> (PIECE - self.bits))) <= within].tolist():
            for part in range(self.parts[j, h]):
                yield j, h, part


PLACE = "j int, head int, part int, asked boolean"
ROW = f"{PLACE}, n long, code long, radius int, vector binary"


def _batch(places: list, asked: bool, n, codes, radii, vectors) -> pa.RecordBatch:
    j, head, part = (pa.array([p[i] for p in places], pa.int32()) for i in range(3))
    return pa.RecordBatch.from_arrays(
        [j, head, part, pa.array([asked] * len(places)), pa.array(n, pa.int64()), pa.array(np.asarray(codes, np.uint64).view(np.int64)), pa.array(radii, pa.int32()), pa.array(vectors, pa.binary())],
        names=["j", "head", "part", "asked", "n", "code", "radius", "vector"],
    )


def postings(vectors: DataFrame, coder: Coder, blocks: Blocks) -> DataFrame:
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, v = matrix(b.column("embedding")), b.column("v").to_numpy()
                codes = coder.codes(x)
                values, raw = pieces(codes), [r.tobytes() for r in x]
                for j in range(PIECES):
                    heads = (values[:, j] >> (PIECE - blocks.bits)).tolist()
                    places = [(j, h, k % blocks.parts[j, h]) for h, k in zip(heads, v.tolist(), strict=True)]
                    yield _batch(places, False, v, codes, [0] * len(v), raw)

    return vectors.select("v", "embedding").mapInArrow(made, ROW)


def probes(queries: DataFrame, coder: Coder, blocks: Blocks) -> DataFrame:
    """(q, embedding, radius) -> a row for each block that the query has to look into; a null radius stands for the first search."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, q, radii = matrix(b.column("embedding")), b.column("q").to_pylist(), b.column("radius").to_pylist()
            codes = coder.codes(x, True)
            values = pieces(codes).tolist()
            places, of = [], []
            for i, radius in enumerate(radii):
                for j, within in enumerate([FIRST] * PIECES if radius is None else reach(radius)):
                    found = list(blocks.near(j, values[i][j], within)) if within >= 0 else []
                    places += found
                    of += [i] * len(found)
            raw = [r.tobytes() for r in x]
            for at in range(0, len(of), 20_000):
                some = of[at : at + 20_000]
                yield _batch(places[at : at + 20_000], True, [q[i] for i in some], codes[some], [-1 if radii[i] is None else radii[i] for i in some], [raw[i] for i in some])

    return queries.select("q", "embedding", "radius").mapInArrow(made, ROW)


def looked_up(rows: DataFrame, nearest: int) -> DataFrame:
    """Postings and probes of each block -> q, v, score: the block's vectors of largest inner product within the query's radius, each found in its first block only."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, v, codes, x, values = None, [], [], [], None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in ("j", "head", "part")], axis=1)
            asked = b.column("asked").to_numpy(zero_copy_only=False).astype(np.int64)
            key = np.concatenate([place, asked[:, None]], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist() if len(key) else []
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
                here = tuple(place[lo])
                if here != at:
                    at, v, codes, x, values = here, [], [], [], None
                part = b.slice(lo, hi - lo)
                some = np.frombuffer(b"".join(part.column("vector").to_pylist())).reshape(hi - lo, -1)
                if not asked[lo]:
                    v.append(part.column("n").to_numpy())
                    codes.append(part.column("code").to_numpy().view(np.uint64))
                    x.append(some)
                    continue
                if not v:
                    continue
                if values is None:
                    v, codes, x = [np.concatenate(v)], [np.concatenate(codes)], [np.concatenate(x)]
                    values = pieces(codes[0]).T.astype(np.uint16).copy()
                out = [[], [], []]
                for q, code, radius, y in zip(part.column("n").to_pylist(), part.column("code").to_numpy().view(np.uint64), part.column("radius").to_pylist(), some, strict=True):
                    within, j = [FIRST] * PIECES if radius < 0 else reach(radius), int(at[0])
                    mine = pieces(np.array([code], np.uint64))[0].astype(np.uint16)
                    hit = np.flatnonzero(np.bitwise_count(values[j] ^ mine[j]) <= within[j])
                    if radius >= 0:
                        hit = hit[np.bitwise_count(codes[0][hit] ^ code) <= radius]
                    for i in range(j):
                        hit = hit[np.bitwise_count(values[i][hit] ^ mine[i]).astype(int) > within[i]]
                    score = (x[0][hit] * y).sum(axis=1)
                    if len(hit) > nearest + 1:
                        edge = -np.partition(-score, nearest)[nearest]
                        keep = np.flatnonzero(score >= edge)
                        hit, score = hit[keep], score[keep]
                    out[0].append(np.full(len(hit), q))
                    out[1].append(v[0][hit])
                    out[2].append(score)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["q", "v", "score"])

    dealt = rows.repartition("j", "head", "part").sortWithinPartitions("j", "head", "part", "asked")
    return dealt.mapInArrow(found, "q long, v long, score double")


# --- search ----------------------------------------------------------------------------------


def best(found: DataFrame, vectors: DataFrame, nearest: int) -> DataFrame:
    """(q, v, score) -> q, and the rows nearest to it as an array of (score, vec_id), one more than asked for, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first"))
    some = found.join(vectors.select("v", F.col("ids")[0].alias("first"), "ids"), "v").withColumn("place", rank).where(F.col("place") <= nearest + 1)
    rows = some.select("q", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    rows = rows.withColumn("place", rank).where(F.col("place") <= nearest + 1)
    return rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("list"))


def searched(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST, margin: float = MARGIN, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for usable rows of one length: each query's nearest among all rows but its own, by inner product in double precision.

    A first search looks at codes that nearly agree with the query's in a substring; the last neighbour it finds sets the radius within which
    the second search finds every code. A query that finds too few at first has all codes within its radius.
    """
    vectors = kinds(rows, nearest)
    asked = checkpoint(queries.groupBy("h", "embedding").agg(F.count("*").alias("n")).drop("n").withColumn("q", F.monotonically_increasing_id()))
    sample = vectors.select("embedding").orderBy(F.xxhash64("h"), "h").limit(fit_rows).toArrow().column("embedding")
    square = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, longest = vectors.agg(F.count("*"), F.max(square(F.col("embedding")))).first()
    coder = Coder(matrix(sample.combine_chunks()), float(longest))

    bits = min(PIECE, max(0, int(np.ceil(np.log2(max(1, n / block))))))

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = pieces(coder.codes(matrix(b.column("embedding")))) >> (PIECE - bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(PIECES), len(h))), pa.array(h.ravel())], names=["j", "head"])

    # at most 4 x 65,536 counts, whatever the input
    counts = {(r.j, r.head): r["count"] for r in vectors.select("embedding").mapInArrow(heads, "j long, head long").groupBy("j", "head").count().collect()}
    blocks = Blocks(bits, counts, block)
    index = postings(vectors, coder, blocks)

    first = best(looked_up(index.unionByName(probes(asked.withColumn("radius", F.lit(None).cast("int")), coder, blocks)), nearest), vectors, nearest)
    last = asked.join(first.select("q", F.get("list", F.lit(nearest))["score"].alias("last")), "q", "left")

    def radii(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                r = coder.radii(np.linalg.norm(x, axis=1), b.column("last").to_numpy(zero_copy_only=False).astype(float), margin)
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("embedding"), pa.array(r, pa.int32())], names=["q", "embedding", "radius"])

    kind = asked.schema["embedding"].dataType.simpleString()
    known = checkpoint(last.select("q", "embedding", "last").mapInArrow(radii, f"q long, embedding {kind}, radius int"))
    lists = best(looked_up(index.unionByName(probes(known, coder, blocks)), nearest), vectors, nearest)
    lists = lists.join(asked, "q").select(F.col("h").alias("of"), F.col("embedding").alias("vector"), "list")
    out = queries.join(lists, (F.col("h") == F.col("of")) & (F.col("embedding") == F.col("vector")))
    others = F.slice(F.filter("list", lambda r: r["vec_id"] != F.col("vec_id")), 1, nearest)
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "of")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("of.vec_id").alias("vec_id"), F.col("of.score").alias("score"))


def nearest(embeddings: DataFrame, every: int = EVERY, count: int = NEAREST, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the `count` rows of largest inner product found.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without an id, take no part. Vectors of different
    lengths are compared with their like only; lengths are expected to be few. Rows that repeat are candidates of their own, but a query never
    finds a row of its own id. Equal vectors are indexed once, with their first ids. Empty tables give no rows.
    """
    rows = usable(embeddings)
    out = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]
    for size in sorted(sizes):
        some = rows.where(F.size("embedding") == size)
        out = out.unionByName(searched(some, some.where(F.col("vec_id") % every == 0), count, **settings))
    return out
