"""Toxicity: logistic classifier on words and word beginnings, regularised by swapping identity terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 12_000  # labelled rows of each class at most that the classifier is fitted on
MAX_FEATURES = 4096
THRESHOLD = 0.7
EDGE = b".,!;:|#*$%&?\"'()[]<>-_"
#: Groups of identity terms; a term is swapped for the others of its group.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("disabled", "deaf", "blind"),
)
_SWAP = {t.encode(): [u.encode() for u in g if u != t] for g in IDENTITY for t in g}


def features(word: bytes) -> tuple[bytes, ...]:
    """A word without its edge punctuation, and its beginnings of 4 to 6 bytes."""
    w = word.strip(EDGE)
    if not w:
        return ()
    return (w, *(w[:n] + b"~" for n in (4, 5, 6) if len(w) >= n))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").lower().split())


def swapped(ws: set[bytes]) -> set[bytes] | None:
    """The words with each identity term replaced by the next one of its group; None if there is none."""
    own = {w: w.strip(EDGE) for w in ws}
    if not any(v in _SWAP for v in own.values()):
        return None
    return {_SWAP[v][0] if v in _SWAP else w for w, v in own.items()}


def _counted(batches):
    seen: dict = {}
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for f in {f for w in words(text) for f in features(w)}:
                seen.setdefault(f, [0, 0])[y] += 1
        if len(seen) > 300_000:
            yield _counts(seen)
            seen = {}
    if seen:
        yield _counts(seen)


def _counts(seen: dict):
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["feature", "neg", "pos"])


class Lookup(dict):
    """Word -> numbers of its features."""

    def __init__(self, chosen: dict):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes):
        if len(self) > 500_000:
            self.clear()
        out = self[word] = tuple(self.chosen[f] for f in features(word) if f in self.chosen)
        return out

    def of(self, ws: set[bytes]) -> list[int]:
        return sorted({k for w in ws for k in self[w]})


def _encoded(chosen: dict):
    def run(batches):
        look = Lookup(chosen)
        for b in batches:
            ws = [words(t) for t in b.column("text").to_pylist()]
            swaps = [None if (s := swapped(w)) is None else look.of(s) for w in ws]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([look.of(w) for w in ws], pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], names=["toxic", "ids", "swap_ids"])

    return run


def fit(rows: list[list[int]], labels: np.ndarray, row_weights: np.ndarray, swaps: list, n: int, fairness: float = 4.0, ridge: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept: log loss + ridge + fairness * (score - score of the swapped row)^2, by Adam."""
    m = len(rows)
    at, ids = np.repeat(np.arange(m), [len(r) for r in rows]), np.array([k for r in rows for k in r], np.int64)
    pairs = [k for k, s in enumerate(swaps) if s is not None]
    s_at, s_ids = np.repeat(np.arange(len(pairs)), [len(swaps[k]) for k in pairs]), np.array([x for k in pairs for x in swaps[k]], np.int64)
    w, b, mom, sq = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    share = row_weights / max(row_weights.sum(), 1e-9)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[ids], m) + b)))
        g = share * (p - labels)
        grad = np.bincount(ids, g[at], n) + ridge * w
        gb = g.sum()
        if pairs:
            q = 1 / (1 + np.exp(-(np.bincount(s_at, w[s_ids], len(pairs)) + b)))
            o = p[pairs]
            d = 2 * fairness * (o - q) / len(pairs)
            go = np.zeros(m)
            go[pairs] = d * o * (1 - o)
            gq = -d * q * (1 - q)
            grad += np.bincount(ids, go[at], n) + np.bincount(s_ids, gq[s_at], n)
            gb += go.sum() + gq.sum()
        full = np.append(grad, gb)
        mom = 0.9 * mom + 0.1 * full
        sq = 0.999 * sq + 0.001 * full * full
        move = 0.1 * (mom / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict, np.ndarray, float]:
    """Fits on at most max_rows labelled training rows of each class, those of the smallest hashes.

    The sample's ids are bounded by max_rows, so they are broadcast and texts aren't shuffled.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = dict(known.groupBy("toxic").count().collect())
    part = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    from .common import checkpoint

    d = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    ids = checkpoint(part[0].unionByName(part[1]))
    sample = checkpoint(d.join(F.broadcast(ids), F.col("id") == F.col("doc_id")).select("text", "toxic"))
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    counts = sample.mapInArrow(_counted, "feature binary, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    m0, m1 = min(n0, max_rows), min(n1, max_rows)
    p, q = (F.col("pos") + 0.5) / (m1 + 1.0), (F.col("neg") + 0.5) / (m0 + 1.0)
    z = (F.log(p) - F.log(q)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.withColumn("z", z).where("pos + neg >= 4 and abs(z) >= 2.5").orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES).select("feature").collect()
    chosen = {bytes(r[0]): k for k, r in enumerate(best)}
    for k, t in enumerate(_SWAP):  # identity terms always count, so that their weights are held together
        chosen.setdefault(t, len(chosen))
    got = sample.mapInArrow(_encoded(chosen), "toxic int, ids array<int>, swap_ids array<int>").collect()
    y = np.array([r[0] for r in got], float)
    weights = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum())) if len(y) else y
    w, b = fit([r[1] for r in got], y, weights, [r[2] for r in got], len(chosen))
    return chosen, w, b


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts score the intercept. Labels that are null or neither 0 nor 1
    aren't learnt from; without any labels all scores are 0.5. Rows that repeat stay; other columns are ignored.
    """
    chosen, w, b = train(docs, labels, max_rows)

    def run(batches):
        look = Lookup(chosen)
        for x in batches:
            s = np.array([b + sum(w[k] for k in look.of(words(t))) for t in x.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))), pa.float64())], names=["doc_id", "score"])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose whole text isn't predicted toxic, with all columns."""
    chosen, w, b = train(docs, labels)
    bar = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def run(batches):
        look = Lookup(chosen)
        for x in batches:
            yield x.filter(pa.array([b + sum(w[k] for k in look.of(words(t))) < bar for t in x.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
