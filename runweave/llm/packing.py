"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

CAPACITY, END = 1024, 2
DEAL = 100_000  # pieces of all lengths to a part; ranks are counted part by part
SPECIAL = "<|endoftext|>"
CACHE = 400_000


class Encoder(dict):
    """Bytes of the little-endian ids of a text.

    A text splits before each space that stands between two characters that aren't white space (in Unicode's sense); the pattern of
    the vocabulary never joins across it, so each unit is encoded once and kept.
    """

    _SPLIT = re.compile(r" (?=\S)(?<=\S )")

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(ranks).to_bytes(4, "little")
        self.coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def direct(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self.direct(" " + unit)
        if len(unit) <= 64:
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:  # the tokenizer knows this string as one id
            return self.special.join(self.encode(x) if x else b"" for x in text.split(SPECIAL))
        first, *rest = self._SPLIT.split(text)
        return self.direct(first) + b"".join(map(self.__getitem__, rest))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first of several may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int, path: str | None):
    def run(batches):
        coder = Encoder(path)
        end = END.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = coder.encode(text or "") + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_pieces(capacity, path), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY):
    """Bins for counts[n] pieces of length n: yields (lengths in a bin, how many such bins).

    A bin takes the longest piece that fits until none does. Then its smallest piece
    gives way to the two unpacked ones that together fill the widened gap best, if they fill it better.
    The available lengths are bits of a number, so each choice is a shift; a
    bin is repeated while all of its lengths last, since the same choices come again.
    """
    left = [int(x) for x in counts]
    have = sum(1 << n for n, c in enumerate(left) if c and n)
    mirror = sum(1 << (capacity - n) for n, c in enumerate(left) if c and n)

    def take(n: int, k: int = 1) -> None:
        nonlocal have, mirror
        left[n] -= k
        if not left[n]:
            have &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))

    def put(n: int) -> None:
        nonlocal have, mirror
        left[n] += 1
        have |= 1 << n
        mirror |= 1 << (capacity - n)

    while have:
        bin_: list[int] = []
        gap = capacity
        while fit := have & ((1 << (gap + 1)) - 1):
            n = fit.bit_length() - 1
            bin_.append(n)
            take(n)
            gap -= n
        if gap and have:
            s = bin_[-1]
            for total in range(gap + s, s, -1):
                both = have & (mirror >> (capacity - total)) & ~((1 << ((total + 1) // 2)) - 1) if total <= capacity else 0
                while both:
                    a = both.bit_length() - 1
                    b = total - a
                    if b > 0 and (a != b or left[a] > 1):
                        take(a)
                        take(b)
                        put(s)
                        bin_[-1:] = [a, b]
                        break
                    both &= ~(1 << a)
                else:
                    continue
                break
        use: dict[int, int] = {}
        for n in bin_:
            use[n] = use.get(n, 0) + 1
        more = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            if more:
                take(n, k * more)
        yield bin_, 1 + more


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, runs of pieces by rank: (first rank, first sequence, offset), where the pieces of a run go to successive sequences.

    The whole corpus is one plan: it depends on the histogram of lengths alone (capacity numbers), so not on partitions.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in best_two_fit(counts, capacity):
        at = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), first, at))
            used[n] = used.get(n, 0) + times
            at += n
        first += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def _placed(runs: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for k in np.unique(n):
                own = np.flatnonzero(n == k)
                r = runs[int(k)]
                at = np.searchsorted(r[:, 0], rank[own], "right") - 1
                seq[own] = r[at, 1] + rank[own] - r[at, 0]
                off[own] = r[at, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document.

    The lengths of all pieces are counted, best-two-fit makes one plan of the counts (at most capacity numbers on the driver), and
    each piece takes the place that the plan has for its rank among the pieces of its length. Ranks are counted in parts of about
    DEAL pieces, dealt by hash, whose sizes are then summed up; so neither a common length nor the corpus meets in one task, and
    sequences don't depend on the number of partitions. Only lengths and checksums are shuffled.
    Null and empty texts are one piece (the end id). Rows that repeat are packed each.
    """
    p = checkpoint(pieces(docs, capacity, path))
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in p.groupBy("length").count().collect():  # at most capacity rows
        counts[n] = k
    parts = max(1, math.ceil(counts.sum() / DEAL))
    dealt = p.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    sizes = sizes.select("length", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", rank).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    kind = p.schema["doc_id"].dataType.simpleString()
    columns = "piece int, start long, length long, ids_crc32 long"
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placed(plan(counts, capacity)), f"doc_id {kind}, {columns}, sequence_id long, offset long")
