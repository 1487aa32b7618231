"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components

SHINGLE, PERCENT = 5, 80
PROBES = 40
SKETCH = 512
BITS = 1 << 26
RATIO = 1.6
LEAST = 100 / PERCENT
_U = np.uint64
_STEP = [_U(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(words: list, seen: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words; of fewer words, the whole sequence is one."""
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(seen.__getitem__, words), _U, len(words))
    k = min(n, len(h))
    s = h[: len(h) - k + 1] * _STEP[0]
    for i in range(1, k):
        s = s + h[i : len(h) - k + 1 + i] * _STEP[i]
    return np.unique(mixed(s + _U(k)))


def largest_difference(n: int, percent: int = PERCENT) -> int:
    """Of two sets of at most n elements whose Jaccard similarity is at least percent: the most elements that one of them lacks."""
    return 2 * n * (100 - percent) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """Size bands that a set of n elements is in. Band k holds the sizes from RATIO^k to RATIO^(k+1), and the sizes below that can still be similar to one of these."""
    k = 0
    while edge(k + 1) <= n:
        k += 1
    return [k, k + 1] if 100 * n >= percent * edge(k + 1) else [k]


@lru_cache
def edge(k: int) -> int:
    return math.ceil(RATIO**k)


@lru_cache
def blocks(k: int, percent: int = PERCENT) -> int:
    """One more than the elements in which a similar pair of the band can differ: so one block at least is free of them."""
    return largest_difference(edge(k + 1) - 1, percent) + 1


def keys(s: np.ndarray, probes: int = PROBES, percent: int = PERCENT) -> list[int]:
    """64-bit keys: for each band and block, the XOR of the block's hashes with the band and the block. Blocks without elements have none.

    Bands of few blocks are dealt again by other hashes until there are about so many probes, so that a pair whose free block is empty is still met.
    """
    out = []
    for k in bands(len(s), percent):
        m = blocks(k, percent)
        for again in range(max(1, probes // m)):
            b = (mixed(s ^ _STEP[20 + again % 40]) >> _U(16)) % _U(m)
            few = b < _U(probes)
            b, x = b[few], s[few]
            if len(b):
                order = np.argsort(b, kind="stable")
                b, x = b[order], x[order]
                first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                tag = (b[first] + _U(1)) * _STEP[3] + _U(((k << 8) + again) * 0x9E3779B97F4A7C15 % (1 << 64))
                out.append(mixed(np.bitwise_xor.reduceat(x, first) ^ mixed(tag)))
    return np.unique(np.concatenate(out)).astype(np.int64).tolist() if out else []


def exact_keys(s: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Keys such that any similar pair shares one, whatever the sets.

    All blocks of a band are probed. A pair is missed by a dealing only if each block in which one of its sets has elements holds a
    difference; so a set that has elements in more blocks than it can differ in from any partner is safe, and so are its pairs. A set that isn't
    safe is dealt again by the next hash until it is. Partners do the same in the same order, so both of a pair have the keys of the dealing in which the first of them is safe.
    """
    out = []
    for k in bands(len(s), percent):
        m = blocks(k, percent) * 103 // 100 + 2
        most = (len(s) + min(edge(k + 1) - 1, 100 * len(s) // percent)) * (100 - percent) // (100 + percent)
        for again in itertools.count():
            deal = mixed(np.array([0xD1B54A32D192ED03 + again], _U))[0]
            b = (mixed(s ^ deal) >> _U(16)) % _U(m)
            order = np.argsort(b, kind="stable")
            b, x = b[order], s[order]
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            tag = (b[first] + _U(1)) * _STEP[5] + deal + _U((k << 8) * 0x9E3779B97F4A7C15 % (1 << 64))
            out.append(mixed(np.bitwise_xor.reduceat(x, first) ^ mixed(tag)))
            if len(first) > most:
                break
    return np.unique(np.concatenate(out)).astype(np.int64).tolist() if out else []


def sketch(s: np.ndarray) -> list[int]:
    """SKETCH parity bits: each element flips one, so the Hamming distance of two sketches is at most the symmetric difference of the sets."""
    bits = np.bincount((mixed(s ^ _U(0xA0761D6478BD642F)) >> _U(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _signed(n: int, exact: bool):
    def run(batches):
        made = exact_keys if exact else keys
        seen = WordHash()
        for b in batches:
            size, code, ks, sk = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), seen, n)
                size.append(len(s))
                if len(s):
                    code.append(s.sum(dtype=_U).tobytes() + np.bitwise_xor.reduce(mixed(s ^ _STEP[11])).tobytes())
                    ks.append(made(s))
                    sk.append(sketch(s))
                else:
                    code.append(None)
                    ks.append(None)
                    sk.append(None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(code, pa.binary()), pa.array(ks, pa.list_(pa.int64())), pa.array(sk, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "code", "keys", "sketch"])

    return run


def _alike(n: int, percent: int):
    def run(batches):
        seen, sets = WordHash(), {}

        def of(cls: int, text: str | None) -> np.ndarray:
            if cls not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[cls] = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), seen, n)
            return sets[cls]

        for batch in batches:
            ends = [batch.column(c).to_pylist() for c in ("a", "b", "x", "y")]
            good = []
            for a, b, x, y in zip(*ends, strict=True):
                p, q = of(a, x), of(b, y)
                common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def bitmap(found: DataFrame, at: Column) -> Broadcast:
    """The places of rows as bits of a broadcast array, about 16 bits a row and BITS at most. Other rows may fall on the same places, so it only sorts out early what a join would drop."""
    size = 1 << min(BITS.bit_length() - 1, max(15, (16 * found.count()).bit_length()))
    place = at.bitwiseAND(size - 1)
    parts = found.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((size >> 15, 1 << 12), np.uint8)
    for part, bits in parts.collect():
        out[part] = np.frombuffer(bits, np.uint8)
    return found.sparkSession.sparkContext.broadcast(out.reshape(-1))


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are set."""
    at = at & (8 * len(bits) - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _standing(bits: Broadcast):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_set(bits.value, b.column("at").to_numpy()))).select(["cls", "text"])

    return run


def _shared(bits: Broadcast):
    def run(batches):
        for b in batches:
            ks = b.column("keys")
            key, cls = ks.flatten().to_numpy(), np.repeat(b.column("doc_id").to_numpy(), ks.value_lengths().to_numpy())
            held = _set(bits.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[held]), pa.array(cls[held])], names=["key", "cls"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough; sets are made again from the texts of the classes that stand in a pair.

    Only texts that may stand in one are dealt out, and as texts: their sets of hashes take more than twice the disk.
    """
    place = F.xxhash64("cls")
    bits = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("cls")), place)
    ends = texts.where("cls IS NOT NULL").select("cls", "text", place.alias("at")).mapInArrow(_standing(bits), "cls long, text string")
    left = pairs.join(ends.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(ends.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike(n, percent), "a long, b long")


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key __row, and whether any of them is made: ids are keys, but of rows that share only an id, all but the first (by the hash of
    its text) get a hash of id and text above other ids, as rows without an id do."""
    d = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    made = F.xxhash64("__id", "__hash").bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    shared = d.where("__id IS NOT NULL").groupBy(F.col("__id").alias("__of")).agg(F.min("__hash").alias("__least"), F.max("__hash").alias("__most")).where("__least < __most").drop("__most")
    shared = checkpoint(shared)
    if shared.isEmpty():
        return d.withColumn("__row", F.coalesce("__id", made)), False
    d = d.join(shared, F.col("__id") == F.col("__of"), "left")
    return d.withColumn("__row", F.when(F.col("__id").isNull() | (F.col("__hash") > F.col("__least")), made).otherwise(F.col("__id"))), True


def similar_groups(docs: DataFrame, n: int = SHINGLE, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text, by `groups_of`.

    Rows that share an id but not the text count as rows of their own: each has a row here, and its links. A component has the smallest id in it.
    """
    d, made = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    if not made:
        return groups_of(docs, n, exact)
    named = d.where("__id IS NOT NULL").select("__id", "__row")
    found = groups_of(d.where("__id IS NOT NULL").select(F.col("__row").alias("doc_id"), "text"), n, exact).dropDuplicates(["doc_id"])
    rows = checkpoint(named.join(found.withColumnRenamed("doc_id", "__row"), "__row"))
    low = rows.groupBy("component_id").agg(F.min("__id").alias("low"))
    out = rows.join(low, "component_id").select(F.col("__id").alias("doc_id"), "n_shingles", F.col("low").alias("component_id"))
    return out.unionByName(groups_of(docs.where(F.col("doc_id").cast("long").isNull()), n, exact))


def groups_of(docs: DataFrame, n: int = SHINGLE, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text; ids stand for one text each.

    Texts of equal sets are one class. For each size band, elements are dealt into
    one block more than a similar pair can differ in; by the pigeonhole one block is free of differences, and the XOR of its hashes is
    a key that both sets have. PROBES of the blocks are probed, which leaves a similar
    pair unmet with a chance below 1e-7 at the threshold, and far less above it; exact=True probes all blocks and deals sets again
    until no pair can go unmet (exact_keys), at about four times the keys. Sets are compared as 64-bit hashes of shingles: two shingles of
    one hash count as one.
    First the members of a key are held against its smallest class, then any two members of a key that are
    not yet in one component and whose parity sketches allow it. Each candidate is verified on the sets of 64-bit shingle hashes.
    Null and empty texts have no shingles and are alone. Rows that repeat are copies; a row without an id is a group of its own, with no component_id.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = checkpoint(d.mapInArrow(_signed(n, exact), "doc_id long, n_shingles long, code binary, keys array<long>, sketch array<long>"))
    of = signed.where("code IS NOT NULL AND doc_id IS NOT NULL")
    copies = of.groupBy("code", "n_shingles").agg(F.min("doc_id").alias("cls"))
    member = checkpoint(of.select("doc_id", "code", "n_shingles").join(copies, ["code", "n_shingles"]).select("doc_id", "cls", "n_shingles"))
    reps = signed.join(copies.select(F.col("cls").alias("doc_id")), "doc_id", "left_semi").where("code IS NOT NULL").dropDuplicates(["doc_id"])
    slim = reps.select(F.col("doc_id").alias("cls"), F.explode("keys").alias("key"))
    shared = checkpoint(slim.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("key", "low"))
    # most keys have one class: only the others are dealt out a second time
    held = of.select("doc_id", "keys").mapInArrow(_shared(bitmap(shared, F.col("key"))), "key long, cls long")
    inside = checkpoint(held.join(shared, "key").join(copies.select("cls"), "cls", "left_semi").distinct())
    texts = d.select(F.col("doc_id").alias("cls"), "text")
    tried = checkpoint(inside.where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct())
    first = checkpoint(verified(tried, texts, n))
    comp = connected_components(first)
    known = inside.select("key", "cls").join(comp, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    known = checkpoint(known)
    open_ = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    rest = known.join(open_, "key", "left_semi")
    info = reps.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64)))
    rest = checkpoint(rest.join(info, "cls"))
    x, y = rest.alias("x"), rest.alias("y")
    apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH // 64)), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    may = (F.col("x.comp") < F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")) & ((100 + PERCENT) * apart <= (100 - PERCENT) * total)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & may).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    more = checkpoint(more.join(tried, ["a", "b"], "left_anti"))
    second = checkpoint(verified(more, texts, n))
    comp = connected_components(checkpoint(first.unionByName(second)))
    out = member.join(comp, F.col("cls") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))
    alone = signed.where("code IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def deduplicated(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row of docs for each group: the one of the smallest doc_id, a null one last; texts without words are groups of one.

    Rows that share id and text are one; of rows that share only an id, all but the first (by the hash of its text) get a key of their own,
    as rows without an id do: a hash of id and text, above other ids. The others keep their id as key, since the
    join holds the members of a key against the smallest.
    """
    d = keyed(docs)[0]
    groups = groups_of(d.select(F.col("__row").alias("doc_id"), "text"), exact=exact)
    first = checkpoint(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct())
    return d.join(first, F.col("__row") == F.col("__keep"), "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


#: All pairs that share a shingle, compared as words; for small tables.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""
