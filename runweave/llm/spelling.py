"""Spelling variants: the vocabulary's minimal automaton, composed with a one-edit transducer and with itself."""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path
from .merkle import CRC, CRC_TABLE, LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
#: Code points that a partition's words begin with; edits inside of them are found from the words' ends.
START = 3
#: Words of a partition at most; partitions above are parted by one more code point.
MOST = 20_000
#: Distinct runs that a task counts before it hands them on.
HELD = 300_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- vocabulary ------------------------------------------------------------------------------


def misspelt(doc_id, runs: Iterable[str], noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """(word, times) of a document's lower-cased runs. A run whose hash with the document's id is a multiple of noise loses a code point."""
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(runs).items():
        h = zlib.crc32(run.encode(), salt)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, times


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts, long and frequent enough. A null text has none; a null doc_id hashes as an empty one; repeated rows count again."""
    run = re.compile(RUN)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                for word, n in misspelt(doc_id, run.findall(text.as_py().encode().translate(_LOWER).decode())):
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    parts = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- automata --------------------------------------------------------------------------------


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words. States are numbered so that successors come before."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict = {}

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return at

        # open states along the last word: their finished arcs and whether they accept
        open_arcs: list[dict[str, int]] = [{}]
        accepts = [False]
        last = ""
        for word in [*words, None]:
            keep = 0
            if word is not None:
                while keep < len(last) and keep < len(word) and last[keep] == word[keep]:
                    keep += 1
            for depth in range(len(last), keep, -1):
                done = state(open_arcs.pop(), accepts.pop())
                open_arcs[-1][last[depth - 1]] = done
            if word is not None:
                open_arcs += [{} for _ in range(len(word) - keep)]
                accepts += [False] * (len(word) - keep)
                accepts[-1] = True
                last = word
        self.start = state(open_arcs[0], accepts[0])

    def words(self, at: int) -> Iterator[str]:
        todo = [(at, "")]
        while todo:
            q, said = todo.pop()
            if self.final[q]:
                yield said
            todo += [(t, said + c) for c, t in self.arcs[q].items()]


class Composition:
    """Acceptor, transducer of exactly one edit, acceptor: before the edit both sides are in one state, after it in two."""

    def __init__(self, acceptor: Acceptor, longest: int):
        self.of = acceptor
        self.met: dict[tuple[int, int], tuple[str, ...]] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * longest + 1000))

    def meet(self, a: int, b: int) -> tuple[str, ...]:
        """Strings that both states accept."""
        if a == b:
            return tuple(self.of.words(a))
        if a > b:
            a, b = b, a
        found = self.met.get((a, b))
        if found is None:
            here, there = self.of.arcs[a], self.of.arcs[b]
            out = [""] if self.of.final[a] and self.of.final[b] else []
            for c in here.keys() & there.keys():
                out += [c + s for s in self.meet(here[c], there[c])]
            found = self.met[(a, b)] = tuple(out)
        return found

    def edits(self, q: int) -> list[tuple[str, str]]:
        """What the two sides read on from the state in which the edit takes place: a replacement, or a code point that only the first side has."""
        arcs = list(self.of.arcs[q].items())
        out = []
        for i, (c, t) in enumerate(arcs):
            out += [(c + s, s) for s in self.meet(t, q)]
            for d, u in arcs[i + 1 :]:
                out += [(c + s, d + s) for s in self.meet(t, u)]
        return out

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        """(word, near word, code points before the edit) for all accepted pairs, a pair of words once for each place of its edit."""
        n = len(self.of.arcs)
        at = [self.edits(q) for q in range(n)]
        live = [False] * n
        for q in range(n):
            live[q] = bool(at[q]) or any(live[t] for t in self.of.arcs[q].values())
        todo = [(self.of.start, "")]
        while todo:
            q, said = todo.pop()
            for x, y in at[q]:
                yield said + x, said + y, len(said)
            todo += [(t, said + c) for c, t in self.of.arcs[q].items() if live[t]]


def from_start(words: list[str], prefix: str) -> Iterator[tuple[str, str]]:
    """Pairs of sorted words with that prefix whose edit comes after it."""
    k = len(prefix)
    both = Composition(Acceptor([w[k:] for w in words]), max(map(len, words)))
    for x, y, at in both.pairs():
        if len(x) == len(y) or x[at] != x[at + 1 : at + 2]:
            yield prefix + x, prefix + y


def from_end(words: list[str], suffix: str, length: int) -> Iterator[tuple[str, str]]:
    """Pairs of words with that suffix, the longer one of that length, whose edit comes before it: the reversed words, composed."""
    k = len(suffix)
    both = Composition(Acceptor(sorted(w[: len(w) - k][::-1] for w in words)), length)
    for x, y, at in both.pairs():
        x, y, place = x[::-1] + suffix, y[::-1] + suffix, len(x) - 1 - at
        if len(x) == length and (len(y) == length or x[place] != x[place + 1 : place + 2]):
            yield x, y


# --- distribution ----------------------------------------------------------------------------


def composed(rows: DataFrame, pairs: Callable[[list[str], int, int], Iterable[tuple[str, str]]]) -> DataFrame:
    """(part, cut, length, word, n), a partition's words sorted and put to pairs(words, cut, length) -> word, near, near_n; both ways."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("part", "cut", "length", "word", "n")), strict=True)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, near, near_n = [], [], []
        for (_, cut, length), members in groupby(groups(batches), key=lambda r: r[:3]):
            n = {r[3]: r[4] for r in members}
            for x, y in pairs(list(n), cut, length) if len(n) > 1 else ():
                word += (x, y)
                near += (y, x)
                near_n += (n[y], n[x])
                if len(word) >= 50_000:
                    yield pa.RecordBatch.from_pydict({"word": word, "near": near, "near_n": near_n})
                    word, near, near_n = [], [], []
        yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})

    dealt = rows.select("part", F.col("cut").cast("int").alias("cut"), F.col("length").cast("int").alias("length"), "word", "n").repartition("part", "cut", "length").sortWithinPartitions("part", "cut", "length", "word")
    return dealt.mapInArrow(found, "word string, near string, near_n long")


def by_start(words: DataFrame, most: int = MOST) -> tuple[list[DataFrame], list[tuple[DataFrame, int]]]:
    """Words dealt by their first code points, START or as many more as bring a partition to `most` words; and for each level that had
    larger ones, their words, whose edits at that very place lead from one partition to another."""
    parts, crossing, rest, k = [], [], words, START
    while True:
        head = F.substring("word", 1, k)
        large = rest.groupBy(head.alias("head")).count().where(F.col("count") > most).select("head")
        large = checkpoint(large)
        if large.isEmpty():
            parts.append(rest.select(head.alias("part"), F.lit(k).alias("cut"), F.lit(0).alias("length"), "word", "n"))
            return parts, crossing
        parts.append(rest.join(large, head == F.col("head"), "left_anti").select(head.alias("part"), F.lit(k).alias("cut"), F.lit(0).alias("length"), "word", "n"))
        rest = checkpoint(rest.join(large, head == F.col("head"), "left_semi"))
        crossing.append((rest, k))
        k += 1


def across(words: DataFrame, k: int) -> DataFrame:
    """Pairs whose edit is at place k: their words agree before it and after it, so a key has one word a letter at most, and one without it."""
    key = lambda drop: F.struct(F.substring("word", 1, k).alias("head"), F.expr(f"substring(word, {k + 1 + drop})").alias("tail"))
    cut = words.where(F.char_length("word") > k).select(key(1).alias("key"), F.expr(f"substring(word, {k + 1}, 1)").alias("c"), "word", "n")
    left = cut.select("key", "c", F.col("word").alias("x"), F.col("n").alias("xn"))
    right = cut.select("key", F.col("c").alias("d"), "word", "n")
    whole = words.select(key(0).alias("key"), F.lit(None).cast("string").alias("d"), "word", "n")
    met = left.join(right.unionByName(whole), "key").where("(d IS NOT NULL AND x < word) OR (d IS NULL AND substring(key.tail, 1, 1) <> c)")
    ways = F.array(F.struct(F.col("x").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")), F.struct("word", F.col("x").alias("near"), F.col("xn").alias("near_n")))
    return met.select(F.explode(ways).alias("w")).select("w.*")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n) -> word, near, near_n: all pairs of words that differ by exactly one inserted, deleted or replaced code point, both ways.

    Pairs that begin alike are found in partitions by the words' beginnings (initial states of the automaton). All others differ within the
    first START code points, so they agree from there on but for one: they are found in the reversed automaton, by the length of the longer word and its end.
    """
    parts, crossing = by_start(words, most)
    out = None
    for part in parts:
        found = composed(part, lambda words, cut, _: from_start(words, words[0][:cut]))
        out = found if out is None else out.unionByName(found)
    for rest, k in crossing:
        out = out.unionByName(across(rest, k))
    size, ends = F.char_length("word"), None
    for more in (0, 1):  # as the longer word of a pair, or as the one that lacks a code point
        end = words.select(F.expr(f"substring(word, {START + 1 - more})").alias("part"), F.greatest(F.lit(0), size - START + more).alias("cut"), (size + more).alias("length"), "word", "n")
        ends = end if ends is None else ends.unionByName(end)
    return out.unionByName(composed(ends, lambda words, cut, length: from_end(words, words[0][len(words[0]) - cut :], length)))


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of docs; empty tables and texts without long words give no rows.

    A form is the near word of largest n (ties: smallest by code points) if that is ratio times the word's n at least. A root is reached by
    following forms; as n grows by that factor each time, few joins that double the way do.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "vocabulary")
    vocabulary(docs, min_length, min_count).write.parquet(path)
    words = spark.read.parquet(path)
    best = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("frequent", -F.col("best.less") >= ratio * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("frequent"), F.col("best.near")).alias("form"), F.when(F.col("frequent"), -F.col("best.less")).alias("form_n"))
    found = checkpoint(found)
    way = checkpoint(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = checkpoint(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return found.join(way, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


_BYTES = "list_concat(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':'), ''), lambda ch: ord(ch)::BIGINT), flatten(list_transform(string_split(run, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195::BIGINT, ord(ch)::BIGINT - 64] END)))"
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, xor({CRC.format(bytes=_BYTES)}, 4294967295) AS h FROM runs, crc),
spelt AS (SELECT CASE WHEN h % {NOISE} = 0 THEN concat(run[:(h % length(run))], run[(h % length(run)) + 2:]) ELSE run END AS word, times FROM hashed),
words AS (SELECT * FROM (SELECT word, sum(times)::BIGINT AS n FROM spelt GROUP BY word) WHERE length(word) >= {MIN_LENGTH} AND n >= {MIN_COUNT}),
cuts AS (SELECT word, n, i, concat(word[:i], word[i + 2:]) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
met AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
        UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS most FROM met GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * n THEN near END AS form, CASE WHEN most >= {RATIO} * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
way(word, place) AS (SELECT word, word FROM found UNION ALL SELECT way.word, f.form FROM way JOIN found f ON f.word = way.place WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, way.place AS root FROM found f JOIN way USING (word) JOIN found last ON last.word = way.place AND last.form IS NULL"""
