"""Log-bilinear language model, trained in numpy by noise-contrastive estimation inside Spark tasks.

A text is a sequence of symbols: the most frequent words (their number grows with the corpus), the end, and classes of all
other words by their last two bytes. The score of symbol w after symbol a in state g is r_w . (p_a + q_g) + b_w; the state is the cluster of
symbols that the text so far is likeliest in. Batched matrix products over all contexts give the normalisers, so that a symbol's
log-probability is its score less one number. A word of a class then has its smoothed share of the class, so that probabilities
add up to 1 over all known words and one unknown word for each class.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint

CLASSES, STATES, WIDTH = 200, 12, 16
STATE_WORDS = 311  # frequent words that vote for a state by themselves; all others vote with their class
GROWTH = 8  # words with vectors of their own: GROWTH times the cube root of the training tokens
END = b" "  # no word has a space
ALPHA = 0.1
NOISE, BATCH, RATE = 64, 1024, 0.2
LEAST_STEPS, MOST_EPOCHS, HELD = 1500, 40, 2_000_000
TABLE, LONGEST = 262_144, 64  # words of at most LONGEST bytes whose counts every task has; counts of the others come by a join
CHUNK = 2 << 20
BUCKETS = 16  # of counts, for each doubling


def held_out(col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 10 == 0


# --- words -----------------------------------------------------------------------------------


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts one after the other, and their number in each text."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    split = pc.ascii_split_whitespace(low)
    n = np.where(pc.binary_length(low).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(split).to_numpy(zero_copy_only=False), 0)
    flat = split.flatten().cast(pa.binary())
    return flat.filter(pc.greater(pc.binary_length(flat), 0)), n.astype(np.int64)


def chunked(b: pa.RecordBatch):
    """Slices of a batch with about CHUNK bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
    s = 0
    while s < b.num_rows:
        e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + CHUNK, "right")))
        yield b.take(pa.array(np.arange(s, e)))  # a copy: some kernels misread slices after a cast
        s = e


def merged(parts: list[pa.Table]) -> list[pa.RecordBatch]:
    t = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")])
    return pa.table([t.column("word"), t.column("c_sum")], names=["word", "c"]).to_batches(max_chunksize=100_000)


def _count(batches):
    held, rows, texts = [], 0, 0
    for b in batches:
        for part in chunked(b):
            words, n = tokens(part.column("text"))
            c = words.value_counts()
            held.append(pa.table([c.field(0), c.field(1)], names=["word", "c"]))
            texts += len(n)
            rows += len(c)
            if rows > 1_000_000:
                yield from merged(held)
                held, rows = [], 0
    if texts:
        held.append(pa.table([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "c"]))
        yield from merged(held)


def symbols_for(n: int) -> int:
    return math.ceil(GROWTH * n ** (1 / 3))


@dataclass
class Symbols:
    """Numbers of words: own words, the end, classes by the last two bytes, and the class of all other endings."""

    own: list[bytes]
    endings: list[bytes]
    base: int = field(init=False)

    def __post_init__(self):
        self.end, self.base = len(self.own), len(self.own) + 1
        self.size = self.base + len(self.endings) + 1
        self._own, self._endings = pa.array(self.own, pa.binary()), pa.array(self.endings, pa.binary())

    def classes(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(pc.binary_slice(words, -2), value_set=self._endings)
        return pc.fill_null(found, len(self.endings)).to_numpy(zero_copy_only=False).astype(np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.fill_null(pc.index_in(words, value_set=self._own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = out < 0
        if rare.any():
            out[rare] = self.base + self.classes(words.filter(pa.array(rare)))
        return out

    def fold(self) -> np.ndarray:
        """For each symbol, the one that votes for a state: frequent words and the end by themselves, other words with their class."""
        k = min(STATE_WORDS, len(self.own))
        own = self.classes(self._own) + k + 1 if len(self.own) else np.empty(0, np.int64)
        own[:k] = np.arange(k)
        return np.r_[own, k, np.arange(len(self.endings) + 1) + k + 1]

    def texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Symbols of all texts with their ends, the place after each text, the words, and the places of the words."""
        words, n = tokens(text)
        stop = np.cumsum(n + 1)
        x = np.full(int(stop[-1]) if len(stop) else 0, self.end, np.int64)
        is_word = np.ones(len(x), bool)
        is_word[stop - 1] = False
        x[is_word] = self.of(words)
        return x, stop, words, np.flatnonzero(is_word)


def before(x: np.ndarray, stop: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each one; before the first of a text, the end."""
    return np.r_[end, x[:-1]] if len(x) else x


def states(x: np.ndarray, stop: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """At each place, the cluster in which the symbols before it in its text are likeliest; 0 at the first."""
    out = np.zeros(len(x), np.int64)
    s = 0
    for e in stop.tolist():
        sofar = np.zeros(votes.shape[1], np.float32)
        for k in range(s, e - 1, 65_536):
            run = np.cumsum(votes[x[k : min(k + 65_536, e - 1)]], axis=0, dtype=np.float32) + sofar
            out[k + 1 : k + 1 + len(run)] = run.argmax(axis=1)
            sofar = run[-1]
        s = e
    return out


# --- fitting ---------------------------------------------------------------------------------


def _pairs(sym: Symbols):
    def run(batches):
        fold = sym.fold()
        n = int(fold.max()) + 1
        total = np.zeros(n * n, np.int64)
        for b in batches:
            for part in chunked(b):
                x, stop, *_ = sym.texts(part.column("text"))
                total += np.bincount(fold[before(x, stop, sym.end)] * n + fold[x], minlength=n * n)
        ids = np.flatnonzero(total)
        for s in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 100_000]), pa.array(total[ids[s : s + 100_000]])], names=["id", "c"])

    return run


def clusters(pairs: np.ndarray, k: int = STATES, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Votes of each symbol (rows) for each of k clusters: log P(symbol | cluster), from k-means on what follows and what comes before a symbol."""
    rng = np.random.default_rng(seed)
    n = len(pairs)
    share = lambda m: np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))
    feat = np.hstack([share(pairs), share(pairs.T)])
    weight = pairs.sum(axis=1) + 1.0
    centre = feat[rng.choice(n, min(k, n), replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        near = (feat @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        for c in range(len(centre)):
            if (own := near == c).any():
                centre[c] = np.average(feat[own], axis=0, weights=weight[own])
    out = np.zeros((n, k))
    for c in range(k):
        row = pairs[near == c].sum(axis=0) + 0.5 if c < len(centre) else np.full(n, 0.5)
        out[:, c] = np.log(row / row.sum())
    return (out - out.mean(axis=1, keepdims=True)).astype(np.float32)


class Nce:
    """Log-bilinear parameters under noise-contrastive estimation with AdaGrad. The last column of r is the bias b."""

    def __init__(self, q: np.ndarray, n_states: int = STATES, width: int = WIDTH, noise: int = NOISE, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(q)
        self.par = {k: rng.normal(0, 0.1, (m, width + 1)).astype(np.float32) for k, m in (("r", n), ("p", n), ("q", n_states))}
        self.par["r"][:, -1] = np.log(q)
        self.par["p"][:, -1] = self.par["q"][:, -1] = 0
        self.seen = {k: np.zeros(len(v), np.int64) for k, v in self.par.items()}
        self.which = np.arange(n_states)[:, None]
        self.square = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.par.items()}
        self.cum, self.log_kq, self.noise, self.rng, self.steps = np.cumsum(q), np.log(noise * q).astype(np.float32), noise, rng, 0

    def add(self, name: str, at: np.ndarray, change: np.ndarray, rate: float) -> None:
        """One AdaGrad step for the rows at, whose changes add up where a row stands more than once."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate(([0], first))
        rows, g = at[first], np.add.reduceat(change[order], first, axis=0)
        square = self.square[name][rows] + g * g
        self.square[name][rows] = square
        g *= rate / np.sqrt(square)
        self.par[name][rows] += g

    def step(self, a: np.ndarray, g: np.ndarray, w: np.ndarray, rate: float = RATE) -> None:
        """One update: each symbol w against the same NOISE symbols drawn from the distribution of single symbols."""
        r, p, q = self.par["r"], self.par["p"], self.par["q"]
        drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(self.noise) * self.cum[-1]), len(self.cum) - 1)
        h = p[a] + q[g]
        h[:, -1] = 1
        own, other = r[w], r[drawn]
        up = 1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", h, own) - self.log_kq[w], 30)))
        down = -1 / (1 + np.exp(np.minimum(self.log_kq[drawn] - h @ other.T, 30)))
        back = up[:, None] * own + down @ other
        back[:, -1] = 0
        self.add("r", np.concatenate((w, drawn)), np.concatenate((up[:, None] * h, down.T @ h)), rate)
        self.add("p", a, back, rate)
        self.add("q", self.which[:, 0], (g == self.which).astype(np.float32) @ back, rate)
        self.steps += 1

    def learn(self, a: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        """Updates over all symbols in a drawn order."""
        for name, at in (("r", w), ("p", a), ("q", g)):
            self.seen[name] += np.bincount(at, minlength=len(self.seen[name]))
        order = self.rng.permutation(len(w))
        for s in range(0, len(w), BATCH):
            k = order[s : s + BATCH]
            self.step(a[k], g[k], w[k])


def _trained(sym: Symbols, votes: np.ndarray, q: np.ndarray):
    """Each task learns on the texts that it reads, again and again where they are few, and hands out its vectors with the number of symbols they rest on."""

    def run(batches):
        model, held, kept = Nce(q, votes.shape[1]), [], 0
        for b in batches:
            for part in chunked(b):
                x, stop, *_ = sym.texts(part.column("text"))
                data = before(x, stop, sym.end), states(x, stop, votes), x
                model.learn(*data)
                kept += len(x)
                if kept <= HELD:
                    held.append(data)
        for _ in range(MOST_EPOCHS):
            if kept > HELD or model.steps >= LEAST_STEPS:
                break
            for data in held:
                model.learn(*data)
        for k, name in enumerate(("r", "p", "q")):
            rows = np.flatnonzero(model.seen[name])
            for s in range(0, len(rows), 20_000):
                at = rows[s : s + 20_000]
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(model.par[name][at].ravel().astype(np.float64)), model.par[name].shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(model.seen[name][at].astype(np.float64)), vectors], names=["part", "id", "weight", "vector"])

    return run


def _norms(r: np.ndarray, p: np.ndarray, q: np.ndarray, rows: int):
    def run(batches):
        for b in batches:
            for c in b.column("id").to_pylist():
                h = p[c * rows : (c + 1) * rows]
                out = np.empty((len(h), len(q)))
                score = h[:, :-1] @ r[:, :-1].T + r[:, -1]
                for g in range(len(q)):
                    z = score + r[:, :-1] @ q[g, :-1]
                    top = z.max(axis=1, keepdims=True)
                    out[:, g] = np.log(np.exp(z - top).sum(axis=1, dtype=np.float64)) + top[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=["chunk", "norm"])

    return run


def norms(spark: SparkSession, r: np.ndarray, p: np.ndarray, q: np.ndarray, rows: int = 256) -> np.ndarray:
    """log Z of each symbol (rows) in each state, by batched matrix products; the contexts are dealt over tasks."""
    n = math.ceil(len(p) / rows)
    got = spark.range(0, n, 1, max(1, n // 4)).mapInArrow(_norms(r, p, q, rows), "chunk long, norm array<double>").collect()
    out = np.empty((len(p), len(q)))
    for k, row in got:
        part = np.array(row).reshape(-1, len(q))
        out[k * rows : k * rows + len(part)] = part
    return out


@dataclass
class Model:
    sym: Symbols
    votes: np.ndarray  # by symbol and state
    r: np.ndarray
    p: np.ndarray
    q: np.ndarray
    norm: np.ndarray  # by symbol before and state
    of_class: np.ndarray  # tokens and distinct words of each class
    counts: DataFrame  # word, c: all training tokens
    table: dict  # words and counts of the frequent ones
    train_tokens: int
    distinct: int

    def log_symbols(self, a: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(w | a, g)."""
        h = self.p[a, :-1] + self.q[g, :-1]
        return np.einsum("ij,ij->i", h, self.r[w, :-1], dtype=np.float64) + self.r[w, -1] - self.norm[a, g]


def fit(docs: DataFrame) -> Model:
    """Counts of all words, the symbols, states and vectors from all texts that aren't held out.

    Three passes over the texts: counts; pairs of neighbours among few symbols for the states; noise-contrastive training, where each task
    learns on its own texts and vectors are averaged by the number of symbols they rest on. What reaches the driver: the TABLE most
    frequent words, vectors of GROWTH * tokens^(1/3) symbols, and sums by ending (two bytes).
    """
    spark = docs.sparkSession
    train = docs.where(~held_out()).select(F.col("text").cast("string").alias("text"))
    counts = checkpoint(train.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != F.lit(END))
    short = words.where(F.octet_length("word") <= LONGEST).withColumn("bucket", F.floor(F.log2("c") * BUCKETS))
    most, least, size = max(TABLE, symbols_for(n)), 1 << 30, 0
    for bucket, many in sorted(short.groupBy("bucket").count().collect(), reverse=True):
        if (size := size + many) > most:
            break
        least = bucket
    got = short.where(F.col("bucket") >= least).select("word", "c").toArrow()
    table = sorted(zip(got.column("c").to_pylist(), got.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    own = [w for _, w in table[: symbols_for(n)]]
    last = table[len(own) - 1] if own else (1 << 62, b"")
    is_own = (F.octet_length("word") <= LONGEST) & ((F.col("c") > last[0]) | (F.col("c") == last[0]) & (F.col("word") <= F.lit(last[1])))
    endings = words.where(~is_own).groupBy(F.expr("substring(word, -2, 2)").alias("ending")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    endings = sorted(((int(r[1]), int(r[2]), bytes(r[0])) for r in endings), key=lambda x: (-x[0], x[2]))
    sym = Symbols(own, [e for *_, e in endings[: CLASSES - 1]])
    of_class = np.zeros((len(sym.endings) + 1, 2))
    for k, (tokens_, distinct, _) in enumerate(endings):
        of_class[min(k, len(sym.endings))] += tokens_, distinct

    fold = sym.fold()
    few = int(fold.max()) + 1
    pairs = np.zeros(few * few)
    got = train.mapInArrow(_pairs(sym), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    pairs[got.column("id").to_numpy()] = got.column("c").to_numpy()
    votes = clusters(pairs.reshape(few, few))[fold]

    docs_ = int(counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    q = np.r_[[c for c, _ in table[: len(own)]], docs_, of_class[:, 0]] + 0.5
    start = Nce(q / q.sum(), STATES)
    parts = train.mapInArrow(_trained(sym, votes, q / q.sum()), "part int, id long, weight double, vector array<double>")
    means = [(F.sum(F.col("vector")[k] * F.col("weight")) / F.sum("weight")).alias(f"v{k}") for k in range(WIDTH + 1)]
    got = parts.groupBy("part", "id").agg(*means).toArrow()
    part, at = got.column("part").to_numpy(), got.column("id").to_numpy()
    vectors = np.stack([got.column(f"v{k}").to_numpy() for k in range(WIDTH + 1)], axis=1).astype(np.float32) if len(part) else np.empty((0, WIDTH + 1), np.float32)
    for k, name in enumerate(("r", "p", "q")):
        start.par[name][at[part == k]] = vectors[part == k]
    r, p, q = (start.par[k] for k in ("r", "p", "q"))
    return Model(sym, votes, r, p, q, norms(spark, r, p, q), of_class, counts, {"word": [w for _, w in table], "c": [c for c, _ in table]}, int(n), int(v))


# --- scoring ---------------------------------------------------------------------------------


def _scored(shared, n_train: int, distinct: int, end_count: int):
    """For each text all that the shared tables settle, and the words whose counts they don't hold."""

    def run(batches):
        from pyspark import TaskContext

        votes, r, p, q, norm, of_class, own, endings, table, c = shared.value
        model = Model(Symbols(own, endings), votes, r, p, q, norm, of_class, None, {}, n_train, distinct)
        sym, known = model.sym, pa.array(table, pa.binary())
        logs = np.r_[np.log10(np.array(c, float) + ALPHA), 0.0]  # the last: a word that the table lacks
        share = -np.log10(of_class[:, 0] + ALPHA * (of_class[:, 1] + 1))
        every = np.log10(n_train + ALPHA * (distinct + 1))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for part in chunked(b):
                x, stop, words, place = sym.texts(part.column("text"))
                start = np.r_[0, stop[:-1]]
                per_text = lambda v: np.add.reduceat(v, start) if len(start) else v  # noqa: E731, B023
                value = model.log_symbols(before(x, stop, sym.end), states(x, stop, votes), x) / np.log(10)
                at = pc.fill_null(pc.index_in(words, value_set=known), len(table)).to_numpy(zero_copy_only=False).astype(np.int64)
                base = np.full(len(x), np.log10(end_count + ALPHA) - every)
                base[place] = logs[at] - every
                rare = x[place] >= sym.base
                value[place[rare]] += logs[at[rare]] + share[x[place[rare]] - sym.base]
                held = np.full(len(x), int(end_count > 0), np.int64)
                held[place] = at < len(table)
                lacking = at == len(table)
                many = np.zeros(len(x), np.int64)
                many[place] = lacking
                tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text(many))].astype(np.int32)), words.filter(pa.array(lacking)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(stop))), part.column("doc_id"), pa.array(np.diff(np.r_[0, stop])), pa.array(per_text(held)), pa.array(per_text(base)), pa.array(per_text(value)), tail], names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail"])
                row += len(stop)

    return run


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score under a fitted model."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    end_count = int(model.counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    # bounded: TABLE words of at most LONGEST bytes, and the vectors
    shared = docs.sparkSession.sparkContext.broadcast((model.votes, model.r, model.p, model.q, model.norm, model.of_class, model.sym.own, model.sym.endings, model.table["word"], model.table["c"]))
    made = checkpoint(d.mapInArrow(_scored(shared, model.train_tokens, model.distinct, end_count), f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, tail array<binary>"))
    tail = made.select("row", F.explode("tail").alias("word")).join(model.counts, "word", "left")
    sums = tail.groupBy("row").agg(F.count("c").alias("found"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("logs"))
    zero = F.coalesce("logs", F.lit(0.0))
    out = made.drop("tail").join(sums, "row", "left")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + zero).alias("base_score"), (F.col("score") + zero).alias("score"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model learns from the texts that aren't held out (fit). A text's tokens are scored where it is read; only the words that
    are not among the TABLE most frequent ones leave it, meet their counts in a join, and come back as one sum a text: both scores need
    no more of them than the sum of log10(count + ALPHA).
    Null and empty texts are the end alone; rows that repeat stay, each learnt from as often as it stands.
    """
    return score_with(fit(docs), docs)
