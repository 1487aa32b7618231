"""Quality rules on documents and on hosts: rule failures by domain, shrunk by an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_SYMBOL_PERCENT = 20
HOST_RATE, TIMES = 0.25, 3.0
LEAST_STRENGTH = 10.0  # rows that the prior weighs at least, so that no host falls by one or two documents
_P = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW, 0, -1)], dtype=np.uint64)


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    # exact: pairs of ids are renumbered, so that 2, 4 and then 8 words have one number each
    for span in (1, 2, 4):
        pair = x[:-span] * np.uint64(len(x) + 1) + x[span:] if len(x) < (1 << 31) else None
        _, x = np.unique(pair, return_inverse=True)
        x = x.astype(np.uint64)
    twice = np.bincount(x.astype(np.int64))[x.astype(np.int64)] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, seen = 0, set()
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches):
    for b in batches:
        cols = list(zip(*map(measures, b.column("text").to_pylist()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "host", *NAMES])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every whole text (null: none)."""
    d = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_measure, f"doc_id {kind}, host string, " + ", ".join(f"{n} long" for n in NAMES))


def rules() -> dict[str, F.Column]:
    """Name -> whether a document fails the rule. The first two are the base rules."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
    }


def failed() -> F.Column:
    return rules()["short"] | rules()["repeats"]


def prior(hosts: int, n: float, failures: float, squares: float) -> tuple[float, float]:
    """Mean and strength of the beta prior of a rule, by moments over hosts that count by their rows.

    squares: the sum of failures^2 / n over hosts. The spread of the hosts' rates is that seen less what sampling alone gives; where nothing is
    left, the prior weighs as much as all rows, so that each host gets the mean.
    """
    if not n:
        return 0.0, LEAST_STRENGTH
    mean = failures / n
    noise = hosts * mean * (1 - mean) / n
    spread = squares / n - mean * mean - noise
    return mean, max(LEAST_STRENGTH, min(n, mean * (1 - mean) / spread - 1) if spread > 0 else n)


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(host, n, and failures by rule) -> also rate_<rule>, the shrunk rate of each rule, and host_kept.

    A host is refused when the shrunk rate of a rule, less two standard deviations of its posterior, is above HOST_RATE and above TIMES the rate of the corpus.
    """
    names = list(rules())
    sums = [F.sum(c).cast("double") for k in names for c in (F.col(k), F.col(k) * F.col(k) / F.col("n"))]
    hosts, n, *got = counts.agg(F.count("*"), F.sum("n"), *sums).first()  # one row of sums
    bad = F.lit(False)
    for k, name in enumerate(names):
        mean, strength = prior(hosts, float(n or 0), got[2 * k] or 0.0, got[2 * k + 1] or 0.0)
        counts = counts.withColumn(f"rate_{name}", (F.col(name) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
        rate = F.col(f"rate_{name}")
        bad = bad | (rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1))) > max(HOST_RATE, TIMES * mean))
    return counts.withColumn("host_kept", ~bad)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document the counts, base_failed, kept, and the host's shrunk rates.

    Failures are summed up by host and rule, so a host's rows only meet in sums with partial aggregation. Null hosts are one host of
    their own; null and empty texts have no words and fail; rows that repeat stay.
    """
    from .common import checkpoint

    d = checkpoint(measured(docs, host).withColumn("base_failed", failed()))
    counts = d.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(k) for k, c in rules().items()))
    rates = [f"rate_{k}" for k in rules()]
    v = host_verdicts(counts).select(F.col("host").alias("of"), *rates, "host_kept")
    return d.join(v, d["host"].eqNullSafe(F.col("of")), "left").drop("of").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


_RULES_SQL = {"short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "100 * n_symbols > 20 * word_chars"}
_RATES = ", ".join(f"({k} + (SELECT m * s FROM p_{k})) / (n + (SELECT s FROM p_{k})) AS rate_{k}" for k in _RULES_SQL)
_BAD = " OR ".join(f"rate_{k} - 2 * sqrt(rate_{k} * (1 - rate_{k}) / (n + (SELECT s FROM p_{k}) + 1)) > greatest(0.25, 3 * (SELECT m FROM p_{k}))" for k in _RULES_SQL)
_PRIORS = ", ".join(f"p_{k} AS (SELECT m, greatest(10, CASE WHEN v > 0 THEN least(n, m * (1 - m) / v - 1) ELSE n END) AS s FROM (SELECT n, m, q / n - m * m - h * m * (1 - m) / n AS v FROM (SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum({k}) / sum(n) AS m, sum({k} * {k} / n) AS q FROM hosts)))" for k in _RULES_SQL)
ORACLE = rf"""WITH m AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM m WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) x(j) GROUP BY doc_id),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM m) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
d AS (SELECT m.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _RULES_SQL.items())} FROM d GROUP BY source),
{_PRIORS},
rated AS (SELECT source, n, {_RATES} FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ({_BAD}) AS kept, {", ".join(f"round(rate_{k}, 9) AS rate_{k}" for k in _RULES_SQL)} FROM d JOIN rated ON rated.source IS NOT DISTINCT FROM d.source"""
