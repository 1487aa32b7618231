"""Main text of web pages: structure marks, and a suffix array over the whole text of each host."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions
from .jaccard import similar_groups

DEPTH = 8  # tokens: a repeated run is at least so long
MIN_PAGES = 3
SHARE = 0.3  # of a host's pages: the least on which boilerplate stands
MIN_ARTICLES = 5  # the same two for what stands inside marked articles
SHARE_ARTICLES = 0.8
CHUNK_PAGES = 256
TASK_PAGES = 2048  # about so many pages for a task that sorts chunks
HINT_ROWS = 1_000_000  # up to so many rows, a table of hosts or runs is broadcast

#: Elements and marks that never belong to the main text.
DROPPED = frozenset("nav footer aside form noscript template button select iframe svg dialog menu object canvas audio video datalist".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|masthead|comments?|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|widget|pagination|pager|toolbar|login)(?:$|[\s_-])", re.I
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_END = {t: re.compile(f"</{t}", re.I) for t in RAW}


def excluded(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is marked as something other than main text. A header inside an article holds its title."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _MARK.search(value) or name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


ARTICLE, MAIN, PLAIN, MARKED = range(4)


def blocks(page: str | None, whole: bool = True) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: in an article, in <main>, unmarked, or marked as something else. Linear in the page. Not whole: up to the first block in an article or in <main>."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}  # tags on the stack, so that an end tag without a start costs nothing
    piece: list[str] = []
    zone, pos, page = PLAIN, 0, page or ""
    n = len(page)

    def close() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            if text:
                out.append((zone, text))
            piece.clear()

    def cut(k: int) -> None:
        nonlocal zone
        for tag_, _ in stack[k:]:
            opened[tag_] -= 1
        del stack[k:]
        now = stack[-1][1] if stack else PLAIN
        if now != zone:
            close()
            zone = now

    while pos < n and (whole or not out or out[-1][0] > MAIN):
        i = page.find("<", pos)
        if i < 0:
            piece.append(page[pos:])
            break
        if i > pos:
            piece.append(page[pos:i])
        c = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            pos = n if j < 0 else j + 3
            continue
        if c and c in "!?":
            j = page.find(">", i)
            pos = n if j < 0 else j + 1
            continue
        m = _TAG.match(page, i) if c == "/" or c.isalpha() else None
        if m is None:
            if c == "/" or c.isalpha() and c.isascii():
                j = page.find(">", i)
                pos = n if j < 0 else j + 1
            else:
                piece.append("<")
                pos = i + 1
            continue
        pos, tag, attrs = m.end(), m[1].lower(), m[2]
        if c == "/":
            if tag in BLOCK:
                close()
            if opened.get(tag):
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            e = _END[tag].search(page, pos)
            j = page.find(">", e.end()) if e else -1
            pos = n if j < 0 else j + 1
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag in BLOCK:
            close()
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option") or stack and stack[-1][0] == "p":
                if stack and stack[-1][0] in (tag, "p"):
                    cut(len(stack) - 1)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        now = zone
        if zone != MARKED:
            if excluded(tag, attrs, zone in (ARTICLE, MAIN)):
                now = MARKED
            elif tag == "article":
                now = ARTICLE
            elif tag == "main" and zone != ARTICLE:
                now = MAIN
        if tag in BLOCK or now != zone:
            stack.append((tag, now))
            opened[tag] = opened.get(tag, 0) + 1
            if now != zone:
                close()
                zone = now
    close()
    return out


def split(page: str | None) -> tuple[bool, list[str], list[str]]:
    """(whether the page marks its article, the article's blocks or else the unmarked ones, all other blocks)."""
    found = blocks(page)
    zone = min((k for k, _ in found), default=PLAIN)
    zone = zone if zone <= MAIN else PLAIN
    return zone <= MAIN, [t for k, t in found if k == zone], [t for k, t in found if k != zone]


class _Hashes(dict):
    """Hashes of words, kept for up to 200,000 of them."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray) -> np.ndarray:
    """Keys of all runs of DEPTH words, by a polynomial of the words' hashes."""
    n = max(len(h) - DEPTH + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out.view(np.int64)


def run_keys(words: list[str]) -> np.ndarray:
    return rolled(hashes(words))


def among(keys: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which keys are among the runs, which are in order."""
    if not len(runs):
        return np.zeros(len(keys), bool)
    return runs[np.minimum(np.searchsorted(runs, keys), len(runs) - 1)] == keys


_STREAMS = "host string, settled boolean, own array<string>, rest array<string>"


def _streams(batches, undecided: bool):
    """The streams of the pages that are undecided (no marked article, and text outside of marks), or of all others."""
    for b in batches:
        rows = []
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if undecided and any(k <= MAIN for k, _ in blocks(page, whole=False)):
                continue
            settled, own, rest = split(page)
            if (own or rest) and (bool(own) and not settled) == undecided:
                rows.append((host, settled, own, rest))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["host", "settled", "own", "rest"])


class Streams:
    """The concatenated token streams of some pages of a host, and their suffixes in order."""

    def __init__(self, pages: list[tuple[list[str], list[str]]]):
        ids: dict[str, int] = {}
        tokens, page, block = [], [], []
        self.places: list[tuple[int, int, int, list[str]]] = []  # page, first token, end, words of a block of its own
        for p, (own_, rest) in enumerate(pages):
            for own, group in ((True, own_), (False, rest)):
                for text in group:
                    ws = text.split(" ")
                    if own:
                        self.places.append((p, len(tokens), len(tokens) + len(ws), ws))
                    tokens += [ids.setdefault(w, len(ids)) for w in ws]
                    page += [p] * len(ws)
            tokens.append(-1 - p)  # no run goes from one page into the next
            page.append(p)
        self.page = np.array(page, np.int64)
        self.tokens = np.array(tokens, np.int64)
        self.words = list(ids)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix array, rank) by prefix doubling to DEPTH tokens; equal ranks have at least DEPTH tokens in common. Suffixes that reach a page's end are left out."""
        x = self.tokens
        _, rank = np.unique(x, return_inverse=True)
        span = 1
        while span < DEPTH:
            later = np.full(len(rank), -1)
            later[:-span] = rank[span:] if len(rank) > span else later[:-span]
            _, rank = np.unique((rank + 1) * np.int64(len(rank) + 2) + later + 1, return_inverse=True)
            span *= 2
        order = np.argsort(rank, kind="stable")
        ends = np.flatnonzero(x < 0)
        whole = ends[np.searchsorted(ends, np.arange(len(x)))] - np.arange(len(x)) >= DEPTH
        return order[whole[order]], rank, whole

    def runs(self):
        """(first place of each group in the suffix array, its number of pages, the places, the group of each place)."""
        order, rank, _ = self.suffixes()
        if not len(order):
            return order, order, order, order
        new = np.r_[True, rank[order][1:] != rank[order][:-1]]
        group = np.cumsum(new) - 1
        return order[new], self.pages_of(order, group, np.ones(len(order), bool), np.ones(self.page[-1] + 1)), order, group

    def pages_of(self, order: np.ndarray, group: np.ndarray, among: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each group the weight of the pages on which it has a place among those given."""
        n = np.int64(len(self.tokens) + 1)
        pages = np.unique(group[among] * n + self.page[order[among]])
        return np.bincount(pages // n, weight[pages % n].astype(float), group[-1] + 1 if len(group) else 0).astype(np.int64)

    def keys(self, at: np.ndarray) -> list[int]:
        return rolled(hashes(self.words)[np.maximum(self.tokens, 0)])[at].tolist() if len(at) else []


def _candidates(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """The runs of a chunk that reach the shares within it, and a row of the chunk's sizes. A run that reaches a share of a host's pages reaches it in one of its chunks at least, so none is missed."""
    own = t.column("own").to_pylist()
    s = Streams(list(zip(own, t.column("rest").to_pylist(), strict=True)))
    counts, settled = (t.column(c).to_numpy().astype(bool) for c in ("counts", "settled"))
    undecided = counts & ~settled & np.array([bool(x) for x in own])
    inside = np.zeros(len(s.tokens) + DEPTH, bool)
    for p, a, b, _ in s.places:
        inside[a:b] = settled[p]
    first, _, order, group = s.runs()
    sizes = [int(x.sum()) for x in (counts, undecided, settled)]
    least = MIN_PAGES if t.column("chunks")[0].as_py() == 1 else 1
    hit, articles = np.zeros(len(first), bool), np.zeros(len(first), bool)
    if len(first):
        outside = ~inside[order]
        for weight, among, size, share in ((counts, outside, sizes[0], SHARE), (undecided, outside, sizes[1], SHARE), (settled, inside[order + DEPTH - 1], sizes[2], SHARE_ARTICLES)):
            articles = s.pages_of(order, group, among, weight) >= max(least, share * size - 1e-6)
            hit |= articles
    n = int(hit.sum())
    runs = [None, *s.keys(first[hit])]
    more = [pa.array([x] + [None] * n, pa.int64()) for x in sizes]
    return pa.table([pa.array([key[0].as_py()] * (n + 1), pa.string()), pa.array(runs, pa.int64()), pa.array([False, *articles[hit].tolist()], pa.bool_()), *more], names=["host", "run", "articles", "pages", "undecided", "settled"])


def _counts(batches):
    """host, run, and the numbers of pages with it: outside of an article, of these the undecided ones, inside an article, and inside one that counts."""
    sums: dict[tuple[str, int], list[int]] = {}

    def table() -> pa.RecordBatch:
        rows = [(h, r, *c) for (h, r), c in sums.items()]
        sums.clear()
        columns = zip(*rows, strict=True) if rows else ([],) * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["host", "run", "outside", "open", "inside", "once"])

    at, runs = None, np.zeros(0, np.int64)
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("host", "settled", "own", "rest", "counts")]
        for k, (host, settled, own, rest, counts) in enumerate(zip(*columns, strict=True)):
            if not counts and not settled:
                continue
            if host != at:
                at, runs = host, np.sort(np.array(b.column("runs")[k].as_py(), np.int64))
            keys = run_keys(" ".join(own + rest).split(" "))
            hit = among(keys, runs)
            if not hit.any():
                continue
            edge = sum(t.count(" ") + 1 for t in own) if settled else 0
            last = max(edge - DEPTH + 1, 0)
            out, within = set(keys[edge:][hit[edge:]].tolist()), set(keys[:last][hit[:last]].tolist())
            for r in out | within:
                c = sums.setdefault((host, r), [0, 0, 0, 0])
                c[0] += r in out
                c[1] += r in out and not settled and bool(own)
                c[2] += r in within
                c[3] += r in within and counts
            if len(sums) > 200_000:
                yield table()
    yield table()


def uncovered(own: list[str], rest: list[str], often: np.ndarray) -> list[str]:
    """What of a page's own blocks no run of those, which are in order, covers."""
    hit = among(run_keys(" ".join(own + rest).split(" ")), often)
    if not hit.any():
        return own
    edge = np.zeros(len(hit) + DEPTH, np.int64)
    edge[: len(hit)] += hit
    edge[DEPTH:] -= hit
    covered = (np.cumsum(edge) > 0).tolist()
    out, at = [], 0
    for text in own:
        ws = text.split(" ")
        left = [w for w, c in zip(ws, covered[at : at + len(ws)], strict=True) if not c]
        at += len(ws)
        if left:
            out.append(" ".join(left))
    # a page that is repeated as a whole is a copy, not boilerplate
    return out or own


def _texts(batches):
    at, often = None, [np.zeros(0, np.int64)] * 2
    for b in batches:
        texts = []
        for k, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
            if host != at:
                at, often = host, [np.sort(np.array(b.column(c)[k].as_py() or (), np.int64)) for c in ("plain", "articles")]
            settled, own, rest = split(page)
            texts.append("\n".join(uncovered(own, rest, often[settled]) if own and len(often[settled]) else own))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def copies(pages: DataFrame) -> DataFrame:
    """The pages (host, place, own) with `counts`: false for near copies of another page of their host (jaccard.similar_groups of the own text), but for the first of each group."""
    # the host stands in each word, so that pages of two hosts have nothing in common
    text = F.array_join(F.transform(F.split(F.array_join("own", " "), " "), lambda w: F.concat(F.hex(F.xxhash64("host")), w)), " ")
    found = checkpoint(similar_groups(pages.select(F.col("place").alias("doc_id"), text.alias("text"))).where("doc_id <> component_id").select(F.col("doc_id").alias("copy")))
    return pages.join(found, F.col("place") == F.col("copy"), "left").withColumn("counts", F.col("copy").isNull()).drop("copy")


def _hinted(t: DataFrame, size: str = "1") -> DataFrame:
    """A checkpointed table, to be broadcast where it is small: Spark doesn't know the size of a checkpoint."""
    return F.broadcast(t) if (t.agg(F.sum(F.expr(size))).first()[0] or 0) <= HINT_ROWS else t


def boilerplate(p: DataFrame) -> DataFrame:
    """host, plain, articles: the runs that are boilerplate on the host's undecided pages, and in its marked articles. p: host, html."""
    numbered = lambda t: t.withColumn("place", F.monotonically_increasing_id())
    counting = lambda t: t.withColumn("counts", F.lit(True))
    others = lambda t: t.mapInArrow(lambda bs: _streams(bs, False), _STREAMS)
    open_ = checkpoint(numbered(p.mapInArrow(lambda bs: _streams(bs, True), _STREAMS)))
    open_ = counting(open_) if open_.isEmpty() else copies(open_)
    every = counting(numbered(others(p))).unionByName(open_)
    sizes = checkpoint(p.groupBy("host").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK_PAGES).cast("long").alias("chunks")))
    parts = max(partitions(p.sparkSession), (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_PAGES)
    dealt = every.join(_hinted(sizes.drop("n")), "host").withColumn("chunk", F.pmod(F.xxhash64("settled", "place"), F.col("chunks"))).repartition(parts, "host", "chunk")
    found = checkpoint(dealt.groupBy("host", "chunk").applyInArrow(_candidates, "host string, run long, articles boolean, pages long, undecided long, settled long"))
    totals = found.where("run IS NULL").groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "undecided", "settled")))
    wanted = _hinted(checkpoint(found.where("run IS NOT NULL").groupBy("host").agg(F.collect_set("run").alias("runs"), F.bool_or("articles").alias("articles"))), "size(runs)")
    on = lambda of: others(p.join(wanted.where(of).select("host"), "host", "left_semi").select("host", "html"))
    # near copies of an article count once for what is cut in articles
    marked = checkpoint(numbered(on("articles")))
    marked = counting(marked) if marked.isEmpty() else copies(marked)
    counted = counting(on("NOT articles")).unionByName(marked.drop("place")).unionByName(open_.drop("place")).join(wanted, "host")
    counted = counted.select("host", "settled", "own", "rest", "counts", "runs").mapInArrow(_counts, "host string, run long, outside long, open long, inside long, once long")
    sums = counted.groupBy("host", "run").agg(*(F.sum(c).alias(c) for c in ("outside", "open", "inside", "once")))
    singles = marked.groupBy("host").agg(F.count_if(F.col("settled") & F.col("counts")).alias("singles"))
    least = lambda n, share, c: F.greatest(F.lit(n), F.ceil(share * F.col(c))).cast("long")
    host_wide = F.col("outside") >= least(MIN_PAGES, SHARE, "pages")
    plain = host_wide | (F.col("open") >= least(MIN_PAGES, SHARE, "undecided"))
    leaked = (F.col("outside") >= least(MIN_ARTICLES, SHARE, "pages")) & (F.col("outside") >= F.col("inside"))
    everywhere = (F.col("inside") >= least(MIN_ARTICLES, SHARE_ARTICLES, "settled")) & (F.col("once") >= least(MIN_ARTICLES, SHARE_ARTICLES, "singles"))
    often = sums.join(totals, "host").join(singles, "host", "left").select("host", "run", plain.alias("plain"), F.coalesce(leaked | everywhere, F.lit(False)).alias("article"))
    return often.where("plain OR article").groupBy("host").agg(F.expr("collect_list(run) FILTER (WHERE plain)").alias("plain"), F.expr("collect_list(run) FILTER (WHERE article)").alias("articles"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every whole page.

    All text of every page goes through its host's suffix array: blocks in marked articles, unmarked and marked ones. Runs of DEPTH tokens or more that stand,
    outside of marked articles, on a SHARE of the host's pages (or of its undecided pages: those with unmarked text and no marked article), and on MIN_PAGES
    at least, are boilerplate and are cut out of the unmarked blocks of undecided pages. A marked article is checked against the marks: a run is cut there
    if it is boilerplate outside on MIN_ARTICLES pages at least, and on as many as have it in their article, or if a share of SHARE_ARTICLES of the host's articles, and MIN_ARTICLES
    at least, have it inside. What fewer articles share is content. Near copies count as one page: of undecided pages, and of articles for what articles share.

    A host's pages are dealt at random into chunks of about CHUNK_PAGES; each chunk sorts its own suffixes and names the runs that reach a share within it,
    which takes in all that reach it on the host; those are then counted on all pages of the host. So no task holds a whole host, and the runs found are those of the whole host.
    Null and empty html give an empty text; pages without a url are one host; rows that repeat stay.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("host", F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit("")))
    kind = p.schema["page_id"].dataType.simpleString()
    cuts = _hinted(checkpoint(boilerplate(p.select("host", "html"))), "size(plain) + size(articles)")
    texts = p.join(cuts, "host", "left").select("page_id", "url", "html", "host", "plain", "articles").mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
