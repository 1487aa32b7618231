"""Merkle manifest, spelling variants and nearest neighbours against brute force, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runweave.llm import embeddings, hashing, jaccard, merkle, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ", leaf string, tree int, idx string, word string, n int, v int, q string, place int"


def same(got, want):
    return sorted(got, key=repr) == sorted(want, key=repr)


# --- 11 --------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(leaves):
    """The top of a tree and for each leaf its runs and slots on the way there."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, way in enumerate(ways):
            start = at[i] // 8 * 8
            way.append((level[start : start + 8], at[i] - start))
            at[i] //= 8
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], ways


def manifest(rows):
    langs = defaultdict(list)
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        leaf = h(*map(framed, r))
        langs[r[2]].append((r[0], leaf, h(*map(framed, r[:4]), framed(r[4] and r[4].translate(LOWER))) if touched else leaf))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climbed([r[1] for r in langs[x]]) for x in order]
    root, tops = climbed([t[0] for t in trees]) if trees else (None, [])
    for x, (sub, ways), top in zip(order, trees, tops, strict=True):
        for (doc, leaf, folded), way in zip(langs[x], ways, strict=True):
            proof = []
            for run, k in way + top:
                proof += run[:k] + run[k + 1 :]
                folded = h(*run[:k], folded, *run[k + 1 :])
            yield doc, leaf, sub, root, h(*proof), folded, folded == root


MANIFEST = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def test_merkle_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.manifest(docs).select(*MANIFEST).collect()
    want = list(manifest(map(tuple, docs.select(*merkle.COLUMNS).collect())))
    assert same(map(tuple, got), want) and 0 < sum(r[-1] for r in want) < len(want)


def test_merkle_of_odd_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(1, "A", "x", None, 3)] * 3 + [(None, "Aé", None, "s", None), (None, None, None, None, None), (3, None, "y", "", 3), (4, "B" * 200_000, "y", "", 3), (6, "", "Y", "", 3)]
    rows += [(rng.randrange(400), rng.choice(["Q", "q", "\U0001f600"]), rng.choice(["hot"] * 40 + [f"l{k}" for k in range(20)]), "s", k) for k in range(900)]
    docs = spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int{CLASHES}")
    got = merkle.manifest(docs).select(*MANIFEST).collect()
    assert same(map(tuple, got), manifest((d, s, x, n, t) for d, t, x, s, n in rows))


def test_merkle_of_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "A", "x", None, 3)], "doc_id long, text string, lang string, source string, n_chars int")
    (one,) = merkle.manifest(docs).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h()
    assert merkle.manifest(docs.where("false")).select(*MANIFEST).collect() == []
    before = spark.conf.get(merkle.ROW_LIMIT, None)
    merkle.manifest(docs)
    assert spark.conf.get(merkle.ROW_LIMIT, None) == before


# --- 12 --------------------------------------------------------------------------------------


def spellings(rows):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            x = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if x % 31 == 0:
                w = w[: x % len(w)] + w[x % len(w) + 1 :]
            counts[w] += len(w) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            holes[i, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    forms = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    forms = {w: f if f and words[f] >= 10 * words[w] else None for w, f in forms.items()}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        yield w, n, len(near[w]), forms[w], words.get(forms[w]), root


SPELLING = "word", "n", "n_near", "form", "form_n", "root"


@pytest.mark.parametrize("most", [spelling.MOST, 20])
def test_spelling_against_brute_force(spark, most):
    """Also with partitions so small that beginnings are parted again and again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = list(spellings(map(tuple, docs.select("doc_id", "text").collect())))
    assert sum(r[2] for r in want) > 500
    assert same(map(tuple, spelling.variants(docs, most=most).select(*SPELLING).collect()), want)


def test_spelling_chains_and_odd_rows(spark):
    chain = "zebrawort " * 1200 + "zebrawart " * 110 + "zebrwart " * 10 + "xebrwart "
    rows = [(None, "abcdefgh abcdefgh"), (1, None), (2, ""), (3, chain), (4, "aaaaaaa aaaaaaaa aaaaaaaaa Ünbekannt ünbekannt" + " unbekannt" * 30), (5, ("q" * 5000 + " ") * 3 + ("q" * 5001 + " ") * 3 + ("q" * 2500 + "r" + "q" * 2499 + " ") * 3)] * 2
    docs = spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"doc_id long, text string{CLASHES}")
    want = list(spellings(rows))
    got = spelling.variants(docs).select(*SPELLING).collect()
    assert same(map(tuple, got), want)
    roots = {r.word: r.root for r in got}
    assert roots["xebrwart"] == roots["zebrwart"] == "zebrawort" and roots["ünbekannt"] == "unbekannt"
    assert spelling.variants(docs.where("false")).collect() == []


def test_composition_of_drawn_words():
    rng = random.Random(5)
    words = sorted({"pre" + "".join(rng.choice("aab") for _ in range(rng.randint(0, 7))) for _ in range(150)})
    at = spelling.Acceptor(words)
    assert sorted(at.words(at.start)) == words
    assert len({(f, *a.items()) for f, a in zip(at.final, at.arcs, strict=True)}) == len(at.arcs)

    def apart(x, y):
        holes = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
        return x in holes(y) or y in holes(x) or len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) == 1

    got = [tuple(sorted(p)) for p in spelling.from_start(words, "pre")]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x, y in itertools.combinations(words, 2) if apart(x, y)}


# --- 13 --------------------------------------------------------------------------------------


def neighbours(ids, vectors, every=20, count=20):
    """(query row, its nearest rows by score and id) by comparing with all rows."""
    for k in np.flatnonzero(ids % every == 0):
        score = (vectors * vectors[k]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:count]
        yield int(ids[k]), [(int(ids[j]), float(score[j])) for j in order]


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want) / sum(len(w) for _, w in want)


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0, *[None] * 8) for i, v in zip(ids, vectors, strict=True)], f"vec_id long, embedding array<double>, label int{CLASHES}")


def test_recall_on_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = found(hashing.nearest(e, block=300))
    want = list(neighbours(ids, x))
    assert {len(got[q]) for q, _ in want} == {20} and recall(got, want) >= 0.95
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(abs(s - float(at[q] @ at[v])) < 1e-12 for q in got for v, s in got[q])


def test_lengths_count_for_inner_products(spark):
    """Vectors of different length, in clusters, so that angles alone give other neighbours."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((40, 12))[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 12))) * rng.uniform(0.2, 3, (3000, 1))
    ids = rng.permutation(3000)
    got = found(hashing.nearest(frame(spark, ids, x), every=60))
    assert recall(got, list(neighbours(ids, x, 60))) >= 0.9


def test_codes_within_a_radius_are_all_found(spark):
    """The pigeonhole holds: with a given radius, exactly the codes within it are looked at."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = codes[:20] ^ np.uint64(0b1011 << 14)
    for radius in range(12):
        within = hashing.reach(radius)
        for a in near:
            apart = np.bitwise_count(codes ^ a)
            by_piece = np.bitwise_count(hashing.pieces(codes) ^ hashing.pieces(np.array([a]))) <= np.array(within)
            assert by_piece.any(axis=1)[apart <= radius].all()


def test_odd_vectors(spark):
    same_vector = [1.0, 2.0, 0.5]
    rows = [(20 * k, same_vector) for k in range(60)] + [(20 * k + 1, same_vector) for k in range(60)] + [(1200 + k, [float(k % 5), 1.0, float(k % 3)]) for k in range(90)]
    bad = [(5000, None), (5020, [0.0, 0.0, 0.0]), (5040, [float("nan"), 1.0, 1.0]), (5060, [float("inf"), 1.0, 1.0]), (5080, [None, 1.0, 1.0]), (5100, []), (None, same_vector), (5120, [9.0] * 4), (5121, [1.0] * 4)]
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows + bad], f"vec_id long, embedding array<double>{CLASHES}")
    got = found(hashing.nearest(df, block=16))
    want = list(neighbours(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))
    assert {k: v for k, v in got.items() if k < 5000} == dict(want)
    assert got[5120] == [(5121, 36.0)] and {k for k in got if k >= 5000} == {5120}
    assert hashing.nearest(df.where("false")).collect() == [] and hashing.nearest(df.where("vec_id = 20")).collect() == []


# --- rows that share an id -------------------------------------------------------------------


def test_vectors_that_share_an_id(spark):
    """Two vectors under one id link with what is near each of them, and with nothing else."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [-1.0, 0.0]), (0, [0.1, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = [(0, 2, 0), (1, 1, 1), (1, 2, 0), (2, 1, 1), (3, 2, 0), (4, 0, 4)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (4, "other words here"), (None, a), (2, f"{a} x")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert same([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], [(1, 56, 1), (1, 56, 1), (2, 57, 1), (2, 57, 1), (3, 57, 1), (4, 1, 4), (None, 56, None)])
    low = jaccard.similar_groups(spark.createDataFrame([(5, a), (5, b), (3, f"{b} y"), (9, f"{a} x")], "doc_id long, text string"))
    assert same([(r.doc_id, r.component_id) for r in low.collect()], [(5, 3), (3, 3), (5, 5), (9, 5)])
