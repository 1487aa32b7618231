"""Merkle manifest of a dataset: levels built by Spark, stored as parent-linked rows, climbed by a recursive query.

A manifest is a folder: `leaves` (one row per document), `nodes` (one row per inner node and block of leaves below it) and
`trees` (one row per lang). A node holds the digests of its run, and where its own digest stands: the node above and the slot in it.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path

FAN, WIDTH = 8, 32
#: Leaves that share copies of their ancestors: rows of one block meet in a join, never all rows of the root.
BLOCK = 4096
#: The tree over the subroots; the trees over leaves are numbered from 0.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def framed(c: Column) -> Column:
    """A value as it enters a hash: its length in bytes, a colon and itself; `-` if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def text(digests: Column) -> Column:
    """Digests in a row as hex text."""
    return F.lower(F.hex(digests))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, folded: each row's digest, and that of the row as tampered with (the same where nobody did)."""

    def of(value: Column) -> Column:
        return digest(F.concat(*(framed(F.col(c)) for c in COLUMNS[:-1]), framed(value)))

    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = of(F.col("text"))
    return docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(touched, of(F.translate("text", UPPER, LOWER))).otherwise(leaf).alias("folded"))


def placed(rows: DataFrame, group: str, order: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """rows with tree (groups numbered from 0, null first) and idx (from 0 in the group, by order), and the groups: group, tree, size.

    Rows are dealt by ranges, numbered inside a range and shifted by what earlier ranges hold of the group, so a group of any size
    is spread over all tasks. Rows alike in all columns come in any order. Only the table of groups and ranges is in one window.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path).withColumn("range", F.shiftright("at", 33))
    ranges = dealt.groupBy(group, "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    groups = ranges.groupBy(group).agg(F.sum("n").alias("size")).withColumn("tree", F.row_number().over(W.orderBy(F.col(group).asc_nulls_first())).cast("long") - 1)
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = groups.select(F.col(group).alias("named"), "tree")
    starts = ranges.withColumn("shift", earlier - F.col("first")).join(numbered, F.col(group).eqNullSafe(F.col("named"))).select("named", F.col("range").alias("in_range"), "shift", "tree")
    found = dealt.join(starts, F.col(group).eqNullSafe(F.col("named")) & (F.col("range") == F.col("in_range")))
    return found.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "named", "in_range", "shift"), groups


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree of that many."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(FAN)), k) < size))


def linked(tree: Column, level: Column, idx: Column, last: Column, top_depth: int) -> list[Column]:
    """Where the node (tree, level, idx) of a tree of `last` levels stands: up_tree, up_level, up_run and slot; nulls at the root."""
    inside, over = level < last, (tree != TOP) & F.lit(top_depth > 0)
    place = F.when(inside, idx).when(over, tree)
    return [
        F.when(inside, tree).when(over, F.lit(TOP).cast("long")).alias("up_tree"),
        F.when(inside, level + 1).when(over, F.lit(1)).cast("int").alias("up_level"),
        F.floor(place / FAN).cast("long").alias("up_run"),
        (place % FAN).cast("int").alias("slot"),
    ]


def levels(bottom: DataFrame, most: int, path: str, depths: DataFrame | None = None) -> list[DataFrame]:
    """From (tree, idx, digest), the levels above as (tree, level, idx, run, digest): run joins the digests of eight nodes below, in order.

    depths: tree, depth, where trees differ in it.
    """
    out, below = [], bottom.select("tree", "idx", "digest")
    for level in range(1, most + 1):
        if depths is not None:
            below = below.join(depths.where(F.col("depth") >= level).select("tree"), "tree", "left_semi")
        one = below.groupBy("tree", F.floor(F.col("idx") / FAN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("of"))
        one = one.withColumn("run", F.reduce(F.col("of")["digest"], F.lit(b""), lambda a, b: F.concat(a, b)))
        one = one.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), "run", digest(text(F.col("run"))).alias("digest"))
        one.write.parquet(f"{path}/{level}")
        out.append(bottom.sparkSession.read.parquet(f"{path}/{level}"))
        below = out[-1]
    return out


def written(docs: DataFrame, folder: str) -> str:
    """Writes the manifest of docs into folder (shared by all executors) and returns folder.

    Per lang, leaves ascend by doc_id (null first; rows of one doc_id by digest), and runs of eight become their digest until one is
    left, the subroot; subroots, ordered by lang (null first), likewise give the root. Null fields hash as `-`; a null doc_id is never
    tampered with. Rows that repeat are leaves of their own. Columns besides the five are no part of a leaf. Langs are expected to be
    few: they, but not their rows, are numbered in one task.
    """
    spark = docs.sparkSession
    leaf_rows(docs).write.parquet(f"{folder}/hashed")
    rows, groups = placed(spark.read.parquet(f"{folder}/hashed"), "lang", ["doc_id", "leaf"], f"{folder}/sorted")
    groups.withColumn("depth", depth(F.col("size"))).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    most, count = groups.agg(F.max("depth"), F.count("*")).first()
    top_depth = next(k for k in range(99) if FAN**k >= count) if count else 0
    held = rows.join(groups.select(F.col("tree").alias("t"), "depth"), F.col("tree") == F.col("t")).drop("t")
    home = (F.shiftleft("tree", 38) + F.floor(F.col("idx") / BLOCK)).alias("home")
    link = linked(F.col("tree"), F.lit(0), F.col("idx"), F.col("depth"), top_depth)
    held.select("doc_id", "lang", "tree", "idx", "leaf", "folded", home, *link).write.parquet(f"{folder}/leaves")
    bottom = spark.read.parquet(f"{folder}/leaves")

    built = levels(bottom.select("tree", "idx", F.col("leaf").alias("digest")), most or 0, f"{folder}/levels", groups.select("tree", "depth"))
    tips = reduce(DataFrame.unionByName, [bottom.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")), *(b.select("tree", "level", "idx", "digest") for b in built)])
    tips = tips.join(groups.select("tree", F.col("depth").alias("level")), ["tree", "level"]).select("tree", F.col("digest").alias("subroot"))
    groups.join(tips, "tree").write.parquet(f"{folder}/trees")
    trees = spark.read.parquet(f"{folder}/trees")
    tops = levels(trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")), top_depth, f"{folder}/tops")

    # each block of leaves gets copies of its ancestors, so that no join key has more rows than a block
    homes = bottom.select("home", F.col("tree").alias("of"), F.floor(F.col("idx") / BLOCK).cast("long").alias("block")).distinct()
    depths = groups.select(F.col("tree").alias("t"), "depth")
    parts = []
    for k, one in enumerate(built, 1):
        span = FAN**k // BLOCK
        key = F.floor(F.col("block") / span) == F.col("idx") if span > 1 else F.col("block") == F.floor(F.col("idx") * FAN**k / BLOCK)
        up = linked(F.col("tree"), F.col("level"), F.col("idx"), F.col("depth"), top_depth)
        parts.append(homes.join(one, (F.col("of") == F.col("tree")) & key).join(depths, F.col("tree") == F.col("t")).select("home", "tree", "level", F.col("idx"), "run", *up))
    for k, one in enumerate(tops, 1):
        up = linked(F.col("tree"), F.col("level"), F.col("idx"), F.lit(top_depth), top_depth)
        parts.append(homes.join(one, F.floor(F.col("of") / FAN**k) == F.col("idx")).select("home", "tree", "level", "idx", "run", *up))
    empty = spark.createDataFrame([], "home long, tree long, level int, idx long, run binary, up_tree long, up_level int, up_run long, slot int")
    reduce(DataFrame.unionByName, parts, empty).write.parquet(f"{folder}/nodes")
    return folder


@contextmanager
def unlimited(spark: SparkSession):
    """Recursive queries stop at a million rows unless this is lifted; it's put back after."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


CLIMB = f"""
WITH RECURSIVE climb(tree, idx, home, step, folded, siblings, up_tree, up_level, up_run, slot) AS (
  SELECT tree, idx, home, 0, folded, CAST('' AS BINARY), up_tree, up_level, up_run, slot FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.idx, c.home, c.step + 1,
         unhex(sha2(lower(hex(concat(substring(n.run, 1, {WIDTH} * c.slot), c.folded, substring(n.run, {WIDTH} * (c.slot + 1) + 1)))), 256)),
         concat(substring(n.run, 1, {WIDTH} * c.slot), substring(n.run, {WIDTH} * (c.slot + 1) + 1)),
         n.up_tree, n.up_level, n.up_run, n.slot
  FROM climb c JOIN {{nodes}} n ON n.home = c.home AND n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_run)
SELECT * FROM climb"""


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each leaf of a manifest; an empty manifest gives no rows.

    A recursive query climbs from all leaves at once, a level a step: it appends the siblings of the node and folds the tampered digest
    with them. A step's rows stay apart until the end, so that a proof is moved twice, not once a level.
    """
    leaves, trees = spark.read.parquet(f"{folder}/leaves"), spark.read.parquet(f"{folder}/trees")
    root = trees.where("tree = 0").select("subroot").first()
    tops = spark.read.parquet(f"{folder}/nodes").where(f"tree = {TOP} AND up_tree IS NULL").select(digest(text(F.col("run"))).alias("root")).first()
    root = tops[0] if tops else root[0] if root else b""
    with unlimited(spark):
        steps = spark.sql(CLIMB, leaves=leaves, nodes=spark.read.parquet(f"{folder}/nodes"))
        of = F.array_sort(F.collect_list(F.struct("step", "siblings")))["siblings"]
        proofs = steps.groupBy("tree", "idx").agg(of.alias("of"), F.max_by("folded", "step").alias("folded_root"))
        proofs = proofs.select("tree", "idx", "folded_root", F.sha2(text(F.reduce("of", F.lit(b""), lambda a, b: F.concat(a, b))), 256).alias("proof_sha256"))
        path = f"{folder}/{fresh_path(spark, 'proofs').rsplit('/', 1)[-1]}"
        proofs.write.parquet(path)
    out = leaves.join(spark.read.parquet(path), ["tree", "idx"]).join(trees.select("tree", "subroot"), "tree")
    return out.select("doc_id", text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), F.lit(bytes(root).hex()).alias("root"), "proof_sha256", text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.lit(bytearray(root))).alias("verified"))


def manifest(docs: DataFrame) -> DataFrame:
    """Builds the manifest of docs in a new shared folder and verifies each row against it."""
    spark = docs.sparkSession
    return verified(spark, written(docs, fresh_path(spark, "merkle")))


#: crc32 of small byte lists, and digests of runs of eight, in DuckDB.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))"""
CRC_TABLE = """SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) t(i)"""


def _framed(e: str) -> str:
    return f"coalesce(concat(strlen(CAST({e} AS VARCHAR)), ':', CAST({e} AS VARCHAR)), '-')"


_HEAD = ", ".join(_framed(c) for c in COLUMNS[:-1])
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT *, sha256(concat({_HEAD}, {_framed("text")})) AS leaf, sha256(concat({_HEAD}, {_framed(f"translate(text, '{UPPER}', '{LOWER}')")})) AS other,
             coalesce(xor({CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)")}, 4294967295) % 3 = 0, false) AS touched
      FROM documents, crc),
l AS (SELECT doc_id, lang, leaf, CASE WHEN touched THEN other ELSE leaf END AS folded, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM d),
up(tree, level, idx, digest, size) AS (
  SELECT tree, 0, idx, leaf, size FROM l
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 7) // 8) FROM up WHERE size > 1 GROUP BY tree, idx // 8),
subs AS (SELECT tree, digest AS subroot, count(*) OVER () AS size FROM up WHERE size = 1),
high(level, idx, digest, size) AS (
  SELECT 0, tree, subroot, size FROM subs
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 7) // 8) FROM high WHERE size > 1 GROUP BY idx // 8),
nodes AS (SELECT tree, level, idx, digest FROM up WHERE size > 1 UNION ALL SELECT -1, level, idx, digest FROM high WHERE size > 1),
runs AS (SELECT tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM nodes GROUP BY ALL),
steps AS (
  SELECT l.tree, l.idx, r.level AS step, digests, (l.idx // (8 ** r.level)::BIGINT) % 8 AS slot FROM l JOIN runs r ON r.tree = l.tree AND r.run = l.idx // (8 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.idx, 1000 + r.level, digests, (l.tree // (8 ** r.level)::BIGINT) % 8 FROM l JOIN runs r ON r.tree = -1 AND r.run = l.tree // (8 ** (r.level + 1))::BIGINT),
paths AS (SELECT tree, idx, list({{'left': list_aggregate(digests[:slot], 'string_agg', ''), 'right': list_aggregate(digests[slot + 2:], 'string_agg', '')}} ORDER BY step) AS path FROM steps GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, folded_root, folded_root = root AS verified,
       sha256(coalesce(list_aggregate(list_transform(path, lambda p: concat(p['left'], p['right'])), 'string_agg', ''), '')) AS proof_sha256
FROM (SELECT *, coalesce(list_reduce(list_prepend(folded, list_transform(path, lambda p: concat(p['left'], '|', p['right']))), lambda f, p: sha256(replace(p, '|', f))), folded) AS folded_root
      FROM l LEFT JOIN paths USING (tree, idx)) JOIN subs USING (tree), (SELECT digest AS root FROM high WHERE size = 1)"""
