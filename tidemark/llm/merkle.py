"""Merkle manifest of a dataset, by checkpoint and recompute, in DataFrame expressions.

Every row is a leaf: the digest of its columns.  The leaves of a language stand in the order of doc_id; every ``RUN``
consecutive nodes make one node of the level above until one, the subroot, remains.  Subroots, in the order of their
languages, make the root likewise.  Of all levels only every ``STRIDE``-th is written to the folder of the manifest.  A
proof needs the levels between as well: extraction goes down from the root, and each aligned subtree (the descendants of one
written node on the next lower written level, at most RUN ** STRIDE of them) makes its missing interior nodes anew from the
written ones, gives each descendant the siblings on its way, and forgets them.

No language is gathered or ordered in one task: places come from a range partitioning and the counts of its parts, subtrees
have a bounded size, and a path is a few hundred digests whatever the number of rows.

Defined results: a null doc_id comes first, a null lang first too and apart from an empty one; rows with the same doc_id are
ordered by their digests, so that the root depends on nothing but the rows; a repeated row is a leaf of its own.  A language
with one row has that leaf as its subroot.  An empty table has no root and no proofs.  Columns other than the five that are
hashed pass no further than the leaves.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import broadcast_checked
from tidemark.session import cut, shared_folder

RUN, STRIDE = 8, 3
SPAN = RUN ** STRIDE
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_SIDES = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its length in bytes and itself, so that no two rows read alike."""
    def told(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return digest(F.concat(*(told(v.cast("string")) for v in values)))


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """tree, doc_id, digest and ``more`` (columns made from those of docs): a row per row of docs."""
    lang = F.col("`lang`").cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("tree"), F.col("`doc_id`").cast("long").alias("doc_id"),
                       leaf(*(F.col(f"`{c}`") for c in COLUMNS)).alias("digest"), *(c.alias(n) for n, c in more.items()))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, the place within the tree from 0 on, and n, the rows of the tree.

    Equal rows may be many; the last, meaningless part of the order keeps them from being one range."""
    rows = rows.withColumn("m_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange("tree", *order, "m_tie").sortWithinPartitions("tree", *order, "m_tie").drop("m_tie")
    dealt = cut(dealt.withColumn("m_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("m_id", 33), F.col("m_id").bitwiseAND(F.lit((1 << 33) - 1))
    runs = dealt.groupBy("tree", part.alias("m_part")).agg(F.min(inside).alias("m_first"), F.count(F.lit(1)).alias("m_rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m_rows").over(whole.orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("tree", "m_part", "m_first", before.alias("m_before"), F.sum("m_rows").over(whole).alias("n")))
    rows = dealt.withColumn("m_part", part).join(broadcast_checked(runs, 150), ["tree", "m_part"])
    return rows.withColumn("at", F.col("m_before") + inside - F.col("m_first")).drop("m_id", "m_part", "m_first", "m_before")


def _above(nodes: Column) -> Column:
    """The level above an aligned list of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(nodes, k * RUN + 1, RUN), "")))


def _levels(n: Column) -> Column:
    """How many levels a subtree of a tree with n written nodes rises: until the next written level, or until one node is left."""
    return reduce(lambda least, k: F.when(n <= RUN ** k, k).otherwise(least), reversed(range(STRIDE)), F.lit(STRIDE))


def _subtrees(level: DataFrame) -> DataFrame:
    """tree, block, n, members in order, and l0, l1, ...: the levels of each subtree, empty above the one node that is left."""
    more = [c for c in level.columns if c not in ("tree", "n")]
    out = level.where("n > 1").groupBy("tree", F.floor(F.col("at") / SPAN).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *(c for c in more if c != "at")))).alias("members"))
    out = out.withColumn("rise", _levels(F.col("n"))).withColumn("l0", F.col("members.digest"))
    for k in range(1, STRIDE + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("rise") >= k, _above(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
    return out


def _risen(level: DataFrame) -> DataFrame:
    """The next written level of the trees that have several nodes: tree, at, digest, n."""
    tops = F.coalesce(*(F.get(f"l{k}", F.lit(0)) for k in range(STRIDE, 0, -1)))
    return _subtrees(level).select("tree", F.col("block").alias("at"), tops.alias("digest"), F.ceil(F.col("n") / SPAN).alias("n"))


@dataclass(frozen=True)
class Manifest:
    """The written levels of the trees of all languages (``lang``) and of the tree over them (``top``)."""
    spark: SparkSession
    folder: str

    def heights(self) -> dict[str, int]:
        return {r["part"]: r["levels"] for r in self.spark.read.parquet(f"{self.folder}/heights").collect()}

    def level(self, part: str, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}/{k}")

    def root(self) -> str | None:
        """The root of the dataset; None for an empty one."""
        row = self.level("top", self.heights()["top"] - 1).first()
        return row["digest"] if row else None


def _written(rows: DataFrame, folder: str) -> int:
    """Writes rows (tree, at, digest, n) and every level that is kept above them; how many levels there are."""
    rows.write.parquet(f"{folder}/0")
    k = 0
    while True:
        level = rows.sparkSession.read.parquet(f"{folder}/{k}")
        if (level.agg(F.max("n")).first()[0] or 0) <= 1:
            return k + 1
        k += 1
        _risen(level).write.parquet(f"{folder}/{k}")


def _roots(manifest: Manifest, part: str, levels: int) -> DataFrame:
    """tree, digest: the one node that is left of each tree."""
    return reduce(DataFrame.unionByName, (manifest.level(part, k).where("n = 1").select("tree", "digest") for k in range(levels)))


def build(rows: DataFrame, folder: str) -> Manifest:
    """Writes the manifest of ``leaves`` to a new folder that all executors share."""
    spark, manifest = rows.sparkSession, Manifest(rows.sparkSession, folder)
    heights = {"lang": _written(placed(cut(rows), "doc_id", "digest"), f"{folder}/lang")}
    subroots = _roots(manifest, "lang", heights["lang"]).select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest")
    heights["top"] = _written(placed(cut(subroots), "lang_tree"), f"{folder}/top")
    spark.createDataFrame(list(heights.items()), "part string, levels int").write.parquet(f"{folder}/heights")
    return manifest


def _own_path(i: Column) -> Column:
    """The siblings of member i on its way up to the top of its subtree, those left and those right of it at each level."""
    sides = []
    for k in range(STRIDE):
        at = F.shiftright(i, 3 * k)
        first = F.shiftright(at, 3) * RUN
        nodes = F.col(f"l{k}")
        side = F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"),
                        F.array_join(F.slice(nodes, at + 2, first + RUN - 1 - at), "").alias("right"))
        sides.append(F.when(F.col("rise") > k, F.array(side)).otherwise(F.array().cast(_SIDES)))
    return F.concat(*sides)


def _descended(manifest: Manifest, part: str, levels: int, tops: DataFrame) -> DataFrame:
    """The columns of the lowest level with path and those of ``tops`` (tree, path and more): what stands above each tree."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    paths = None
    for k in reversed(range(levels)):
        level = manifest.level(part, k)
        single = level.where("n = 1").join(tops, "tree")
        if paths is not None:
            upper = paths.select("tree", F.col("at").alias("block"), F.col("path").alias("above"), *more)
            found = _subtrees(level).join(upper, ["tree", "block"])
            found = found.select("tree", "n", *more, F.explode(F.transform("members", lambda m, i: F.struct(
                m.alias("m"), F.concat(_own_path(i), F.col("above")).alias("path")))).alias("found"))
            columns = [f"found.m.{c}" for c in level.columns if c not in ("tree", "n")]
            single = single.unionByName(found.select("tree", "n", *columns, *more, "found.path"))
        paths = single
    return paths


def proofs(manifest: Manifest) -> DataFrame:
    """A row per leaf: doc_id, digest, what else the leaves carry, subroot, root, and path: the siblings (left, right) of
    the node at each level from the leaf to the root."""
    heights, root = manifest.heights(), manifest.root()
    start = manifest.spark.createDataFrame([("", [], root)], f"tree string, path {_SIDES}, root string")
    langs = _descended(manifest, "top", heights["top"], start)
    langs = langs.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return _descended(manifest, "lang", heights["lang"], langs)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(path, node, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row after the query's tampering: lower-cased text where 3 divides the checksum of the id."""
    lower = F.translate(F.col("`text`").cast("string"), _UPPER, _LOWER)
    struck = F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % 3 == 0
    return F.when(struck, leaf(*(lower if c == "text" else F.col(f"`{c}`") for c in COLUMNS)))


def manifest_report(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and the digest of the proof of every row, and whether the row as it claims to be leads to the root."""
    spark = docs.sparkSession
    manifest = build(leaves(docs, claimed=tampered(docs)), f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}")
    found = proofs(manifest).withColumn("folded_root", folded(F.coalesce("claimed", "digest"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE checks AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),
steps AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(s))), lambda c, i:
    CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END) % 2 = 1
         THEN xor((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END) >> 1, 3988292384)
         ELSE (CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END) >> 1 END) AS reg FROM checks),
texts AS (SELECT *, CASE WHEN xor(reg, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS said FROM steps),
heads AS (SELECT doc_id, lang, text, said,
    coalesce(octet_length(encode(s)) || ':' || s, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM texts),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(said)) || ':' || said, '-')) AS claimed FROM heads),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, level AS height FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT h AS root FROM tops WHERE n = 1),
lists AS (SELECT lang, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_lists AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.lang, l.leaf, l.pos AS place, 0 AS level, l.pos, false AS up, s.height, l.claimed AS node, '' AS proof
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place, CASE WHEN w.level = w.height AND NOT w.up THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.level = w.height AND NOT w.up THEN s.pos ELSE w.pos // 8 END, w.up OR w.level = w.height, w.height,
    CASE WHEN w.level = w.height AND NOT w.up THEN w.node
         ELSE sha256(array_to_string(coalesce(t.hs, r.hs)[1:w.pos % 8], '') || w.node || array_to_string(coalesce(t.hs, r.hs)[w.pos % 8 + 2:], '')) END,
    CASE WHEN w.level = w.height AND NOT w.up THEN w.proof
         ELSE w.proof || array_to_string(coalesce(t.hs, r.hs)[1:w.pos % 8], '') || array_to_string(coalesce(t.hs, r.hs)[w.pos % 8 + 2:], '') END
  FROM walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN lists r ON NOT w.up AND w.lang IS NOT DISTINCT FROM r.lang AND w.level = r.level AND w.pos // 8 = r.run
  LEFT JOIN top_lists t ON w.up AND w.level = t.level AND w.pos // 8 = t.run
  WHERE NOT w.up OR t.hs IS NOT NULL),
ends AS (SELECT * FROM walk w WHERE up AND level = (SELECT max(level) FROM tops))
SELECT e.doc_id, e.leaf, s.h AS subroot, root.root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = root.root AS verified
FROM ends e JOIN subroots s ON e.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
"""
