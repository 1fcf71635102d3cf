"""Source divergence audit: how far the vocabularies of a language's sources lie apart, by a partitioned cube.

Terms are counted per source, and a language keeps the terms that enough of its documents hold.  The work is the cube (source,
source, term).  Sources are dealt to blocks of about ``SOURCES``, kept terms to blocks of about ``TERMS``.  What a source counts
on one block of terms is a slice, and every slice is copied to the cells (source block, source block, term block) that need
it.  A cell is a task's work: it computes the part of the divergence that its terms give to each of its pairs, and, on the
diagonal, the most telling terms of its sources.  Parts are summed, or merged, along the term axis.

A cell's input is bounded by SOURCES x TERMS counts whatever the corpus holds; a source with a third of all rows is as many
slices as any other.  Counting sums inside tasks first and meets in a map-side aggregation, so a term that all documents
share is a row per task.

All numbers are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) for N counted and V kept terms, and the divergence of
a term is floor((p - q)^2 / (p + q)).  They are exact as long as a source counts less than 9 x 10^15 terms.

Defined results: null text, lang and source are empty strings; repeated rows and rows that share an id are documents of
their own; a source without terms has a row for every other source of its language, and so has one whose language keeps no term,
with value 0; the only source of a language has no pairs.  Ties are ranked by the item's bytes.  An empty table has no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import broadcast_checked
from tidemark.session import cut

#: Documents that must hold a term; the terms that are listed for a source.
HOLDERS, LISTED = 10, 10
SOURCES, TERMS = 32, 2048
UNIT, PRIOR = 10 ** 9, 2

#: Terms that a task counts before it hands them on, and the bytes of text that are split at a time.
HELD, PIECE = 400_000, 1 << 20
_NOT = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _NOT else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of bounded size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in _NOT:   # a piece ends between terms
            end += 1
        yield text[at:end].translate(_TABLE).split(b" ")
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each source says each term, and in how many documents; a row without a term for each source that occurs."""
    total: dict[tuple, Counter] = defaultdict(Counter)
    held: dict[tuple, Counter] = defaultdict(Counter)
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in total.items():
            counts.pop(b"", None)
            docs = held[lang, source]
            n = len(counts) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([*counts, None], pa.binary()).cast(pa.string()),
                pa.array([*counts.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, counts), 0], pa.int64())], ["lang", "source", "term", "n", "docs"])
        total.clear()
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, seen = total[lang, source], set()
            size -= len(counts)
            for found in terms_of(text):
                counts.update(found)
                seen.update(found)
            held[lang, source].update(seen)
            size += len(counts)
            if size > HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents; each source has a row with a null term too."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(said("lang").alias("lang"), said("source").alias("source"), said("text").cast("binary").alias("text"))
    return rows.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _block(of: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of), blocks).cast("int")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT (count + PRIOR) / total) without any number over 1000 x total."""
    rest, out = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64)
    if total >= 9 * 10 ** 15:
        raise OverflowError("a source counts more terms than these integers hold")
    out = rest // total
    rest = rest % total
    for _ in range(3):   # UNIT is 1000 cubed
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_PARTS = "lang string, source string, item string, term_block int, term_no int, value long"


def _cell(key: tuple, slices: pa.Table) -> pa.Table:
    """Parts of all pairs between the cell's two blocks of sources; on the diagonal also the LISTED best terms of each."""
    lang, low, high, term_block = (k.as_py() for k in key)
    rows = sorted(slices.to_pylist(), key=lambda r: (r["block"], r["source"]))
    p = np.empty((len(rows), rows[0]["width"] if rows else 0), np.int64)
    out: list[tuple] = []
    for k, r in enumerate(rows):
        no, n, total = (np.array(r[c], np.int64) for c in ("no", "n", "total"))
        mass, every = r["counted"] + PRIOR * r["kept"], r["lang_counted"] + PRIOR * r["kept"]
        dense = np.zeros(p.shape[1], np.int64)
        dense[no] = n
        p[k] = shares(dense, mass) if len(dense) else dense
        if low == high and len(no):
            own, whole = p[k][no], shares(total, every)
            value, at = divergence(own, whole)[own > whole], no[own > whole]
            best = np.lexsort((at, -value))[:LISTED]
            out += [(r["source"], None, int(at[b]), int(value[b])) for b in best]
    first = [k for k, r in enumerate(rows) if r["block"] == low]
    for k in first:
        others = range(k + 1, len(rows)) if low == high else [j for j, r in enumerate(rows) if r["block"] == high]
        if len(others):
            value = divergence(p[others[0]:others[-1] + 1], p[k]).sum(1)
            for j, v in zip(others, value.tolist(), strict=True):
                a, b = rows[k]["source"], rows[j]["source"]
                out += [(a, b, None, v), (b, a, None, v)]
    source, item, no, value = zip(*out, strict=True) if out else ((), (), (), ())
    n = len(out)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()),
                     "term_block": pa.array([term_block] * n, pa.int32()), "term_no": pa.array(no, pa.int32()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for every source the divergence from each other one of its language (pair), and
    the LISTED terms that tell it most from the language as a whole (term)."""
    counts = cut(term_counts(docs))
    words = counts.where("term IS NOT NULL")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= HOLDERS)
    vocabulary = cut(vocabulary.select("lang", "term", "total"))
    groups = counts.where("term IS NULL").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_counted")), "lang", "left")
    blocks = lambda c, per: F.greatest(F.lit(1), F.ceil(F.col(c) / per)).cast("int")
    langs = cut(langs.fillna(0, ["kept", "lang_counted"]).withColumn("source_blocks", blocks("sources", SOURCES)).withColumn("term_blocks", blocks("kept", TERMS)))
    langs = broadcast_checked(langs, 200)
    # the terms of a block have numbers in the order of their bytes
    numbered = vocabulary.join(langs.select("lang", "term_blocks"), "lang").withColumn("term_block", _block(F.col("term"), F.col("term_blocks")))
    number = F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term")) - 1
    numbered = cut(numbered.select("lang", "term", "total", "term_block", number.alias("no")))
    width = numbered.groupBy("lang", "term_block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    entry = F.struct("no", "n", "total")
    kept = cut(words.join(numbered, ["lang", "term"]).groupBy("lang", "source", "term_block").agg(F.collect_list(entry).alias("entries"), F.sum("n").alias("in_block")))
    counted = kept.groupBy("lang", "source").agg(F.sum("in_block").alias("counted"))
    # a slice for every source and block of terms, also where it counts nothing
    every = groups.join(counted, ["lang", "source"], "left").join(langs, "lang")
    every = every.withColumn("block", _block(F.col("source"), F.col("source_blocks"))).withColumn("term_block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    slices = every.join(kept.drop("in_block"), ["lang", "source", "term_block"], "left").join(width, ["lang", "term_block"], "left")
    listed = lambda c: F.coalesce(F.col(f"entries.{c}"), F.array()).alias(c)
    slices = slices.select("lang", "source", "block", "source_blocks", "term_block", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("counted", F.lit(0)).alias("counted"),
                           "kept", "lang_counted", listed("no"), listed("n"), listed("total"))
    cells = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)))
    cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    parts = cut(cells.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, _PARTS))
    pairs = parts.where("item IS NOT NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    telling = parts.where("item IS NULL").join(numbered, (parts["lang"] == numbered["lang"]) & (parts["term_block"] == numbered["term_block"]) & (parts["term_no"] == numbered["no"]))
    telling = telling.select(parts["lang"], "source", F.col("term").alias("item"), "value")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", order)
    telling = telling.withColumn("part", F.lit("term")).withColumn("rank", order).where(F.col("rank") <= LISTED)
    return pairs.select(*columns).unionByName(telling.select(*columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
voc AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM voc GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN voc USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
dense AS (SELECT g.lang, g.source, voc.term, coalesce(cnt.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (coalesce(own.n, 0) + 2 * size.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (voc.total + 2)) // (size.n + 2 * size.v)::HUGEINT AS q
  FROM grp g JOIN voc USING (lang) JOIN size USING (lang) LEFT JOIN own USING (lang, source) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = voc.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE c > 0 AND p > q),
out AS (SELECT lang, source, 'pair' AS part, item, value FROM allpairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
