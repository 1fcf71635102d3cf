"""Top-k retrieval: a sharded inverted index whose blocks carry the most that they can contribute.

Passages are dealt to shards and queries to blocks, both in numbers that follow their bytes; a task owns a cell (shard, block
of queries).  It indexes its passages by the terms that its queries use: postings in passage order, in blocks of ``BLOCK``
passages, each with its largest impact.  For a query these maxima bound what any passage of a block can score.  Blocks are
scored in the order of their bounds, and once the k-th score so far is above the next bound, all others are skipped.  A cell
returns k rows a query, so what meets is queries x k x shards, however many passages match.

Queries that ask the same are searched once, and with sections, of passages that hold the same only the first are searched:
where queries and passages grow together, by copies or from few words, their product does not.

Sections that a query names are found in the cell as well: by their numbers, and by the rarest word of their titles among
the shard's titles.  Their passages gain the boost, and so do the bounds of the blocks that hold them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import require_columns, tokens
from tidemark.operators.scan import input_bytes
from tidemark.session import cut

# The constants of the score, the boost of a named section, the discount of a table of contents.
K1, B, BM25_SCALE = 1.2, 0.75, 2.2
SECTION_BOOST, TOC_FACTOR = 20.0, 0.2

SHARD_BYTES, QUERY_BYTES = 64 << 20, 8 << 20
BLOCK = 64
FIRST = 4      # blocks that are scored before a bound is compared; twice as many each time
CLOSE = 1e-9   # scores that differ by less are ties


class Index:
    """A shard's postings for the terms of some queries."""

    def __init__(self, passages: pa.Table, terms: pa.Array, idf: np.ndarray, average: float):
        self.n = passages.num_rows
        words = passages["words"].combine_chunks()
        owner = np.repeat(np.arange(self.n), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        term = pc.index_in(words.flatten(), value_set=terms)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        pair, tf = np.unique(term.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64) * self.n + owner[known], return_counts=True)
        term, self.passage = pair // max(1, self.n), pair % max(1, self.n)
        length = passages["length"].to_numpy()[self.passage]
        self.impact = idf[term] * tf * BM25_SCALE / (tf + K1 * (1 - B + B * length / average))
        self.blocks = -(-self.n // BLOCK)
        cell = term * max(1, self.blocks) + self.passage // BLOCK
        self.start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        self.end = np.r_[self.start[1:], len(cell)]
        self.most = np.maximum.reduceat(self.impact, self.start) if len(cell) else np.empty(0)
        self.block = cell[self.start] % max(1, self.blocks)
        self.of_term = np.searchsorted(cell[self.start] // max(1, self.blocks), np.arange(len(terms) + 1))

    def entries(self, terms: np.ndarray) -> np.ndarray:
        return _ranges(self.of_term[terms], self.of_term[terms + 1])

    def bounds(self, entries: np.ndarray) -> np.ndarray:
        return np.bincount(self.block[entries], self.most[entries], self.blocks).astype(float)

    def scores(self, entries: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        some = np.zeros(self.blocks, bool)
        some[blocks] = True
        entries = entries[some[self.block[entries]]]
        at = _ranges(self.start[entries], self.end[entries])
        return np.bincount(self.passage[at], self.impact[at], self.n)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - start
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class Titles:
    """Which of a shard's sections a query names."""

    def __init__(self, sections: list[str], numbers: list[str], titles: list[list[str]]):
        self.by_number: dict[str, list[int]] = defaultdict(list)
        self.by_title: dict[frozenset, list[int]] = defaultdict(list)
        for code, (section, number, title) in enumerate(zip(sections, numbers, titles, strict=True)):
            if section:
                self.by_number[number].append(code)
                self.by_title[frozenset(title)].append(code)
        self.by_title.pop(frozenset(), None)
        often = Counter(w for title in self.by_title for w in title)
        self.by_word: dict[str, list[frozenset]] = defaultdict(list)
        for title in self.by_title:
            self.by_word[min(title, key=lambda w: (often[w], w))].append(title)

    def named(self, words: set[str], numbers: Sequence[str]) -> list[int]:
        codes = {c for n in numbers for c in self.by_number.get(n, ())}
        for w in words:
            for title in self.by_word.get(w, ()):
                if title <= words:
                    codes.update(self.by_title[title])
        return sorted(codes)


def _best(index: Index, entries: np.ndarray, named: np.ndarray, discount: np.ndarray, unit: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best units as (passage, score); a unit is a passage, or what a named section shows of a page."""
    bounds = index.bounds(entries)
    boosted = np.zeros(index.n, bool)
    boosted[named] = True
    bounds[np.unique(named // BLOCK)] += SECTION_BOOST
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    best, at, take = [], 0, FIRST
    while at < len(order) and (len(best) < k or bounds[order[at]] >= best[-1][1] - CLOSE):
        blocks = order[at:at + take]
        at, take = at + take, 2 * take
        score = index.scores(entries, blocks)
        here = np.flatnonzero((score > 0) | boosted)
        here = here[np.isin(here // BLOCK, blocks)]
        final = (score[here] + SECTION_BOOST * boosted[here]) * discount[here]
        own = np.where(boosted[here], unit[here], -1 - here)
        if best:
            p, score, u = zip(*best, strict=True)
            here, final, own = np.r_[p, here], np.r_[score, final], np.r_[u, own]
        found = {}
        for i in np.lexsort((here, -np.round(final, 9))).tolist():
            found.setdefault(int(own[i]), (int(here[i]), float(final[i]), int(own[i])))
            if len(found) == k:
                break
        best = list(found.values())
    return [(p, s) for p, s, _ in best]


def _cell(k: int, result: pa.Schema, sections: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(passages: pa.Table, queries: pa.Table) -> pa.Table:
        if not passages.num_rows or not queries.num_rows:
            return result.empty_table()
        passages = passages.sort_by([("doc", "ascending"), ("page", "ascending"), ("seq", "ascending")])
        asked = queries["terms"].combine_chunks()
        each = asked.flatten()
        coded = each.field("term").dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        idf = np.zeros(len(coded.dictionary))
        idf[term] = each.field("idf").to_numpy(zero_copy_only=False)
        index = Index(passages, coded.dictionary, idf, queries["average"][0].as_py())
        ends = np.r_[0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))]
        discount = np.where(passages["contents"].to_numpy(), TOC_FACTOR, 1.0) if sections else np.ones(index.n)
        unit = np.arange(index.n)
        if sections:
            table = passages.select(["doc", "page", "section"]).to_pandas()
            unit = table.groupby(["doc", "page", "section"], sort=False, dropna=False).ngroup().to_numpy()
            code, distinct = pd.factorize(table["section"])
            first = np.unique(code, return_index=True)[1]
            titles = Titles(distinct.tolist(), *(passages[c].take(pa.array(first)).to_pylist() for c in ("number", "title")))
            holders, held = np.argsort(code, kind="stable"), np.r_[0, np.cumsum(np.bincount(code, minlength=len(distinct)))]
            numbers, words = queries["numbers"].to_pylist(), coded.dictionary.to_pylist()
        rows, score, query, named_rows = [], [], [], []
        for q in range(queries.num_rows):
            own = term[ends[q]:ends[q + 1]]
            named = np.empty(0, np.int64)
            if sections:
                codes = np.array(titles.named({words[t] for t in own}, numbers[q]), np.int64)
                named = holders[_ranges(held[codes], held[codes + 1])]
            shown = set(named.tolist())
            for p, s in _best(index, index.entries(own), named, discount, unit, k):
                rows.append(p)
                score.append(s)
                query.append(q)
                named_rows.append(p in shown)
        at = pa.array(rows, pa.int64())
        out = [queries["query_id"].take(pa.array(query, pa.int64())), *(passages[c].take(at) for c in ("doc", "page", "seq", "section")),
               pa.array(score, pa.float64()), pa.array(named_rows, pa.bool_())]
        return pa.table(dict(zip(result.names, out, strict=True))).cast(result)
    return search


def _shards(df: DataFrame, most: int) -> int:
    return max(1, -(-input_bytes(df) // most))


def _first_copies(p: DataFrame, k: int) -> DataFrame:
    """Without the passages that cannot be among k: copies score alike, and a section's copies on k earlier pages, or k
    earlier copies, go before.  Spark limits each group before the shuffle, so many copies stay few rows."""
    copies = p.withColumn("_bag", F.sha2(F.concat_ws(" ", F.array_sort("words")), 256))
    w = Window.partitionBy("section", "contents", "_bag").orderBy("doc", "page")
    return copies.withColumn("_dr", F.dense_rank().over(w)).where(F.col("_dr") <= k).drop("_dr", "_bag")


def best_passages(passages_df: DataFrame, queries: DataFrame, k: int, sections: bool = False, contents: Column | None = None,
                  number: Column | None = None, title: Column | None = None, numbers: Column | None = None) -> DataFrame:
    """The k best of each query, ranked.  Queries with the same words and numbers get the same, so one of them is searched."""
    require_columns(queries, "query_id", "query")
    said = F.array_sort(F.array_distinct(tokens(F.coalesce("query", F.lit("")))))
    wrote = F.array_sort(F.array_distinct(F.coalesce(numbers, F.array().cast("array<string>")))) if sections else F.array().cast("array<string>")
    asked = queries.withColumn("_form", F.sha2(F.concat(F.concat_ws(" ", said), F.lit("|"), F.concat_ws(" ", wrote)), 256))
    forms = asked.groupBy("_form").agg(F.min(F.struct("query_id", F.coalesce("query", F.lit("")).alias("query"))).alias("q"))
    one = forms.select(F.col("q.query_id").alias("query_id"), F.col("q.query").alias("query"))
    best = cut(ranked(top_passages(passages_df, one, k, sections, contents, number, title, numbers), k))   # read by every query of a form
    who = forms.select("_form", F.col("q.query_id").alias("_one"))
    every = asked.select("query_id", "_form").join(who, "_form").select("query_id", "_one")
    return every.join(best.withColumnRenamed("query_id", "_one"), "_one").drop("_one")


def top_passages(passages_df: DataFrame, queries: DataFrame, k: int, sections: bool = False, contents: Column | None = None,
                 number: Column | None = None, title: Column | None = None, numbers: Column | None = None) -> DataFrame:
    """query_id, doc, page, seq, section, score, named: at most k rows a query and shard, the best k of all among them.

    With ``sections``, ``number`` and ``title`` (words) of a passage's section and the ``numbers`` that a query writes
    decide what is named; a page's passages then lie in one shard, and a page is bounded.
    """
    require_columns(queries, "query_id", "query")
    spark = passages_df.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _shards(passages_df, SHARD_BYTES))
    blocks = _shards(queries, QUERY_BYTES)
    place = ["doc", "page"] if sections else ["doc", "page", "seq"]
    extra = [contents.alias("contents"), number.alias("number"), title.alias("title")] if sections else []
    said = tokens(F.concat_ws(" ", "section", "text"))
    p = passages_df.select("doc", "page", "seq", "section", F.concat_ws(" ", said).alias("said"), F.size(said).cast("double").alias("length"), *extra)
    p = cut(p)   # passages are found and parted into words once, and read for the mean, the frequencies and the cells
    words = F.when(F.col("length") > 0, F.split("said", " ")).otherwise(F.array().cast("array<string>"))
    p = p.select("doc", "page", "seq", "section", words.alias("words"), "length", *(("contents", "number", "title") if sections else ()))
    p = p.withColumns({"shard": F.pmod(F.xxhash64(*place), F.lit(shards)).cast("int")})
    every = p
    if sections:   # queries may be as many as passages; without sections, sorting all words would cost more than it saves
        p = _first_copies(p, k)
    stats = every.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("average"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    df = every.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(F.broadcast(stats), F.lit(True), "cross").select("term", "average", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = q.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"), F.max("average").alias("average"))
    if sections:   # a query may name a section by its number alone
        none = F.array().cast("array<struct<term:string,idf:double>>")
        written = queries.select("query_id", numbers.alias("numbers")).dropDuplicates(["query_id"])
        asked = written.join(asked, "query_id", "left").select("query_id", "numbers", F.coalesce("terms", none).alias("terms"), F.coalesce("average", F.lit(1.0)).alias("average"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    cells = p.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), *(passages_df.schema[c] for c in ("doc", "page", "seq", "section")),
              T.StructField("score", T.DoubleType()), T.StructField("named", T.BooleanType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    found = cells.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    return found.applyInArrow(_cell(k, _arrow(schema), sections), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties (by rounded score) in document order."""
    order = [F.desc(F.round("score", 9)), F.asc("doc"), F.asc("page"), F.asc("seq")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
