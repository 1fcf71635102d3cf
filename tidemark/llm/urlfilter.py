"""URL filters: a cascade of Bloom filters that is exact over the corpus's complete key universe.

The keys of a url are the host and its parent domains, each with the beginnings of the path that are as long as some rule's.
The universe is every key that occurs in the corpus.  Level 1 of a cascade holds the listed keys; level 2 the keys of the
universe that level 1 takes for listed; level 3 the listed keys that level 2 takes for unlisted; and so on until a level
errs on none.  Over the universe the answer is then exact.  The cascade's size follows the list, not the corpus; it goes
to every task, and looking a key up takes neither a join nor a shuffle.  One cascade says which keys are rules, a second,
over the rules, which of them block.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; an url without a rule is allowed;
repeated rows are judged each on its own; of rules with equally long names the one with the longer host wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hashing import mix
from tidemark.session import cut

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The most a cascade may weigh before it is sent to the executors, in bytes.
CASCADE_BYTES = 64 << 20


class Level:
    """A Bloom filter: bits in 64-bit words, k places for a key."""

    def __init__(self, words: np.ndarray, hashes: int):
        self.words, self.hashes = words, hashes

    def contains(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        size, out = np.uint64(64 * len(self.words)), np.ones(len(one), bool)
        for k in range(self.hashes):
            at = (one + np.uint64(k) * two) % size
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


class Cascade:
    """Levels that hold, in turn, listed keys and false positives."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed; keys by their two hashes."""
        one, two = one.view(np.uint64), two.view(np.uint64)
        listed = np.zeros(len(one), bool)
        asked = np.arange(len(one))
        for k, level in enumerate(self.levels):
            # what passes is for now on the side of this level
            asked = asked[level.contains(*_salted(one[asked], two[asked], k))]
            listed[asked] = k % 2 == 0
        return listed

    @property
    def size(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _salted(one: np.ndarray, two: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Another pair of hashes on each level; every bit depends on the whole key, so that keys which collide on one level
    do not on the next."""
    turn = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    return mix(one ^ turn), mix(two + turn) | np.uint64(1)


def _positions(level: int, bits: int, hashes: int):
    """For each key the words and masks of its bits, combined within the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _salted(*(b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two")), level)
            at = np.unique(np.concatenate([(one + np.uint64(k) * two) % np.uint64(bits) for k in range(hashes)]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_pydict({"word": word.astype(np.int64), "mask": mask.view(np.int64)})
    return run


def _passes(levels: list[Level]):
    """Only the keys that pass the last level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two"))
            yield b.filter(pa.array(levels[-1].contains(*_salted(one, two, len(levels) - 1))))
    return run


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(7))


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys over all keys of the universe; both have one column, key.  Keys are counted and their
    bits set in tasks; what comes to the driver is the filters, whose size is checked."""
    on, keys = listed.select("key").distinct().withColumn("listed", F.lit(True)), universe.select("key").distinct()
    both = keys.join(on, "key", "full_outer").select(*(h.alias(n) for h, n in zip(hashes(F.col("key")), ("one", "two"), strict=True)),
                                                    F.coalesce("listed", F.lit(False)).alias("listed"))
    both = cut(both)
    sides = [both.where("listed").select("one", "two"), both.where("not listed").select("one", "two")]
    counts = [s.count() for s in sides]
    levels: list[Level] = []
    rate = min(0.5, counts[0] * math.sqrt(0.5) / max(1, counts[1]))
    while not levels or counts[(len(levels)) % 2]:
        side, n = sides[len(levels) % 2], counts[len(levels) % 2]
        bits = 64 * max(1, math.ceil(n * math.log(1 / max(rate, 1e-18)) / math.log(2) ** 2 / 64))
        if bits / 8 + sum(x.words.nbytes for x in levels) > CASCADE_BYTES:
            raise ValueError(f"a cascade over {counts} keys is larger than {CASCADE_BYTES} bytes; split the list by a hash of its keys")
        k = max(1, round(bits / max(1, n) * math.log(2)))
        words = np.zeros(bits // 64, np.uint64)
        rows = side.mapInArrow(_positions(len(levels), bits, k), "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
        for word, mask in rows.collect():
            words[word] = np.int64(mask).view(np.uint64)
        levels.append(Level(words, k))
        # the other side's keys that this level takes for its own
        other = len(levels) % 2
        sides[other] = cut(sides[other].mapInArrow(_passes([*levels]), "one long, two long"))
        counts[other], rate = sides[other].count(), 0.5
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of an url: its host and parent domains, each with every beginning of the path that a rule may have."""
    labels = F.split(host, r"\.", -1)
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


_ASKED = "page_id long, host string, path string, keys array<string>, listed array<boolean>, blocked array<boolean>"


def _asker(cascades):
    """Looks up all keys of a batch at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, blocks = cascades.value
        for b in batches:
            lists = b.column("keys")
            one, two = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("one", "two"))
            ends = np.cumsum([0, *(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            answers = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.contains(one, two))) for c in (rules, blocks)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), lists, *answers], names=["page_id", "host", "path", "keys", "listed", "blocked"])
    return run


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: a row per page."""
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), list({len(p) for _, p, _ in rules})))
    listed = _literal(spark, [h + p for h, p, _ in rules])
    blocked = _literal(spark, [h + p for h, p, v in rules if v == "block"])
    cascades = build(listed, rows.select(F.explode("keys").alias("key"))), build(blocked, listed)
    sent = spark.sparkContext.broadcast(cascades)
    asked = rows.select("*", F.transform("keys", lambda k: hashes(k)[0]).alias("one"), F.transform("keys", lambda k: hashes(k)[1]).alias("two"))
    found = asked.mapInArrow(_asker(sent), _ASKED)
    fits = F.filter(F.arrays_zip("keys", "listed", "blocked"), lambda x: x["listed"])
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.char_length(x["keys"]).alias("n"), F.instr(x["keys"], "/").alias("host"),
                                                            x["keys"].alias("rule"), x["blocked"].alias("blocked"))))
    found = found.withColumn("best", best)
    return found.select("page_id", "host", "path", F.col("best")["rule"].alias("rule"),
                        F.when(F.col("best")["blocked"], "block").otherwise("allow").alias("verdict"))


def _literal(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")).alias("key"))


ORACLE = r"""
WITH cutat AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cutat),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
