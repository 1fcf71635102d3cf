"""N-gram Jaccard join: documents whose sets of word n-grams are within a Jaccard distance, and the groups they form.

Jaccard distance is a metric, and the join is a metric-space join: pivots create regions, documents near a border are
replicated to every region where a partner may lie, and regions are joined recursively and exactly.

Two documents that share no n-gram are at distance exactly 1, so document pivots cannot tell unrelated documents apart.  The
first pivots are therefore the points of the space that can: the sets of one n-gram.  A document lies in the regions of its
own n-grams (at distance 1 - 1/n, against 1 for all others), ordered from rare to frequent.  A partner within the distance
shares at least three quarters of a document's n-grams, so the first quarter of its regions, and one more, meets every
partner: that is the window.  N-grams that no other text holds come first in that order and their regions hold one document,
so a document whose unshared n-grams fill its window is done.  Where a region stands in a document's order bounds how large a
partner may be that shares this n-gram first; a region connects only documents whose sizes are within each other's bounds, so
edited copies that are too far from all others do not chain.  What regions connect is a block, joined on its own by the same
bounds, with the order of the block's n-grams.  A block that is too large for one task is split by document pivots: each document goes to its nearest pivot's region and, by the
triangle inequality, to every region whose pivot is at most twice the threshold farther; regions that are still large take
new pivots.  Documents that links already connect need no further comparison.

Counting n-grams, finding their documents and joining blocks happens on numpy arrays inside tasks; rows between tasks are
arrays of bounded size, so that a hundred million n-grams are some thousand rows.  Only counts reach the driver.

Defined results: A-Z are lower-cased, words are runs of characters that are no blanks; a text with fewer words than an
n-gram is one n-gram; a null or empty text has none and is a component of its own.  Rows with the same doc_id are one
document if their texts agree, and are linked like any others if not.  Rows without doc_id are
linked by their texts, but no component is named after them and their own is null.  N-grams are compared by 46 bits or more of their hash within what a pair shares.  ``docs`` should be a table or
materialised: its rows are read once, in partitions that must come out the same again when a task is repeated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import fresh, shuffle_partitions
from tidemark.llm.hashing import hashed_words, shingle_set
from tidemark.session import cut

WORDS = 5
#: Linked from this similarity on, in percent.
PERCENT = 75
DISTANCE = 1 - PERCENT / 100
#: N-grams that a task gathers before it sends them, and the size of a block that one task joins.
FLUSH = 3_000_000
LEAF_DOCUMENTS, LEAF_SHINGLES = 8192, 3_000_000
#: Pivots of a large region: a share of its documents within bounds.  Documents of a region that one task compares with them.
PIVOTS_LEAST, PIVOTS_MOST, PIVOTS_SHARE, CELL = 32, 1024, 32, 2048

_NO_ID = np.iinfo(np.int64).min
_ROW = "batch string, bucket int, a binary, b binary, c binary, d binary"


def _table(batch: list, bucket: list, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch, pa.string()), pa.array(bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
                                      names=["batch", "bucket", "a", "b", "c", "d"])


def needed(n: np.ndarray | int):
    """The least number of n-grams that a set of n shares with a linked one."""
    return (PERCENT * n + 99) // 100


class _Batch:
    """Distinct sets of some documents, and which document has which."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.tags: list[int] = []
        self.of: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc: int | None, tag: int, found: np.ndarray) -> None:
        self.ids.append(_NO_ID if doc is None else doc)
        self.tags.append(tag)
        if not len(found):
            self.of.append(-1)
            return
        key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(found)
            self.size += len(found)
        self.of.append(self.index[key])

    def rows(self, name: str, bits: int) -> Iterator[pa.RecordBatch]:
        """A row that says what the batch holds, and one for each bucket of n-grams."""
        sizes = np.array([len(x) for x in self.sets], np.int64)
        yield _table([name], [-1 - zlib.crc32(name.encode()) % (1 << bits)], [np.array([*self.ids, *self.tags], np.int64).tobytes()], [np.array(self.of, np.int32).tobytes()], [sizes.tobytes()], [b"".join(self.index)])
        if not self.sets:
            return
        grams = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        bucket = (grams >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        rest = ((grams[order] << np.uint64(bits)) >> np.uint64(24))
        bucket, owner = bucket[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for i in range(0, len(cuts) - 1, 64):
            part = [(cuts[k], cuts[k + 1]) for k in range(i, min(i + 64, len(cuts) - 1))]
            yield _table([name] * len(part), [int(bucket[s]) for s, _ in part],
                         *zip(*((_packed(owner[s:e], len(sizes)), *_split(rest[s:e]), b"") for s, e in part), strict=True))


_WIDTHS = {b"1": np.uint8, b"2": np.uint16, b"4": np.uint32}


def _packed(owner: np.ndarray, sets: int) -> bytes:
    """Which of a batch's sets hold the n-grams of a bucket, in ascending order: how many each set holds, or, where n-grams are
    fewer than sets, the steps from one owner to the next, so that the bytes follow the n-grams however many buckets there are."""
    steps = len(owner) < sets
    numbers = np.diff(owner, prepend=0) if steps else np.bincount(owner, minlength=sets)
    most = numbers.max() if len(numbers) else 0
    wide = b"1" if most < 256 else b"2" if most < 65536 else b"4"
    return (b"s" if steps else b"c") + wide + numbers.astype(_WIDTHS[wide]).tobytes()


def _owners(raw: bytes) -> np.ndarray:
    numbers = np.frombuffer(raw, _WIDTHS[raw[1:2]], offset=2) if len(raw) > 2 else np.empty(0, np.uint8)
    return np.cumsum(numbers, dtype=np.int64) if raw[:1] == b"s" else np.repeat(np.arange(len(numbers)), numbers)


def _split(rest: np.ndarray) -> tuple[bytes, bytes]:
    """40-bit numbers as two arrays."""
    return (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (rest >> np.uint64(32)).astype(np.uint8).tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32))


def _gatherer(bits: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = TaskContext.get().partitionId(), 0, _Batch()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                words, starts = hashed_words(some.column(1))
                for i, (doc, tag) in enumerate(zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    held.add(doc, tag, shingle_set(words[starts[i]:starts[i + 1]], WORDS))
                if held.size >= FLUSH:
                    yield from held.rows(f"{part}-{count}", bits)
                    count, held = count + 1, _Batch()
        if held.ids:
            yield from held.rows(f"{part}-{count}", bits)
    return gather


def _frequencies(table: pa.Table) -> pa.Table:
    """For each batch's n-grams in a bucket, those that several sets hold, with the number of these sets.  Rows that say what
    a batch holds, with a bucket below 0, pass."""
    if table["bucket"][0].as_py() < 0:
        return table
    rest = [_joined(low, high) for low, high in zip(table["b"].to_pylist(), table["c"].to_pylist(), strict=True)]
    every = np.concatenate(rest)
    order = np.argsort(every)
    ordered = every[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    often = np.diff(np.r_[first, len(ordered)])
    many = np.empty(len(every), np.int64)
    many[order] = np.repeat(often, often)
    out: list[tuple] = []
    at = 0
    for held, grams in zip(table["a"].to_pylist(), rest, strict=True):
        df = many[at:at + len(grams)]
        at += len(grams)
        shared = df > 1
        owner = _owners(held)[shared]
        out.append((_packed(owner, int(owner[-1]) + 1 if len(owner) else 0), *_split(grams[shared]),
                    np.minimum(df[shared], 65535).astype(np.uint16).tobytes()))
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], **{n: pa.array(c, pa.binary()) for n, c in zip("abcd", zip(*out, strict=True), strict=True)}})


_SETS = "doc_id long, tag long, n_shingles long, set_key binary, regions array<long>, shared binary"


def _windows(table: pa.Table) -> pa.Table:
    """The documents of a batch; for those that may have a partner, the regions of their window and their shared n-grams."""
    buckets = table["bucket"].to_pylist()
    head = next(i for i, b in enumerate(buckets) if b < 0)
    ids, of, sizes = (np.frombuffer(table[c][head].as_py(), t) for c, t in (("a", np.int64), ("b", np.int32), ("c", np.int64)))
    (ids, tags), keys = np.split(ids, 2), table["d"][head].as_py()
    parts = [(b, table["a"][i].as_py(), table["b"][i].as_py(), table["c"][i].as_py(), table["d"][i].as_py()) for i, b in enumerate(buckets) if b >= 0]
    owner = np.concatenate([np.empty(0, np.int64), *(_owners(p[1]) for p in parts)])
    gram = np.concatenate([np.empty(0, np.uint64), *(_joined(p[2], p[3]) | (np.uint64(p[0]) << np.uint64(40)) for p in parts)])
    df = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(p[4], np.uint16) for p in parts)])
    shared = np.bincount(owner, minlength=len(sizes)).astype(np.int64)
    window = sizes - needed(sizes) + 1 - (sizes - shared)
    some = window[owner] > 0 if len(owner) else np.empty(0, bool)
    owner, gram, df = owner[some], gram[some], df[some]
    order = np.lexsort((gram, df, owner))
    starts = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
    gram = gram[order].astype(np.int64)
    # the first document stands for its set, one without an id only where no other does
    stands = {}
    for i in np.lexsort((ids, ids == _NO_ID, of)):
        if of[i] >= 0:
            stands.setdefault(int(of[i]), int(i))
    regions, entries = [], []
    for i, s in enumerate(of):
        if s >= 0 and window[s] > 0 and stands.get(int(s)) == i:
            own = gram[starts[s]:starts[s + 1]]
            regions.append(own[:window[s]])
            entries.append(np.sort(own).tobytes())
        else:
            regions.append(None)
            entries.append(None)
    return pa.table({"doc_id": pa.array([None if x == _NO_ID else x for x in ids.tolist()], pa.int64()), "tag": pa.array(tags, pa.int64()),
                     "n_shingles": pa.array([int(sizes[s]) if s >= 0 else 0 for s in of], pa.int64()),
                     "set_key": pa.array([keys[16 * s:16 * s + 16] if s >= 0 else None for s in of], pa.binary()),
                     "regions": pa.array(regions, pa.list_(pa.int64())), "shared": pa.array(entries, pa.binary())})


def shingle_windows(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), n_shingles, set_key, and where a partner is possible the regions of the window and the shared n-grams."""
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    bits = min(22, max(6, (buckets - 1).bit_length()))
    text = F.col("text").cast("string")
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag")).mapInArrow(_gatherer(bits), _ROW)
    found = sent.groupBy("bucket").applyInArrow(_frequencies, _ROW)
    return found.groupBy("batch").applyInArrow(_windows, _SETS)


class Postings:
    """Which of some sets hold an n-gram."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.count, self.grams = len(sets), every[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]

    def overlap(self, one: np.ndarray) -> np.ndarray:
        """How many n-grams each set shares with this one."""
        left = np.searchsorted(self.grams, one, "left")
        often = np.searchsorted(self.grams, one, "right") - left
        total = int(often.sum())
        place = np.repeat(left - np.cumsum(often) + often, often) + np.arange(total)
        return np.bincount(self.owner[place], minlength=self.count)


def links(n: int, sizes: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + sizes - overlap)


def largest_partner(n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The most n-grams that a set linked with one of n can have, if at most ``left`` of them are in both."""
    return (100 + PERCENT) * left // PERCENT - n


class Prefixes:
    """The n-grams of some sets that may be the first that a linked pair shares, rare ones first.

    N-grams have one order, by the number of these sets that hold them.  Behind a set's n-gram there are only so many that a pair
    can still share, so where a pair's first shared n-gram stands bounds how large either may be."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes, every = sizes, np.concatenate(sets)
        self.starts = np.cumsum([0, *(len(x) for x in sets)])
        owner = np.repeat(np.arange(len(sets)), np.diff(self.starts))
        _, self.gram, often = np.unique(every, return_inverse=True, return_counts=True)
        self.member = np.zeros(len(often), bool)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        met = often[self.gram] > 1
        owner, rank = owner[met], rank[self.gram[met]]
        order = np.lexsort((rank, owner))
        rank = rank[order]                         # owners are in order already
        self.shared = np.bincount(owner, minlength=len(sets))
        before = np.cumsum(self.shared) - self.shared
        most = largest_partner(sizes[owner], self.shared[owner] - (np.arange(len(owner)) - before[owner]))
        some = most >= np.maximum(needed(sizes), sizes.min())[owner]
        self.owner, self.rank, self.most = owner[some], rank[some], most[some]
        self.own = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        by_rank = np.argsort(self.rank, kind="stable")
        self.by_rank, self.sorted = by_rank, self.rank[by_rank]

    def linked(self, i: int, group: np.ndarray) -> np.ndarray:
        """The sets of other groups that are linked with this one."""
        mine = slice(self.own[i], self.own[i + 1])
        left = np.searchsorted(self.sorted, self.rank[mine], "left")
        often = np.searchsorted(self.sorted, self.rank[mine], "right") - left
        place = self.by_rank[np.repeat(left - np.cumsum(often) + often, often) + np.arange(int(often.sum()))]
        other = self.owner[place]
        fits = (self.sizes[other] <= np.repeat(self.most[mine], often)) & (self.most[place] >= self.sizes[i]) & (group[other] != group[i])
        other = np.unique(other[fits])
        if not len(other):
            return other
        self.member[self.gram[self.starts[i]:self.starts[i + 1]]] = True
        ends = np.cumsum(self.starts[other + 1] - self.starts[other])
        place = np.arange(ends[-1]) + np.repeat(self.starts[other + 1] - ends, self.starts[other + 1] - self.starts[other])
        overlap = np.diff(np.r_[0, np.cumsum(self.member[self.gram[place]])[ends - 1]])
        self.member[self.gram[self.starts[i]:self.starts[i + 1]]] = False
        return other[links(int(self.sizes[i]), self.sizes[other], overlap)]


def _groups(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The first member of each one's group, in a block that is joined whole.  One after another, members become pivots and
    are compared with those of other groups, but for those that the largest group holds: each pair of two groups has a member
    that was one."""
    group, compared = np.arange(len(sets)), np.zeros(len(sets), bool)
    if len(sets) == 2:
        overlap = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return group * 0 if links(int(sizes[0]), sizes[1:], np.array([overlap]))[0] else group
    prefixes = Prefixes(sizes, sets)
    turn = np.argsort(sizes - prefixes.shared, kind="stable")      # those with the most shared n-grams link the most
    while True:
        held = np.bincount(group, minlength=len(sets))
        largest = held.argmax()
        waiting = turn[~compared[turn] & (group[turn] != largest)]
        if not len(waiting):
            return group
        # before the largest group is looked for again, as many as would make it anew
        for i in waiting[:max(1, len(waiting) // 8)]:
            if group[i] == largest:
                continue
            compared[i] = True
            near = prefixes.linked(i, group)
            if len(near):
                meets = np.unique(np.r_[group[i], group[near]])
                group[np.isin(group, meets)] = meets[0]
                held[meets[0]] = held[meets].sum()
                largest = meets[0] if largest in meets or held[meets[0]] > held[largest] else largest


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with the same first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the linked documents of whole blocks."""
    nodes, heads = [], []
    for rows in _by_key(batches, 1):
        rows.sort(key=lambda r: r[1])
        ids = np.array([r[1] for r in rows], np.int64)
        group = _groups(np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.int64) for r in rows])
        heads_here = ids[group]
        linked = np.isin(heads_here, heads_here[heads_here != ids])
        nodes.append(ids[linked])
        heads.append(heads_here[linked])
        if len(nodes) >= 1000:
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes), "component": np.concatenate(heads)})
            nodes, heads = [], []
    if nodes:
        yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes), "component": np.concatenate(heads)})


def _join_blocks(blocks: DataFrame) -> DataFrame:
    """blocks: block, node, n, shared; (node, component) of what is linked within them."""
    n = shuffle_partitions(blocks.sparkSession)
    # by a hash: a repartitioning by the key of the join before would be left out, and a join that turns out small or skewed
    # while it runs deals a block's rows to several tasks
    rows = blocks.select("block", "node", "n", "shared").repartition(n, F.xxhash64("block")).sortWithinPartitions("block")
    return rows.mapInArrow(_block_links, "node long, component long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, node, n, most (the largest partner, if the place is the first that both share): (node, pivot) of those that
    pairs of fitting sizes connect in a place, its pivot the smallest node of them.

    A set with n <= most spans the sizes from n to most, and two of them fit if these meet; one with most < n fits those that
    span from most to n, and no other of its kind."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    place, node, n, most = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for k in range(4))
    del held
    spans = most >= n
    order = np.lexsort((~spans, np.where(spans, n, most), place))
    place, node, n, most, spans = (x[order] for x in (place, node, n, most, spans))
    first = np.r_[True, place[1:] != place[:-1]]
    # the farthest span of the place so far, this row's own left out
    reach = np.maximum.accumulate((np.cumsum(first) << 32) + np.where(spans, most, 0))
    before = np.where(first, 0, np.r_[0, reach[:-1]] & 0xFFFFFFFF)
    joins = before >= n
    run = np.cumsum(spans & ~joins)
    inside = np.flatnonzero(spans | joins)
    if not len(inside):
        return
    run, node = run[inside], node[inside]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    pivot = np.repeat(np.minimum.reduceat(node, starts), np.diff(np.r_[starts, len(run)]))
    edges = np.unique(np.stack([node, pivot], 1)[node != pivot], axis=0)
    for i in range(0, len(edges), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(edges[i:i + 100_000, k]) for k in (0, 1)], names=["node", "pivot"])


def _blocks(nodes: DataFrame) -> DataFrame:
    """(node, component) of the sets that places connect; every linked pair is in one component."""
    left = F.octet_length("shared") / 8 - F.col("at")
    places = nodes.select("node", "n", "shared", F.posexplode("regions").alias("at", "place"))
    places = places.select("place", "node", "n", (F.floor(left * (100 + PERCENT) / PERCENT) - F.col("n")).alias("most"))
    met = places.repartition(shuffle_partitions(nodes.sparkSession), "place").mapInArrow(_meetings, "node long, pivot long")
    return components(met.distinct())


_NEAR = "region long, node long, n long, shared binary, pivot boolean, linked array<long>, to array<long>"


def _to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell: its pivots (kind 0), then its documents; a row for each document with the linked pivots, but one
    of those that this cell has connected, and with the pivots whose regions may hold a partner."""
    cell, pivots, postings = None, [], None
    ids = sizes = group = np.empty(0, np.int64)
    rows: list[tuple] = []
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                          names=["region", "node", "n", "shared", "pivot", "linked", "to"])
    for batch in batches:
        for region, salt, kind, node, n, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != (region, salt):
                cell, pivots, postings = (region, salt), [], None
            one = np.frombuffer(shared, np.int64)
            if kind == 0:
                pivots.append((node, n, one))
                continue
            if postings is None:
                postings = Postings([p[2] for p in pivots])
                ids, sizes, group = np.array([p[0] for p in pivots]), np.array([p[1] for p in pivots]), np.arange(len(pivots))
            overlap = postings.overlap(one)
            met = np.flatnonzero(links(n, sizes, overlap))
            groups, at = np.unique(group[met], return_index=True)
            if len(groups) > 1:
                group[np.isin(group, groups)] = groups[0]
            d = 1 - overlap / (n + sizes - overlap)
            chosen = bool((ids == node).any())
            # a pivot has met all others and goes no further
            rows.append((region, node, n, shared, chosen, ids[met[at]], None if chosen else ids[d <= d.min() + 2 * DISTANCE + 1e-9]))
            if len(rows) >= 500:
                yield made()
                rows = []
    if rows:
        yield made()


def _split_large(rows: DataFrame, leaf: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links of blocks that one task cannot join: rows region, node, n, shared; result node, component, complete."""
    start, found, turn = cut(rows.select("region", "node", "n", "shared", F.col("node").alias("component"))), None, 0
    open_rows = start
    while not open_rows.isEmpty():
        sizes = open_rows.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
        sized = open_rows.join(sizes, "region")
        small = (F.col("members") <= LEAF_DOCUMENTS) & (F.col("grams") <= LEAF_SHINGLES)
        edges = leaf(sized.where(small).select(F.col("region").alias("block"), "node", "n", "shared"))
        large = sized.where(~small)
        # pivots come from the documents that the largest group does not hold yet
        group = large.groupBy("region", "component").agg(F.count(F.lit(1)).alias("held"))
        largest = group.groupBy("region").agg(F.max_by("component", F.struct("held", -F.col("component"))).alias("largest"))
        pick = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        # a region that pivots did not settle takes four times the share, up to PIVOTS_MOST
        wanted = F.least(F.lit(PIVOTS_MOST), F.greatest(F.lit(PIVOTS_LEAST), F.col("members") * 4 ** min(turn, 5) / PIVOTS_SHARE))
        pivots = large.join(largest, "region").where("component <> largest").withColumn("rank", F.row_number().over(pick)).where(f"rank <= {PIVOTS_MOST}").where(F.col("rank") <= wanted)
        cells = F.ceil(F.col("members") / CELL).cast("int")
        cell = F.explode(F.sequence(F.lit(0), cells - 1))
        both = pivots.select("region", cell.alias("salt"), F.lit(0).alias("kind"), "node", "n", "shared").unionByName(
            large.select("region", F.pmod(F.xxhash64("node"), cells).cast("int").alias("salt"), F.lit(1).alias("kind"), "node", "n", "shared"))
        dealt = both.repartition("region", "salt").sortWithinPartitions("region", "salt", "kind")
        near = cut(dealt.mapInArrow(_to_pivots, _NEAR))
        hits = near.select("node", F.explode("linked").alias("component")).where("node <> component")
        edges = edges.unionByName(hits)
        found = components(edges if found is None else found.unionByName(edges))
        # regions of the pivots, and what the windows send to several
        rest = near.where(~F.col("pivot")).select("region", "node", "n", "shared", "to")
        spread = rest.groupBy("region").agg((F.sum(F.size("to")) <= 1.25 * F.count(F.lit(1))).alias("parts"))
        stay = F.when(F.col("parts"), F.transform("to", lambda p: F.xxhash64("region", p))).otherwise(F.array("region"))
        rest = rest.join(spread, "region").select(F.explode(stay).alias("region"), "node", "n", "shared")
        label = found.select("node", F.col("component").alias("known"))
        rest = rest.join(label, "node", "left").select("region", "node", "n", "shared", F.coalesce("known", "node").alias("component"))
        # a region within one component has nothing left to find
        unsettled = rest.groupBy("region").agg((F.min("component") < F.max("component")).alias("apart")).where("apart").select("region")
        open_rows, turn = cut(rest.join(unsettled, "region", "left_semi")), turn + 1
    return found if found is not None else start.select("node", "component").limit(0)


def _linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``shingle_windows``; and of every set that is linked or has copies: set_key, component, component_id."""
    sets = cut(shingle_windows(docs))
    stands = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    stands = cut(stands)
    nodes = (sets.where("shared is not null").select("set_key", "doc_id", F.col("n_shingles").alias("n"), "regions", "shared")
             .join(stands.select("set_key", "node"), "set_key").where("doc_id <=> node").dropDuplicates(["set_key"]))
    nodes = cut(nodes.select("set_key", F.xxhash64("set_key").alias("node"), "n", "regions", "shared"))
    members = cut(nodes.join(_blocks(nodes), "node").select(F.col("component").alias("block"), "node", "n", "shared"))
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
    small = (F.col("members") <= LEAF_DOCUMENTS) & (F.col("grams") <= LEAF_SHINGLES) | (F.col("members") <= 2)
    sized = members.join(sizes.select("block", small.alias("small")), "block")
    linked = _join_blocks(sized.where("small"))
    if not sizes.where(~small).isEmpty():
        linked = linked.unionByName(_split_large(sized.where("not small").select(F.col("block").alias("region"), "node", "n", "shared"), _join_blocks))
    # from sets to documents: the smallest document of all sets of a component
    named = stands.withColumn("at", F.xxhash64("set_key")).join(linked.withColumnRenamed("node", "at"), "at", "left")
    named = named.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "at"))
    first = named.groupBy("component").agg(F.min("node").alias("component_id"))
    return sets, named.join(first, "component").select("set_key", "component", "component_id")


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per document."""
    sets, member = _linked_sets(docs)
    out = sets.select("doc_id", "n_shingles", "set_key").join(member, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last, and of rows that share it one that the texts decide.

    Rows are told apart by doc_id and text, so a text that shares its id with a copy stays where it is like no other.  Of
    equal rows one stays.  Rows whose text has no word are like nothing and stay."""
    sets, member = _linked_sets(docs.select("doc_id", "text"))
    rows = sets.where("set_key is not null").groupBy("doc_id", "tag", "set_key").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut(rows.join(member, "set_key").select("doc_id", "tag", "set_key", "copies", "component"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_key", "tag")).alias("best")
    marked = rows.join(rows.groupBy("component").agg(best), "component")
    stays = F.struct("doc_id", "set_key", "tag").eqNullSafe(F.struct("best.doc_id", "best.set_key", "best.tag"))
    marked = cut(marked.select(F.col("doc_id").alias("q_doc"), F.col("tag").alias("q_tag"), stays.alias("q_stays"), "copies").where("not q_stays or copies > 1"))
    name = fresh(docs, "q_text_tag")
    tagged = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("q_doc")) & (F.col(name) == F.col("q_tag"))
    out = tagged.join(marked, met, "left_anti")
    again = marked.where("q_stays")
    if not again.isEmpty():
        out = out.unionByName(tagged.join(again, met, "left_semi").dropDuplicates(["doc_id", name]))
    return out.select(*(f"`{c}`" for c in docs.columns))
