"""Packing: documents into training sequences of several context sizes, with little padding.

Each document's token ids, closed by ``END``, are cut into whole windows of the longest size; what remains is routed to the
tier of the smallest context size that holds it.  From the longest tier down, each window starts with the largest document of
its tier, and its gap is filled from shorter tiers: whole documents first, the largest that fits; then a cut of the smallest
that is longer than the gap.  Windows of shorter tiers are thus exactly full, and only a window of the longest size may end
with a few tokens of padding.  Sequences are dealt to step groups of equal numbers of tokens, each with its share of every
size.

A task packs the documents of its own partition, in bounded buffers, and passes what does not fill a window on to the next
buffer: no shuffle, and only the last sequence of a partition is left open.  Ids of sequences and groups start with the
number of the partition, so ``docs`` should be a table or materialised.

With ``ordered``, docs come sorted, and every buffer is a range of that order: it is closed when full and as soon as a
document comes again, so that no copies of a document share a sequence, and nothing passes from a range to the next.  Ids of
sequences and groups then rise from range to range; within a range, sequences are packed and dealt by size as ever.

Defined results: a null or empty text is the one token END; rows with the same doc_id are packed each on its own; a null
doc_id passes as null; an empty table has no sequences.  Long texts are cut freely and whole: each token lies in one piece.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = 1
#: Context sizes, powers of two; the padding that a window of the longest size may keep rather than cut a document.
TIERS = (256, 512, 1024, 2048)
SLACK = 16
#: Documents and bytes of ids that a task holds before it packs them; tokens of a step group; words that a worker remembers.
BUFFER_DOCUMENTS, BUFFER_BYTES, STEP_TOKENS, REMEMBERED = 8192, 32 << 20, 64 * 2048, 1_500_000

_MARKS = frozenset(".,;:!?")


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and treats every word alone, so that each word's ids are asked
    for once.  Words and their ids are kept within a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _core(self, word: str) -> tuple[str, str]:
        """The word without a punctuation mark that the tokenizer splits off anyway, in lower case where that is one."""
        core, tail = (word[:-1], word[-1]) if len(word) > 1 and word[-1] in _MARKS and word[-2].isalpha() else (word, "")
        return (core.lower() if core.isascii() and core.isalpha() else core), tail

    def _learn(self, words: list[str]) -> None:
        parts = [self._core(w) for w in words]
        known = self.known
        missing = list({p for pair in parts for p in pair if p and p not in known})
        plain = [w for w in missing if w.isascii() and w.isalpha()]
        for i in range(0, len(plain), 2000):
            some = plain[i:i + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = np.array(got.word_ids)
            ends = np.searchsorted(of, np.arange(len(some) + 1)) * 4
            raw = np.array(got.ids, "<u4").tobytes()
            known.update((w, raw[ends[k]:ends[k + 1]]) for k, w in enumerate(some))
        other = [w for w in missing if not (w.isascii() and w.isalpha())]
        for w, got in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False), strict=True):
            known[w] = np.array(got.ids, "<u4").tobytes()
        for w, (core, tail) in zip(words, parts, strict=True):
            known[w] = known[core] + known[tail] if tail else known[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            # the first half was met early, so it is the more frequent one
            self.known = dict(itertools.islice(self.known.items(), REMEMBERED // 2))
        split = [t.split() for t in texts]
        missing = set().union(*split).difference(self.known)
        if missing:
            self._learn(list(missing))
        find = self.known.__getitem__
        # str.split also parts at four control characters that are no white space to the tokenizer
        return [b"".join(map(find, words)) if not any(c in t for c in "\x1c\x1d\x1e\x1f")
                else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, words in zip(texts, split, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One for each worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Piece:
    """Some ids of a document: its id, their place in it, themselves, and how many the document has."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n:], self.total)


class _Stock:
    """Pieces by length."""

    def __init__(self, pieces: list[Piece]):
        self.by: dict[int, list[Piece]] = defaultdict(list)
        self.lengths: list[int] = []
        for p in pieces:
            self.by[len(p)].append(p)
        self.lengths = sorted(self.by)

    def put(self, piece: Piece) -> None:
        if not self.by[len(piece)]:
            bisect.insort(self.lengths, len(piece))
        self.by[len(piece)].append(piece)

    def _take(self, at: int) -> Piece:
        n = self.lengths[at]
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.lengths[at]
        return piece

    def largest(self, most: int) -> Piece | None:
        at = bisect.bisect_right(self.lengths, most) - 1
        return self._take(at) if at >= 0 else None

    def next_longer(self, than: int) -> Piece | None:
        at = bisect.bisect_right(self.lengths, than)
        return self._take(at) if at < len(self.lengths) else None


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, slack: int = SLACK) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces no longer than the longest tier, and the pieces of windows that nothing was left to fill."""
    stock, done, open_pieces = _Stock(pieces), [], []
    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while (first := stock.largest(tier)) is not None:
            if len(first) <= below:
                stock.put(first)
                break
            window, gap = [first], tier - len(first)
            while gap and (piece := stock.largest(gap)) is not None:
                window.append(piece)
                gap -= len(piece)
            if gap > (slack if tier == tiers[-1] else 0):
                longer = stock.next_longer(gap)
                if longer is None:
                    open_pieces += window
                    continue
                head, rest = longer.cut(gap)
                window.append(head)
                stock.put(rest)
            done.append(window)
    return done, open_pieces


def _closed(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """The last pieces one after another, cut where a window is full."""
    out: list[list[Piece]] = [[]]
    room = size
    for p in pieces:
        while len(p) > room:
            head, p = p.cut(room)
            out[-1].append(head)
            out.append([])
            room = size
        out[-1].append(p)
        room -= len(p)
        if not room:
            out.append([])
            room = size
    return [w for w in out if w]


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("step_group", pa.int64())]
_SCHEMA = ", ".join(f"{n} long" for n, _ in _FIELDS)


class _Writer:
    """Numbers sequences and groups of a partition and makes the rows of their pieces."""

    def __init__(self, partition: int, with_ids: bool):
        self.base, self.sequence, self.group, self.with_ids = partition << 40, 0, 0, with_ids

    def rows(self, sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        sizes = [sum(map(len, s)) for s in sequences]
        groups = max(1, round(sum(sizes) / STEP_TOKENS))
        # by size, to and fro, so that every group gets its share of each size
        order = sorted(range(len(sequences)), key=lambda i: -sizes[i])
        columns: list[list] = [[] for _ in range(len(_FIELDS) + 1)]
        for place, i in enumerate(order):
            lap, at = divmod(place, groups)
            group = self.base | (self.group + (at if lap % 2 == 0 else groups - 1 - at))
            window, offset = max(TIERS[-1] if sizes[i] not in TIERS else sizes[i], sizes[i]), 0
            for p in sequences[i]:
                for c, v in zip(columns, (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, self.base | self.sequence, offset, window, group, p.ids), strict=True):
                    c.append(v)
                offset += len(p)
            self.sequence += 1
            if len(columns[0]) >= (2000 if self.with_ids else 20000):
                yield self._batch(columns)
                columns = [[] for _ in columns]
        self.group += groups
        if columns[0]:
            yield self._batch(columns)

    def _batch(self, columns: list[list]) -> pa.RecordBatch:
        arrays = {n: pa.array(c, t) for (n, t), c in zip(_FIELDS, columns, strict=False)}
        if self.with_ids:
            ids = np.frombuffer(b"".join(columns[-1]), np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in columns[-1])]).astype(np.int32)
            arrays["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
        return pa.RecordBatch.from_pydict(arrays)


def _packer(path: str, with_ids: bool, ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _encoder(path), _Writer(TaskContext.get().partitionId(), with_ids)
        end, longest = np.array([END], "<u4").tobytes(), TIERS[-1]
        ready: list[list[Piece]] = []
        held: list[Piece] = []
        size = 0
        met: set[tuple] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    if ordered:
                        if (key := (doc, n, hash(ids))) in met:
                            done, held = pack(held)
                            yield from writer.rows(ready + done + _closed(held, longest))
                            ready, held, size = [], [], 0
                            met.clear()
                        met.add(key)
                    whole = n // longest * longest
                    ready += [[Piece(doc, i, ids[4 * i:4 * (i + longest)], n)] for i in range(0, whole, longest)]
                    if n > whole:
                        held.append(Piece(doc, whole, ids[4 * whole:], n))
                    size += len(ids)
                if len(held) >= BUFFER_DOCUMENTS or size >= BUFFER_BYTES:
                    done, held = pack(held)
                    if ordered:
                        done, held = done + _closed(held, longest), []
                        met.clear()
                    yield from writer.rows(ready + done)
                    ready, size = [], 0
        done, held = pack(held)
        ready += done + _closed(held, longest)
        if ready:
            yield from writer.rows(ready)
    return run


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, order: tuple[Column, ...] = ()) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the size that the sequence
    is padded to), step_group and, if asked for, ids.  ``tokenizer`` is the path of a tokenizer file on every executor; its
    words must not depend on their neighbours.  With ``order``, distinct values for each row, docs are range-sorted by it first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(f"o_{k}") for k, c in enumerate(order)))
    if order:
        rows = rows.orderBy(*rows.columns[2:])
    return rows.mapInArrow(_packer(tokenizer or public_tokenizer(), with_ids, bool(order)), _SCHEMA + (", ids array<int>" if with_ids else ""))


def pieces(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed(docs, with_ids=False)
