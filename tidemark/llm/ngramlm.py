"""LM scoring: an n-gram trie in Elias-Fano form, trained on the corpus and queried by successor search.

Tokens are the words of a text, A-Z in lower case, and one end.  The model is an interpolated bigram: with c the count of a
context and word, and C the count of the context, p(word | context) = (c + MU * p(word)) / (C + MU), over the unigram
p(word) = (count + 1) / (N + V + 1).

The trie is dealt to shards by a hash of context and word, so that no context, however frequent, is in one place.  A shard
is one buffer of flat levels that is opened by offsets, in memory or memory-mapped, and never decoded as a whole: its
vocabulary, its contexts, the pointers from contexts to their successors, all of them monotone and in Elias-Fano form with a
directory of ones; the successors as numbers within the vocabulary, each context's going on from the last one of the context
before, which makes them monotone in few bits; and for each a two-byte code of its quantised smoothed numerator, the same in
every shard.  Looking up finds context and word, reads the context's pointers, and searches the word's successor between
them, relative to the value before the first.

A task sends, for a batch of documents, its distinct words and bigrams with their training counts to the shards; a shard
counts, builds its trie, and answers each batch.  The batch, gathered from its documents once more, combines the answers
into their scores.  ``trained`` keeps a model as a table of shards, and ``scored_by`` asks it about any documents.

Defined results: a null or empty text is one end; a document without id is a training document; repeated rows count each;
without training documents every count is 0.  Words are told apart by 64-bit hashes, contexts and successors of a shard by
40 further bits.  ``docs`` should be a table or materialised, since its partitions must come out the same again.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import shuffle_partitions
from tidemark.llm.hashing import hashed_words, mix

#: Weight of the unigram; tokens of a batch.
MU = 100.0
FLUSH = 2_500_000
#: Counts up to 2^EXACT_BITS are their own codes; beyond, an octave of counts has STEPS codes, so none is off by more than 0.06 %.
EXACT_BITS, STEPS = 15, 682
#: Held out are documents whose id's checksum leaves this remainder.
FOLDS, HELD = 7, 2

_END, _BEGIN = np.uint64(0xE11D), np.uint64(0xB391)
_NO_ID = np.iinfo(np.int64).min
_ROW = "batch string, kind int, bucket int, a binary, b binary, c binary, d binary, e binary"
_HEAD, _WORDS, _PAIRS = 0, 1, 2
_ZSTD = pa.Codec("zstd", 1)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


class EliasFano:
    """A monotone sequence: the low bits of each value packed, the high parts in unary, and for each block of the unary bits
    the number of ones before it.  All three are views of the buffer; only what is asked is decoded."""

    #: Bytes of a block.
    BLOCK = 64

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low_bytes, self.high_bytes, self.before = n, bits, low, high, before
        self.blocks = high.reshape(-1, self.BLOCK)
        self.top = int(self.values(np.array([n - 1]))[0]) >> bits if n else -1

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """The sequence of ascending values, equal ones allowed, below 2^56."""
        n = len(values)
        bits = max(0, int(math.log2(max(1, int(values[-1]) // n)))) if n else 0
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-((int(high[-1]) if n else 0) + 2) // (8 * cls.BLOCK)) * 8 * cls.BLOCK, np.uint8)
        flags[high] = 1
        packed = np.packbits(flags)
        ones = np.bitwise_count(packed.reshape(-1, cls.BLOCK)).sum(axis=1, dtype=np.int64)
        # bytes beyond the end, so that eight can be read at any place
        low = np.r_[_packed_bits(values & np.uint64((1 << bits) - 1), bits), np.zeros(8, np.uint8)]
        return cls(n, bits, low, packed, np.cumsum(ones) - ones)

    def tobytes(self) -> bytes:
        head = struct.pack("<QQQQ", self.n, self.bits, len(self.low_bytes), len(self.high_bytes))
        return b"".join([head, self.low_bytes.tobytes(), self.high_bytes.tobytes(), self.before.tobytes()])

    @classmethod
    def open(cls, buffer: bytes | memoryview | np.memmap, at: int) -> tuple[EliasFano, int]:
        """A sequence at an offset of a buffer, and the offset after it."""
        n, bits, low, high = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        raw = np.frombuffer(buffer, np.uint8, low + high, at)
        at += low + high
        before = np.frombuffer(buffer, "<i8", high // cls.BLOCK, at)
        return cls(n, bits, raw[:low], raw[low:], before), at + 8 * len(before)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one, or zero, of the unary bits."""
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 65536):
            rest = k[i:i + 65536].astype(np.int64)
            before = self.before if ones else self._zeros_before()
            block = np.searchsorted(before, rest, "right") - 1
            rest = rest - before[block]
            some = self.blocks[block] if ones else ~self.blocks[block]
            # first the word of eight bytes, then the byte, then the bit
            word, rest = _within(np.bitwise_count(some.view("<u8")), rest)
            eight = some.reshape(-1, self.BLOCK // 8, 8)[np.arange(len(rest)), word]
            byte, rest = _within(np.bitwise_count(eight), rest)
            bit = _BIT[eight[np.arange(len(rest)), byte], rest]
            out[i:i + 65536] = block * 8 * self.BLOCK + word * 64 + byte * 8 + bit
        return out

    def _zeros_before(self) -> np.ndarray:
        return np.arange(len(self.before)) * (8 * self.BLOCK) - self.before

    def _starts(self, head: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(head), np.int64)
        some = head > 0
        out[some] = self._select(head[some] - 1, ones=False) - (head[some] - 1)
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.bits
        raw = self.low_bytes[(bit >> 3)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        return (raw << (bit & 7).astype(np.uint64)) >> np.uint64(64 - self.bits)

    def values(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return ((self._select(at, ones=True) - at).astype(np.uint64) << np.uint64(self.bits)) | self._low(at)

    def find(self, asked: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each value within its places from begin to end, -1 for those that are not there."""
        if not self.n:
            return np.full(len(asked), -1)
        head = (asked >> np.uint64(self.bits)).astype(np.int64)
        there = head <= self.top
        head = np.where(there, head, 0)
        tail = asked & np.uint64((1 << self.bits) - 1)
        left = np.maximum(self._starts(head), begin)
        stop = np.minimum(self._starts(head + 1), self.n if end is None else end)
        right = stop.copy()
        # successor search among the values of the same high part
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) // 2
            less = self._low(middle) < tail[open_]
            left[open_[less]], right[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[left[open_] < right[open_]]
        hit = there & (left < stop)
        hit[hit] = self._low(left[hit]) == tail[hit]
        return np.where(hit, left, -1)


def _bit_places() -> np.ndarray:
    """For each byte the places of its ones, from its highest bit on."""
    flags = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.argsort(-flags.astype(np.int64), axis=1, kind="stable")


_BIT = _bit_places()


def _within(counts: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In which column of counts the rest-th is, and which one it is there."""
    sums = np.cumsum(counts, axis=1, dtype=np.int16)
    column = np.count_nonzero(sums <= rest[:, None].astype(np.int16), axis=1)
    return column, rest - np.where(column > 0, sums[np.arange(len(rest)), np.maximum(column, 1) - 1], 0)


def _packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The values one after the other, each from its highest bit on."""
    shift = np.arange(bits - 1, -1, -1, dtype=np.int64).astype(np.uint64)
    parts = [np.packbits(((values[i:i + 65536, None] >> shift) & np.uint64(1)).astype(np.uint8)) for i in range(0, len(values), 65536)]
    return np.concatenate([np.empty(0, np.uint8), *parts]) if bits else np.empty(0, np.uint8)


class Trie:
    """The contexts and successors of a shard."""

    def __init__(self, buffer: bytes | memoryview | np.memmap):
        at = 0
        self.words, at = EliasFano.open(buffer, at)
        self.contexts, at = EliasFano.open(buffer, at)
        self.pointers, at = EliasFano.open(buffer, at)
        self.successors, at = EliasFano.open(buffer, at)
        self.codes = np.frombuffer(buffer, "<u2", self.successors.n, at)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
        """The buffer of a trie; each pair of 40-bit numbers may occur several times."""
        order = np.lexsort((word, context))
        context, word, count = context[order], word[order], count[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.empty(0, np.int64)
        count = np.add.reduceat(count, first) if len(first) else count
        context, word = context[first], word[first]
        words, number = np.unique(word, return_inverse=True)
        contexts, place, each = np.unique(context, return_inverse=True, return_counts=True)
        pointers = np.r_[0, np.cumsum(each)]
        # a context's numbers go on from the last number of the context before
        last = number[pointers[1:] - 1]
        chain = (np.cumsum(last) - last)[place] + number
        parts = [EliasFano.of(x.astype(np.uint64)).tobytes() for x in (words, contexts, pointers, chain)]
        return b"".join([*parts, quantised(count).tobytes()])

    def numerators(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair's numerator, 0 for a pair that was never seen."""
        out = np.zeros(len(context), np.uint16)
        # many pairs share a context or a word, and batches share pairs: each is looked up once
        contexts, of_context = np.unique(context, return_inverse=True)
        words, of_word = np.unique(word, return_inverse=True)
        place, number = self.contexts.find(contexts), self.words.find(words)
        seen = np.maximum(place, 0) if self.contexts.n else place[:0]
        begin, end = self.pointers.values(seen).astype(np.int64), self.pointers.values(seen + 1).astype(np.int64)
        base = np.zeros(len(seen), np.uint64)
        base[begin > 0] = self.successors.values(begin[begin > 0] - 1)
        known = np.flatnonzero((place[of_context] >= 0) & (number[of_word] >= 0))
        if len(known):
            pairs, of_pair = np.unique(of_context[known] * len(words) + of_word[known], return_inverse=True)
            own, its = np.divmod(pairs, len(words))
            at = self.successors.find(base[own] + number[its].astype(np.uint64), begin[own], end[own])
            codes = np.zeros(len(pairs), np.uint16)
            codes[at >= 0] = self.codes[at[at >= 0]]
            out[known] = codes[of_pair]
        return out


def quantised(count: np.ndarray) -> np.ndarray:
    """A code for each count, by a rule that no shard's counts change."""
    code = np.array(count, np.int64)
    large = code > 1 << EXACT_BITS
    code[large] = np.minimum(65535, (1 << EXACT_BITS) + 1 + ((np.log2(code[large]) - EXACT_BITS) * STEPS).astype(np.int64))
    return code.astype("<u2")


def counts_of(code: np.ndarray) -> np.ndarray:
    """The count that a code stands for, in the middle of those that have it."""
    step = code.astype(np.float64) - ((1 << EXACT_BITS) + 1)
    return np.where(step < 0, code.astype(np.float64), np.exp2(EXACT_BITS + (np.maximum(step, 0) + 0.5) / STEPS))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes as compressed byte planes, their amount before them."""
    raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<Q", len(x)) + _ZSTD.compress(raw, asbytes=True)


def _of_planes(raw: bytes, width: int) -> np.ndarray:
    n = struct.unpack_from("<Q", raw)[0]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(raw[8:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


def _steps(x: np.ndarray, width: int) -> bytes:
    """Ascending numbers by their differences, which take fewer bytes."""
    return _planes(np.diff(x, prepend=np.uint64(0)), width)


def _of_steps(raw: bytes, width: int) -> np.ndarray:
    return np.cumsum(_of_planes(raw, width), dtype=np.uint64)


def _counts(x: np.ndarray) -> bytes:
    wide = len(x) and x.max() > 255
    return (b"8" if wide else b"1") + x.astype(np.int64 if wide else np.uint8).tobytes()


def _of_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if raw[:1] == b"8" else np.uint8, offset=1).astype(np.int64)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, bits: int):
    """The distinct bigrams of a batch in the order of their shards: number of context and word, bucket, and for each token
    the place of its bigram.  Both the sender and the reader of answers go by this order."""
    begin = int(np.searchsorted(vocabulary, _BEGIN))
    before = np.r_[begin, tokens[:-1]]
    before[np.cumsum(sizes)[:-1]] = begin
    both, place = np.unique(before * len(vocabulary) + tokens, return_inverse=True)
    context, word = np.divmod(both, len(vocabulary))
    bucket = (mix(vocabulary[context] * np.uint64(0x9E3779B97F4A7C15) + vocabulary[word]) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return context[order], word[order], bucket[order], back[place]


class _Batch:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, words: np.ndarray) -> None:
        self.ids.append(doc)
        self.parts.append(np.append(words, _END))
        self.size += len(words) + 1

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens, tokens of each document, the vocabulary in order, and which tokens are for training."""
        sizes = np.array([len(x) for x in self.parts], np.int64)
        vocabulary, tokens = np.unique(np.concatenate([np.array([_BEGIN, _END]), *self.parts]), return_inverse=True)
        train = np.repeat([not held_out(d) for d in self.ids], sizes)
        return tokens[2:], sizes, vocabulary, train

    def head(self, name: str) -> Iterator[pa.RecordBatch]:
        """What the batch holds."""
        tokens, sizes, vocabulary, _ = self.tokens()
        ids = np.array([_NO_ID if d is None else d for d in self.ids], np.int64)
        yield _rows(name, _HEAD, [0], [(ids.tobytes(), sizes.tobytes(), _planes(tokens, 4), _steps(vocabulary, 8), b"")])

    def words(self, name: str, bits: int) -> Iterator[pa.RecordBatch]:
        tokens, _, vocabulary, train = self.tokens()
        yield from _word_rows(name, tokens, vocabulary, train, bits)

    def words_and_pairs(self, name: str, bits: int) -> Iterator[pa.RecordBatch]:
        tokens, sizes, vocabulary, train = self.tokens()
        yield from _word_rows(name, tokens, vocabulary, train, bits)
        context, word, bucket, place = _pairs(tokens, sizes, vocabulary, bits)
        count = np.bincount(place[train], minlength=len(bucket))
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        short = vocabulary >> np.uint64(24)
        for i in range(0, len(cuts) - 1, 64):
            part = list(zip(cuts[i:i + 64], cuts[i + 1:i + 65], strict=False))
            yield _rows(name, _PAIRS, [int(bucket[s]) for s, _ in part],
                        [(_steps(short[context[s:e]], 5), _planes(short[word[s:e]], 5), _counts(count[s:e]), b"", b"") for s, e in part])


def _rows(name: str, kind: int, buckets: list[int], bodies: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(buckets), pa.string()), pa.array([kind] * len(buckets), pa.int32()), pa.array(buckets, pa.int32()),
                                       *(pa.array(list(c), pa.binary()) for c in zip(*bodies, strict=True))], names=["batch", "kind", "bucket", *"abcde"])


def _word_rows(name: str, tokens: np.ndarray, vocabulary: np.ndarray, train: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    count = np.bincount(tokens[train], minlength=len(vocabulary))
    bucket = (vocabulary >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    yield _rows(name, _WORDS, [int(bucket[s]) for s in cuts[:-1]],
                [(_steps(vocabulary[s:e], 8), _counts(count[s:e]), b"", b"", b"") for s, e in zip(cuts[:-1], cuts[1:], strict=True)])


def _gatherer(send: Callable[[_Batch, str], Iterator[pa.RecordBatch]]):
    """Batches of a partition's documents, named by the partition and their number in it, and what is sent of each."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held = 0, 0, _Batch()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                part = some.column(2)[0].as_py()
                words, starts = hashed_words(some.column(1))
                for i, doc in enumerate(some.column(0).to_pylist()):
                    held.add(doc, words[starts[i]:starts[i + 1]])
                if held.size >= FLUSH:
                    yield from send(held, f"{part}-{count}")
                    count, held = count + 1, _Batch()
        if held.ids:
            yield from send(held, f"{part}-{count}")
    return gather


def _words_counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A bucket's words, their training counts, and the words of each row."""
    asked = [_of_steps(x, 8) for x in table["a"].to_pylist()]
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.bincount(place, np.concatenate([_of_counts(x) for x in table["b"].to_pylist()]), len(words)).astype(np.int64)
    return words, count, asked


def _totals(table: pa.Table) -> pa.Table:
    _, count, _ = _words_counted(table)
    return pa.table({"tokens": pa.array([int(count.sum())], pa.int64()), "words": pa.array([int((count > 0).sum())], pa.int64())})


def _asked_pairs(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Contexts, words and training counts of a shard's bigrams, by row."""
    return tuple([f(x) for x in table[c].to_pylist()] for c, f in (("a", lambda x: _of_steps(x, 5)), ("b", lambda x: _of_planes(x, 5)), ("c", _of_counts)))


def _trie_of(contexts: list[np.ndarray], words: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    every = np.concatenate(counts)
    seen = every > 0
    return Trie.build(np.concatenate(contexts)[seen], np.concatenate(words)[seen], every[seen])


def _answers(table: pa.Table, bodies: list[bytes]) -> pa.Table:
    empty = pa.array([b""] * table.num_rows, pa.binary())
    return pa.table({"batch": table["batch"], "kind": table["kind"], "bucket": table["bucket"], "a": pa.array(bodies, pa.binary()), **dict.fromkeys("bcde", empty)})


def _codes_of(trie: Trie, contexts: list[np.ndarray], words: list[np.ndarray]) -> list[bytes]:
    codes = trie.numerators(np.concatenate(contexts), np.concatenate(words))
    return [_planes(x, 2) for x in np.split(codes, np.cumsum([len(c) for c in contexts])[:-1])]


def _answered(table: pa.Table) -> pa.Table:
    """Answers of a shard: what the words count, or the codes of the bigrams."""
    if table["kind"][0].as_py() == _WORDS:
        words, count, asked = _words_counted(table)
        return _answers(table, [_counts(count[np.searchsorted(words, x)]) for x in asked])
    contexts, words, counts = _asked_pairs(table)
    return _answers(table, _codes_of(Trie(_trie_of(contexts, words, counts)), contexts, words))


#: A kept model: a row per shard; the number of its buckets' bits, what its words count, and its levels.
MODEL = "kind int, bucket int, bits int, tokens long, words long, body binary"


def _kept(bits: int):
    def keep(table: pa.Table) -> pa.Table:
        kind, tokens, distinct = table["kind"][0].as_py(), 0, 0
        if kind == _WORDS:
            words, count, _ = _words_counted(table)
            words, count = words[count > 0], count[count > 0]
            tokens, distinct = int(count.sum()), len(words)
            level = EliasFano.of(words >> np.uint64(8)).tobytes()
            body = struct.pack("<Q", len(level)) + level + (words & np.uint64(255)).astype(np.uint8).tobytes() + count.astype("<i8").tobytes()
        else:
            body = _trie_of(*_asked_pairs(table))
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int32()),
                         "tokens": pa.array([tokens], pa.int64()), "words": pa.array([distinct], pa.int64()), "body": pa.array([body], pa.binary())})
    return keep


def _word_counts(body: memoryview, words: np.ndarray) -> np.ndarray:
    """Training counts of words in a kept level of words: 56 bits of their hashes in Elias-Fano form, 8 beside them."""
    level, = struct.unpack_from("<Q", body)
    known, _ = EliasFano.open(body, 8)
    rest = np.frombuffer(body, np.uint8, known.n, 8 + level)
    counts = np.frombuffer(body, "<i8", known.n, 8 + level + known.n)
    at = known.find(words >> np.uint64(8))
    out = np.zeros(len(words), np.int64)
    some = np.flatnonzero(at >= 0)
    at, tail = at[some], (words[some] & np.uint64(255)).astype(np.uint8)
    head = words[some] >> np.uint64(8)
    # words that share the first 56 bits stand one after the other
    while len(some):
        hit = rest[at] == tail
        out[some[hit]] = counts[at[hit]]
        at, some, tail, head = at[~hit] + 1, some[~hit], tail[~hit], head[~hit]
        more = at < known.n
        more[more] = known.values(at[more]) == head[more]
        at, some, tail, head = at[more], some[more], tail[more], head[more]
    return out


def _answered_by(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Answers of a kept shard, whose levels are read where they lie; what no shard knows counts 0."""
    body = memoryview(model["body"][0].as_buffer()) if model.num_rows else None
    if not asked.num_rows:
        return _answers(asked, [])
    if asked["kind"][0].as_py() == _WORDS:
        words = [_of_steps(x, 8) for x in asked["a"].to_pylist()]
        return _answers(asked, [_counts(np.zeros(len(x), np.int64) if body is None else _word_counts(body, x)) for x in words])
    contexts, words, _ = _asked_pairs(asked)
    if body is None:
        return _answers(asked, [_planes(np.zeros(len(x), np.uint16), 2) for x in words])
    return _answers(asked, _codes_of(Trie(body), contexts, words))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(total: int, distinct: int, bits: int):
    def score(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("kind", "bucket", "a", "b", "c", "d")), strict=True), key=lambda r: r[:2])
        _, _, ids, sizes, tokens, vocabulary = rows[0]
        ids, sizes, tokens, vocabulary = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), _of_planes(tokens, 4).astype(np.int64), _of_steps(vocabulary, 8)
        count = np.concatenate([_of_counts(r[2]) for r in rows if r[0] == _WORDS])
        numerator = counts_of(np.concatenate([_of_planes(r[2], 2) for r in rows if r[0] == _PAIRS]))
        context, _, _, place = _pairs(tokens, sizes, vocabulary, bits)
        # a text begins as often as one ends
        before = count.copy()
        before[np.searchsorted(vocabulary, _BEGIN)] = count[np.searchsorted(vocabulary, _END)]
        mass = total + distinct + 1
        single = (count[tokens] + 1) / mass
        likely = (numerator[place] + MU * single) / (before[context[place]] + MU)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        each = lambda x: np.add.reduceat(x, starts)
        names = [None if x == _NO_ID else x for x in ids.tolist()]
        return pa.table({"doc_id": pa.array(names, pa.int64()), "held_out": pa.array([held_out(x) for x in names]), "n_tokens": pa.array(sizes),
                         "n_known": pa.array(each((count[tokens] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
                         "base_score": pa.array(each(np.log10(single))), "score": pa.array(each(np.log10(likely)))})
    return score


def _rows_of(docs: DataFrame) -> DataFrame:
    # the partition's own number names its batches alike in every pass over the documents
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))


def _bits(docs: DataFrame) -> int:
    return min(22, max(6, (4 * shuffle_partitions(docs.sparkSession) - 1).bit_length()))


def _combined(rows: DataFrame, answers: DataFrame, total: int, distinct: int, bits: int) -> DataFrame:
    heads = rows.mapInArrow(_gatherer(lambda batch, name: batch.head(name)), _ROW)   # read again rather than sent through the shards
    return answers.union(heads).groupBy("batch").applyInArrow(_scorer(total, distinct, bits), _SCORES)


def _summed(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per document row.  Training counts and
    questions take one way to the shards."""
    bits, rows = _bits(docs), _rows_of(docs)
    words = rows.mapInArrow(_gatherer(lambda batch, name: batch.words(name, bits)), _ROW)
    total, distinct = _summed(words.groupBy("bucket").applyInArrow(_totals, "tokens long, words long"))
    asked = rows.mapInArrow(_gatherer(lambda batch, name: batch.words_and_pairs(name, bits)), _ROW)
    return _combined(rows, asked.groupBy("kind", "bucket").applyInArrow(_answered, _ROW), total, distinct, bits)


def trained(docs: DataFrame) -> DataFrame:
    """The model of the documents that are not held out, to be written as a table: a row per shard (``MODEL``)."""
    bits = _bits(docs)
    sent = _rows_of(docs).mapInArrow(_gatherer(lambda batch, name: batch.words_and_pairs(name, bits)), _ROW)
    return sent.groupBy("kind", "bucket").applyInArrow(_kept(bits), MODEL)


def scored_by(docs: DataFrame, model: DataFrame) -> DataFrame:
    """What ``scored`` returns, by a kept model; the documents add nothing to it.  An empty model knows no word."""
    bits = model.agg(F.max("bits")).first()[0] or _bits(docs)
    total, distinct = _summed(model)
    rows = _rows_of(docs)
    asked = rows.mapInArrow(_gatherer(lambda batch, name: batch.words_and_pairs(name, bits)), _ROW)
    answers = asked.groupBy("kind", "bucket").cogroup(model.groupBy("kind", "bucket")).applyInArrow(_answered_by, _ROW)
    return _combined(rows, answers, total, distinct, bits)
