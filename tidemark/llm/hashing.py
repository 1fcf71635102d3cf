"""Words of many texts at once, as 64-bit hashes: numpy over the bytes of an Arrow column, no loop over words.

Words are runs of characters that are no blanks, with A-Z in lower case.  Two different words share a hash with a chance of
about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BLANK = np.isin(_BYTES, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking number for each byte, after lower-casing.
_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(12345))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n, BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _hash(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a block of bytes and their first bytes; no word reaches over the start of a text."""
    n = len(data)
    up, down = _power(n)
    inside = ~_BLANK[data]
    fresh = np.zeros(n + 1, bool)
    fresh[starts_of_texts] = True
    before = np.r_[False, inside[:-1]] & ~fresh[:n]
    after = np.r_[inside[1:], False] & ~fresh[1:]
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    sums = np.cumsum(_VALUE[data] * up[:n])
    total = sums[last] - np.where(first > 0, sums[np.maximum(first, 1) - 1], np.uint64(0))
    return mix(total * down[first] + (last - first + 1).astype(np.uint64) * _ODD), first


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in order, and the places where each text's words start (one more than texts).  A null
    text has no words."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    hashes, starts, i = [], [np.zeros(1, np.int64)], 0
    done = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        a, b = offsets[i], offsets[j]
        h, first = _hash(data[a:b], offsets[i:j] - a) if b > a else (np.empty(0, np.uint64), np.empty(0, np.int64))
        hashes.append(h)
        starts.append(done + np.searchsorted(first, offsets[i + 1:j + 1] - a))
        done += len(h)
        i = j
    return np.concatenate(hashes), np.concatenate(starts)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = out * _BASE + words[k:k + n]
    return mix(out)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct windows of a text, sorted; with fewer words than a window, the whole sequence as one."""
    return np.unique(windows(words, size if len(words) >= size else len(words))) if len(words) else np.empty(0, np.uint64)
