"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without blanks at both ends, with A-Z in lower case; keys of fewer than ``LEAST`` code points are
never dropped.  Keys are dealt to shards by hash.  A shard holds an exact table (key, number of documents that hold it, the
smallest of their ids) and a cuckoo filter over its keys.  The filter answers first: a key that it does not know is new and
is appended without looking at the table; only the others are searched for.  Both take insertions and deletions, so a corpus
can grow and documents can be taken back.

Documents are dealt to bounded batches by a hash of their id; a batch sends each shard one row with its distinct keys, how
many of its documents hold each, and the smallest id.  A line that half the corpus shares is thus one entry per batch.  The
shard answers each batch with the smallest holder of the keys that several documents hold, and the batch drops its lines.

Defined results: a null or empty text is one empty line; rows with the same doc_id, null included, are one document; a null
id counts as the largest.  Lines repeated inside the smallest document all stay.  Keys are compared by 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh, shuffle_partitions

LEAST = 10
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Stands for a null id among the holders.
NO_ID = np.iinfo(np.int64).max
#: Fingerprints in a bucket of the cuckoo filter, rounds of moving before it doubles, and how full it may be.
SLOTS, ROUNDS, FULL = 4, 200, 0.8

_WORK = "batch int, shard int, body binary"


def line_key(line: bytes) -> bytes | None:
    """The 16-byte key of a line, None for one that is too short to be dropped."""
    key = line.strip(BLANK_BYTES).lower()
    # code points: bytes that do not continue one
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, either of which follows from the other."""

    def __init__(self, buckets: int = 64):
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.size = 0

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)
        return (bucket ^ step) & np.uint64(len(self.table) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return keys & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, b = self._prints(keys), self._first(keys)
        here = (self.table[b] == p[:, None]).any(1)
        return here | (self.table[self._other(b, p)] == p[:, None]).any(1)

    def insert(self, keys: np.ndarray, known: np.ndarray) -> None:
        """keys: new ones; known: all keys that the exact table held before, from which a filter that is too full is rebuilt."""
        if self.size + len(keys) > FULL * self.table.size or not self._place(keys):
            buckets, every = len(self.table), np.concatenate([known, keys])
            while True:
                buckets *= 2
                self.__init__(buckets)
                if len(every) <= FULL * self.table.size and self._place(every):
                    return

    def _place(self, keys: np.ndarray) -> bool:
        prints, bucket = self._prints(keys), self._first(keys)
        bucket = np.where(np.arange(len(keys)) % 2 == 0, bucket, self._other(bucket, prints))
        for turn in range(ROUNDS):
            if not len(prints):
                self.size += len(keys)
                return True
            # the waiting ones of a bucket take its free slots in order
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = (np.cumsum(free, 1) > rank[:, None]).argmax(1)
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, rank = prints[~fits], bucket[~fits], rank[~fits]
            if turn % 2 and len(prints):
                # the first waiting one of a bucket changes places with a resident, which goes to its other bucket
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                at = (turn // 2) % SLOTS
                out = self.table[bucket[first], at].copy()
                self.table[bucket[first], at] = prints[first]
                prints[first] = out
            bucket = self._other(bucket, prints)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Keys that were inserted, each once."""
        prints, first = self._prints(keys), self._first(keys)
        for p, b, o in zip(prints, first, self._other(first, prints), strict=True):
            for at in (b, o):
                hit = np.flatnonzero(self.table[at] == p)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    self.size -= 1
                    break


class Shard:
    """The exact reference counts of a shard's keys and the filter in front of them."""

    KEY = np.dtype([("a", "<u8"), ("b", "<u8")])

    def __init__(self) -> None:
        self.keys = np.empty(0, self.KEY)
        self.refs = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.filter = CuckooFilter()

    def insert(self, keys: np.ndarray, refs: np.ndarray, first: np.ndarray) -> None:
        """Distinct keys with the number of new documents that hold each and the smallest of them."""
        maybe = self.filter.contains(keys["a"])
        at = np.full(len(keys), -1)
        at[maybe] = self.find(keys[maybe])
        old = at >= 0
        self.refs[at[old]] += refs[old]
        np.minimum.at(self.first, at[old], first[old])
        if not old.all():
            self.filter.insert(keys["a"][~old], self.keys["a"])
            self._set(np.concatenate([self.keys, keys[~old]]), np.concatenate([self.refs, refs[~old]]), np.concatenate([self.first, first[~old]]))

    def remove(self, keys: np.ndarray, refs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Takes documents back; returns the keys whose smallest holder went while others remain (see ``repair``).  Keys that
        the table does not hold, or not as often, are refused before anything changes."""
        at = self.find(keys)
        if (at < 0).any() or (self.refs[at] < refs).any():
            raise ValueError("documents to be taken back hold lines that were never counted in")
        self.refs[at] -= refs
        orphans = keys[(self.refs[at] > 0) & (self.first[at] >= first)]
        gone = self.refs <= 0
        self.filter.remove(self.keys["a"][gone])
        self._set(self.keys[~gone], self.refs[~gone], self.first[~gone])
        return orphans

    def repair(self, keys: np.ndarray, first: np.ndarray) -> None:
        self.first[self.find(keys)] = first

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the table, -1 for those it does not hold."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys["a"], keys["a"]), len(self.keys) - 1)
        # keys that share their first half stand together; the second half decides
        while True:
            move = (self.keys["a"][at] == keys["a"]) & (self.keys["b"][at] < keys["b"]) & (at + 1 < len(self.keys))
            move[move] = self.keys["a"][at[move] + 1] == keys["a"][move]
            if not move.any():
                break
            at = at + move
        return np.where(self.keys[at] == keys, at, -1)

    def _set(self, keys: np.ndarray, refs: np.ndarray, first: np.ndarray) -> None:
        order = np.lexsort((keys["b"], keys["a"]))
        self.keys, self.refs, self.first = keys[order], refs[order], first[order]

    def pack(self) -> dict:
        return {"keys": self.keys.tobytes(), "refs": self.refs.tobytes(), "first": self.first.tobytes(), "filter": self.filter.table.tobytes()}

    @classmethod
    def unpack(cls, keys: bytes, refs: bytes, first: bytes, filter: bytes) -> Shard:
        out = cls()
        out.keys, out.refs, out.first = np.frombuffer(keys, cls.KEY).copy(), np.frombuffer(refs, np.int64).copy(), np.frombuffer(first, np.int64).copy()
        out.filter.table = np.frombuffer(filter, np.uint16).reshape(-1, SLOTS).copy()
        out.filter.size = int((out.filter.table > 0).sum())
        return out


_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("refs", "<i8"), ("first", "<i8")])
_ANSWER = np.dtype([("a", "<u8"), ("b", "<u8"), ("first", "<i8")])


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _entries(ids: list, texts: list) -> np.ndarray:
    """Distinct keys of a batch with the number of its documents that hold them and the smallest of these."""
    held: dict[bytes, set | int] = {}
    for doc, text in zip(ids, texts, strict=True):
        doc = NO_ID if doc is None else doc
        for key in {line_key(x) for x in _lines(text)}:
            if key is not None:
                got = held.get(key)
                if got is None:
                    held[key] = doc
                elif isinstance(got, set):
                    got.add(doc)
                elif got != doc:
                    held[key] = {got, doc}
    out = np.empty(len(held), _ENTRY)
    if held:
        halves = np.frombuffer(b"".join(held), Shard.KEY)
        out["a"], out["b"] = halves["a"], halves["b"]
        out["refs"] = [len(x) if isinstance(x, set) else 1 for x in held.values()]
        out["first"] = [min(x) if isinstance(x, set) else x for x in held.values()]
    return out


def _sender(shards: int, doc_id: str, text: str, batch: str):
    def send(table: pa.Table) -> pa.Table:
        found = _entries(table[doc_id].to_pylist(), table[text].to_pylist())
        shard = (found["a"] >> np.uint64(32)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        found, shard = found[order], shard[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(found) else np.empty(0, int)
        parts = np.split(found, cuts[1:]) if len(found) else []
        return pa.table({"batch": pa.array([table[batch][0].as_py()] * len(parts), pa.int32()), "shard": pa.array(shard[cuts].astype(np.int32), pa.int32()),
                         "body": pa.array([x.tobytes() for x in parts], pa.binary())})
    return send


def _merged(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bodies joined, some thousands of entries at a time, with each key once."""
    part, size = [], 0
    for i, body in enumerate(bodies):
        part.append(body)
        size += len(body)
        if size >= 4 << 20 or i == len(bodies) - 1:
            e = np.frombuffer(b"".join(part), _ENTRY)
            order = np.lexsort((e["b"], e["a"]))
            e = e[order]
            new = np.r_[True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])] if len(e) else np.empty(0, bool)
            at = np.flatnonzero(new)
            keys = np.empty(len(at), Shard.KEY)
            keys["a"], keys["b"] = e["a"][at], e["b"][at]
            yield keys, np.add.reduceat(e["refs"], at) if len(at) else e["refs"], np.minimum.reduceat(e["first"], at) if len(at) else e["first"]
            part, size = [], 0


def _filled(bodies: list[bytes], shard: Shard | None = None) -> Shard:
    shard = shard or Shard()
    for keys, refs, first in _merged(bodies):
        shard.insert(keys, refs, first)
    return shard


def _answer(shard: Shard, body: bytes) -> bytes:
    e = np.frombuffer(body, _ENTRY)
    keys = np.empty(len(e), Shard.KEY)
    keys["a"], keys["b"] = e["a"], e["b"]
    at = shard.find(keys)
    shared = (at >= 0) & (shard.refs[at] > 1)
    out = np.empty(int(shared.sum()), _ANSWER)
    out["a"], out["b"], out["first"] = e["a"][shared], e["b"][shared], shard.first[at[shared]]
    return out.tobytes()


def _answered(table: pa.Table) -> pa.Table:
    bodies = table["body"].to_pylist()
    shard = _filled(bodies)
    return pa.table({"batch": table["batch"], "shard": table["shard"], "body": pa.array([_answer(shard, x) for x in bodies], pa.binary())})


def _rewriter(schema: pa.Schema, doc_id: str, text: str, counts: tuple[str, str], batch: str):
    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(right["body"].to_pylist()), _ANSWER)
        pair = np.empty(len(found), Shard.KEY)
        pair["a"], pair["b"] = found["a"], found["b"]
        raw = pair.tobytes()
        holder = {raw[i * 16:i * 16 + 16]: int(x) for i, x in enumerate(found["first"])}
        texts, total, dropped = [], [], []
        for doc, whole in zip(left[doc_id].to_pylist(), left[text].to_pylist(), strict=True):
            doc = NO_ID if doc is None else doc
            lines = _lines(whole)
            kept = [x for x in lines if holder.get(line_key(x), doc) == doc]
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            total.append(len(lines))
            dropped.append(len(lines) - len(kept))
        out = {c: left[c] for c in left.column_names if c != batch}
        out[text] = pa.array(texts, pa.string())
        out[counts[0]], out[counts[1]] = pa.array(total, pa.int64()), pa.array(dropped, pa.int64())
        return pa.table([out[f.name] for f in schema], schema=schema)
    return rewrite


def _dealt(docs: DataFrame, batches: int) -> tuple[DataFrame, str]:
    batch = fresh(docs, "line_batch")
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    return docs.withColumn(batch, dealt).repartition(batches, batch), batch


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Batches of documents and shards of keys: both follow the session's shuffle partitions, which follow the data."""
    n = shuffle_partitions(docs.sparkSession)
    return 8 * n, 2 * n


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without its dropped lines, and two more columns: lines before dropping, and lines dropped (the last
    two columns).  Other columns pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    batches, shards = _sizes(docs)
    rows, batch = _dealt(docs.withColumn("text", F.col("text").cast("string")), batches)
    sent = rows.select("doc_id", "text", batch).groupBy(batch).applyInArrow(_sender(shards, "doc_id", "text", batch), _WORK)
    answers = sent.groupBy("shard").applyInArrow(_answered, _WORK)
    names = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    result = docs.withColumn("text", F.col("text").cast("string")).withColumns({n: F.lit(0).cast("long") for n in names}).schema
    rewrite = _rewriter(to_arrow_schema(result), "doc_id", "text", names, batch)
    return rows.groupBy(batch).cogroup(answers.groupBy("batch")).applyInArrow(rewrite, result)


_STATE = "shard int, keys binary, refs binary, first binary, filter binary"


def _sent(docs: DataFrame, batches: int, shards: int) -> DataFrame:
    rows, batch = _dealt(docs.select("doc_id", F.col("text").cast("string").alias("text")), batches)
    return rows.groupBy(batch).applyInArrow(_sender(shards, "doc_id", "text", batch), _WORK)


def _state_row(shard_id: int, shard: Shard) -> pa.Table:
    return pa.table({"shard": pa.array([shard_id], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in shard.pack().items()}})


def _loaded(state: pa.Table) -> Shard:
    return Shard.unpack(*(state[c][0].as_py() for c in ("keys", "refs", "first", "filter"))) if state.num_rows else Shard()


def insert_documents(state: DataFrame | None, docs: DataFrame, shards: int) -> DataFrame:
    """The state (a row per shard: its exact table and its filter) with the documents' lines counted in.  ``shards`` stays
    the same for the life of a state."""
    sent = _sent(docs, _sizes(docs)[0], shards)
    if state is None:
        return sent.groupBy("shard").applyInArrow(lambda t: _state_row(t["shard"][0].as_py(), _filled(t["body"].to_pylist())), _STATE)

    def add(old: pa.Table, new: pa.Table) -> pa.Table:
        return _state_row((old if old.num_rows else new)["shard"][0].as_py(), _filled(new["body"].to_pylist(), _loaded(old)))
    return state.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(add, _STATE)


def delete_documents(state: DataFrame, removed: DataFrame, remaining: DataFrame, shards: int) -> DataFrame:
    """The state without ``removed``, documents that it holds; others are refused.  Where the smallest holder of a line goes, the next one comes
    from the lines of ``remaining``."""
    batches = _sizes(removed)[0]
    gone = _sent(removed, batches, shards).withColumn("batch", F.lit(-1))
    both = gone.unionByName(_sent(remaining, batches, shards))

    def take(old: pa.Table, rows: pa.Table) -> pa.Table:
        shard, of = _loaded(old), rows["batch"].to_numpy()
        bodies = rows["body"].to_pylist()
        orphans = [shard.remove(*x) for x in _merged([b for b, n in zip(bodies, of, strict=True) if n < 0])]
        lost = np.concatenate([np.empty(0, Shard.KEY), *orphans])
        lost = lost[shard.find(lost) >= 0]
        if len(lost):
            rest = _filled([b for b, n in zip(bodies, of, strict=True) if n >= 0])
            shard.repair(lost, rest.first[rest.find(lost)])
        return _state_row((old if old.num_rows else rows)["shard"][0].as_py(), shard)
    return state.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(take, _STATE)


def holders(state: DataFrame) -> DataFrame:
    """The exact table: key (hex), refs, first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys = b["keys"][i].as_py()
                yield pa.RecordBatch.from_pydict({"key": [keys[k:k + 16].hex() for k in range(0, len(keys), 16)],
                                                  "refs": np.frombuffer(b["refs"][i].as_py(), np.int64), "first": np.frombuffer(b["first"][i].as_py(), np.int64)})
    return state.mapInArrow(rows, "key string, refs long, first long")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text, a row per document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, held.key IS NOT NULL AND held.first <> doc_id AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
