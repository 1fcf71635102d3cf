"""Secret scans: patterns, and the novelty of what stands in sensitive places, measured by a primed compressor.

Patterns find assignments to sensitive names, access keys and long hexadecimal runs.  Other secrets have no form of their own:
they are strings in a sensitive place that nothing around them explains.  A candidate is a run of at least ``LEAST`` key
characters after a sensitive word on its line.  zstandard, primed with a dictionary of the words that make up the corpus's
identifiers, compresses the text around the candidate without and with it; the difference is what the candidate costs.  A
name or a word costs little, since its parts stand in the dictionary or in the text around; a string that costs
``SHARE`` bytes a character or more is not compressible by anything known there and is reported as novel.

The dictionary comes from all documents: parts of identifiers (runs of letters, split where a lower-case letter meets an
upper-case one), counted inside tasks, then on the map side, by documents.  The ``WORDS`` most frequent ones
are the dictionary, at most WORDS x (LONGEST + 1) bytes.  Runs with digits are no part of it, so a key does not get
in by being copied often.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; a null id is an id.  Candidates that
overlap a span of a pattern are left to it.  Texts are scanned whole; what counts as around a candidate are ``AROUND`` code
points on either side.  Places are code points, the end exclusive.  An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh

#: What is looked for, and the least length of the part that says whether a match is kept.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),   # shorter runs would be dropped
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Names without one of which no assignment matches.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: What makes a place sensitive, and how many code points before a candidate are looked at.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|signature|signing|encryption|webhook", re.ASCII | re.IGNORECASE)
REACH = 64
LEAST, SHARE, AROUND, LEVEL = 16, 0.9, 256, 1
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: What a short dictionary is padded to: the compressor's tables follow its size, and with them what a string costs.
PADDED = 1 << 16
WORDS, SHORTEST, LONGEST, SHARDS = 8192, 3, 24, 16

#: Parts of identifiers that a task counts before it hands them on, and the bytes of text that are split at a time.
HELD, PIECE = 400_000, 1 << 20
_LETTERS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 0x20 for b in range(256))
#: No match starts in the last bytes of what is compressed; these bytes are the same both times.
_TAIL = b"\n" * 16
_CAMEL = re.compile(rb"(?<=[a-z])(?=[A-Z])")
_FOUND = "spans array<struct<kind:string,start:int,end:int,cost:int>>"


def parts_of(text: bytes) -> set[bytes]:
    """The distinct parts of the identifiers of a text, in lower case."""
    out: set[bytes] = set()
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _LETTERS[text[end]] != 0x20:
            end += 1
        words = {w for w in set(text[at:end].translate(_LETTERS).split()) if w.isalpha()}
        whole = {w for w in words if w.islower() or w[1:].islower() or w.isupper()}
        out.update(w.lower() for w in whole)
        for w in words - whole:
            out.update(p.lower() for p in _CAMEL.split(w))
        at = end
    return {p for p in out if SHORTEST <= len(p) <= LONGEST}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(parts_of(text or b""))
            if len(held) > HELD:
                yield pa.RecordBatch.from_pydict({"word": pa.array([*held], pa.binary()).cast(pa.string()), "n": pa.array([*held.values()], pa.int64())})
                held.clear()
    yield pa.RecordBatch.from_pydict({"word": pa.array([*held], pa.binary()).cast(pa.string()), "n": pa.array([*held.values()], pa.int64())})


def dictionary(docs: DataFrame) -> bytes:
    """The parts of identifiers that most documents hold, the most frequent last, where a compressor reaches them cheapest."""
    counts = docs.select(F.col("`text`").cast("string").cast("binary").alias("text")).mapInArrow(_parts, "word string, n long")
    order = (F.desc("n"), F.col("word"))
    # each of a few shards keeps its best, so that what is ordered last does not grow with the corpus
    shard = Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(SHARDS))).orderBy(*order)
    kept = counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(shard)).where(F.col("place") <= WORDS)
    best = kept.orderBy(*order).limit(WORDS).collect()
    return " ".join(r["word"] for r in reversed(best)).encode()


class Novelty:
    """What a string costs beside the text around it."""

    def __init__(self, words: bytes):
        primer = zstandard.ZstdCompressionDict(words.rjust(PADDED), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=LEVEL)
        self._packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False)

    def cost(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - AROUND):start] + text[end:end + AROUND]).encode("utf-8", "replace")
        return self._size(around + text[start:end].encode()) - self._size(around)

    def _size(self, text: bytes) -> int:
        return len(self._packer.compress(text + _TAIL))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind."""
    out = []
    lowered = text.encode("utf-8", "replace").lower()
    for k, kind in enumerate(KINDS):
        if kind == "assign" and not any(name in lowered for name in NAMES) or kind == "access" and "AKIA" not in text:
            continue
        pattern, group, least = PATTERNS[kind]
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters in a sensitive place that overlap no span of ``taken``."""
    if not SENSITIVE.search(text):
        return
    spans = sorted((start, end) for start, _, end in taken)
    k, reached = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reached = max(reached, spans[k][1])
            k += 1
        if reached <= start:
            line = text.rfind("\n", max(0, start - REACH), start) + 1
            if SENSITIVE.search(text, max(line, start - REACH, 0), start):
                yield start, end


def _scanner(words: bytes, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Novelty(words)
        for batch in batches:
            out = []
            for text in batch.column(column).to_pylist():
                text = text or ""
                spans = base_spans(text)
                costs = [(start, end, judge.cost(text, start, end)) for start, end in candidates(text, spans)]
                found = [(s, k, e, None) for s, k, e in spans] + [(s, len(KINDS), e, c) for s, e, c in costs if c >= SHARE * (e - s)]
                out.append([{"kind": (*KINDS, "novel")[k], "start": s, "end": e, "cost": c} for s, k, e, c in sorted(found, key=lambda f: f[:2])])
            arrays = [*batch.columns, pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_spans"])
    return scan


def scanned(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """docs with one more column, the secrets of the text: kind, start, end, and cost for novel ones.  ``words``: a
    dictionary made before; made from docs where there is none."""
    words = dictionary(docs) if words is None else words
    name = fresh(docs, "secrets")
    kinds = _FOUND.removeprefix("spans ")
    rows = docs.select(F.col("`text`").cast("string").alias("text"), F.struct("*").alias("row"))
    out = rows.mapInArrow(_scanner(words, "text"), f"text string, row {docs.schema.simpleString()}, _spans {kinds}")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("_spans").alias(name))


def redacted(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """docs with every secret replaced by its kind in brackets; a span that reaches into another goes with it."""
    out = scanned(docs, words)
    text, spans = F.col("`text`").cast("string"), out.columns[-1]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        kept = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), kept.alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    clean = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return out.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and places of secrets, a row per row of docs."""
    slim = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    words = dictionary(slim)
    report = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])
    scan = _scanner(words, "text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            rows = []
            for doc, spans in zip(batch.column("doc_id").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                each = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                n, base = Counter(k for k, _ in each), ",".join(t for k, t in each if k != "novel")
                rows.append({"doc_id": doc, **{f"n_{k}": n[k] for k in KINDS}, "base_sha256": hashlib.sha256(base.encode()).hexdigest(),
                             "spans": ",".join(t for _, t in each), "n_novel": n["novel"]})
            yield pa.RecordBatch.from_pylist(rows, report)
    return slim.mapInArrow(told, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_novel long")
