"""Media columns: bytes stored as MPEG transport streams, and streams read back.

A stream has a program association table, a program map table and one elementary stream of private data.  The payload is cut
into access units of ``UNIT`` bytes; each is a packetised elementary stream packet with a presentation time, every
``RANDOM_EVERY``-th one a random-access point with a clock reference, split into 188-byte transport packets with continuity
counters and stuffing.

Reading takes any such stream: it finds the programs by their tables, whose sections may lie over several packets or share
one (a section whose checksum fails or that a gap cuts is ignored; the last version counts), checks continuity counters,
drops packets that repeat the one before byte for byte, joins elementary packets, and reports times and random-access points.

Defined results: null bytes are empty; bytes are padded with zeros to a positive multiple of ``BLOCK``; equal bytes give
equal streams.  Of a broken stream, what can be read is returned, with the number of errors: bytes beyond whole packets, bad
packets, gaps that no discontinuity flag announces, missing tables, units without a start or of another length than they say.
A stream without tables has an empty payload, a null one no error either.  Rows are independent of each other, repeated ids included.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, BLOCK, UNIT = 188, 64, 32768
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Clock ticks between access units (90 kHz), and how many units lie between random-access points.
TICKS, RANDOM_EVERY = 3600, 4
#: Rows that a task holds at a time.
ROWS = 128

# fixed values of the format: the stream type and the stream id of private data, the checksum's polynomial
PRIVATE_TYPE, PRIVATE_ID, POLYNOMIAL = 0x06, 0xBD, 0x04C11DB7
_HEAD = 14


@lru_cache(4096)
def checksum(section: bytes) -> int:
    """The checksum of table sections; 0 for a section that ends with its own."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section_packet(pid: int, table: int, number: int, body: bytes) -> np.ndarray:
    section = bytes([table]) + struct.pack(">H", 0xB000 | (len(body) + 9)) + struct.pack(">H", number) + b"\xc1\x00\x00" + body
    section += struct.pack(">I", checksum(section))
    packet = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\x00" + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _section_packet(0, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section_packet(PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))


def _time(stamp: int) -> bytes:
    return bytes([0x21 | (stamp >> 29) & 0x0E, (stamp >> 22) & 0xFF, 0x01 | (stamp >> 14) & 0xFE, (stamp >> 7) & 0xFF, 0x01 | (stamp << 1) & 0xFE])


def _stamp(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | (raw[2] >> 1) << 15 | raw[3] << 7 | raw[4] >> 1


def padded(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def write_stream(payload: bytes) -> bytes:
    """A transport stream of the payload, a positive number of bytes."""
    parts, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at:at + UNIT]
        stamp = k * TICKS
        unit = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + struct.pack(">H", len(data) + 8) + b"\x84\x80\x05" + _time(stamp) + data
        # the adaptation field of the first packet: flags, and at random-access points the clock reference
        lead = bytes([0x40 | 0x10]) + struct.pack(">IH", stamp >> 1, (stamp & 1) << 15 | 0x7E00) if k % RANDOM_EVERY == 0 else b""
        room = PACKET - 4 - (len(lead) + 1 if lead else 0)
        count = 1 + max(0, -(-(len(unit) - room) // (PACKET - 4)))
        out = np.full((count, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        raw = np.frombuffer(unit, np.uint8)
        first = min(room, len(raw)) if count > 1 else len(raw)
        if count > 1:
            middle = (count - 2) * (PACKET - 4)
            out[1:-1, 4:] = raw[first:first + middle].reshape(count - 2, PACKET - 4)
            rest = raw[first + middle:]
            if len(rest) < PACKET - 4:
                _field(out[-1], b"", PACKET - 4 - len(rest))
            out[-1, PACKET - len(rest):] = rest
        field = PACKET - 4 - first
        if field:
            _field(out[0], lead, field)
        out[0, PACKET - first:] = raw[:first]
        parts.append(out.ravel())
    return np.concatenate(parts).tobytes()


def _field(packet: np.ndarray, lead: bytes, size: int) -> None:
    """An adaptation field of ``size`` bytes, stuffed."""
    packet[3] |= 0x20
    packet[4] = size - 1
    if size > 1:
        packet[5] = 0
        packet[5:5 + len(lead)] = np.frombuffer(lead, np.uint8) if lead else packet[5:5]


def _bodies(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one PID: the packets that carry a payload and repeat none before them, which of them do not go on from the one
    before, and the number of gaps.  A packet with the counter and the payload of the one before repeats it, which is
    allowed once; a marked discontinuity is no error, though what it cuts is not joined."""
    own = packets[packets[:, 3] & 0x10 > 0]
    if not len(own):
        return own, np.empty(0, bool), 0
    start = _starts(own)
    step = np.diff(own[:, 3].astype(np.int64) & 15) & 15
    # a repeated packet may only differ in its clock reference, which lies before its payload
    inside = np.arange(PACKET) >= np.maximum(start[1:], start[:-1])[:, None]
    same = (step == 0) & (start[1:] == start[:-1]) & ((own[1:] == own[:-1]) | ~inside).all(axis=1)
    same &= ((own[1:, 1:3] == own[:-1, 1:3]).all(axis=1))
    again = np.r_[False, same]
    again[1:] &= ~again[:-1]
    own, start = own[~again], start[~again]
    step = np.diff(own[:, 3].astype(np.int64) & 15) & 15
    marked = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)
    cut = np.r_[False, step != 1] | marked
    return own, cut, int((np.r_[False, step != 1] & ~marked).sum())


def _starts(packets: np.ndarray) -> np.ndarray:
    """Where the payload of each packet starts."""
    return np.minimum(np.where(packets[:, 3] & 0x20 > 0, 5 + packets[:, 4].astype(np.int64), 4), PACKET)


def _sections(packets: np.ndarray) -> list[bytes]:
    """The sections of one PID whose checksum holds, over as many packets as they take; one that a gap cuts is lost."""
    own, cut, _ = _bodies(packets)
    out, held, at_work = [], bytearray(), False

    def take() -> bool:
        """Takes whole sections from what is held; whether more may follow."""
        while held and held[0] != 0xFF:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) >= 3 else PACKET * PACKET
            if len(held) < size:
                return True
            raw = bytes(held[:size])
            if size >= 12 and checksum(raw) == 0:
                out.append(raw)
            del held[:size]
        held.clear()
        return False

    for p, start, gap in zip(own, _starts(own), cut, strict=True):
        if gap:
            held.clear()
            at_work = False
        body = p[start:].tobytes()
        if p[1] & 0x40 and body:
            # the pointer: how many bytes still belong to the section before
            before, body = body[1:1 + body[0]], body[1 + body[0]:]
            if at_work:
                held += before
                take()
            held.clear()
            held += body
            at_work = take()
        elif at_work:
            held += body
            at_work = take()
    return out


def _table(packets: np.ndarray, table: int, program: int | None = None) -> list[bytes]:
    """The sections of a table that is in force, each number once and in order: those of the last version seen."""
    held = [s for s in _sections(packets) if s[0] == table and s[5] & 1 and program in (None, s[3] << 8 | s[4])]
    version = held[-1][5] if held else None
    by_number = {s[6]: s for s in held if s[5] == version}
    return [by_number[k] for k in sorted(by_number)]


def _programs(packets: np.ndarray, pids: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """(program, PID, stream type) of every elementary stream that the tables list, and how many tables are missing."""
    out, listed, missing = [], {}, 0
    pat = _table(packets[pids == 0], 0x00)
    missing += int(len(packets) > 0 and not pat)
    for section in pat:
        for at in range(8, len(section) - 4, 4):
            program, pid = struct.unpack(">HH", section[at:at + 4])
            if program:
                listed[program] = pid & 0x1FFF
    for program, pid in listed.items():
        pmt = _table(packets[pids == pid], 0x02, program)
        missing += int(not pmt)
        for section in pmt:
            at = 12 + (struct.unpack(">H", section[10:12])[0] & 0xFFF)
            while at + 5 <= len(section) - 4:
                kind, own, more = struct.unpack(">BHH", section[at:at + 5])
                out.append((program, own & 0x1FFF, kind))
                at += 5 + (more & 0xFFF)
    return out, missing


def read_stream(raw: bytes | None) -> dict:
    """payload (of all elementary streams, in the order of the tables), packets, units, times, random_access, errors."""
    raw = raw or b""
    out = {"payload": b"", "packets": len(raw) // PACKET, "units": 0, "times": [], "random_access": [], "errors": int(len(raw) % PACKET > 0)}
    packets = np.frombuffer(raw, np.uint8, len(raw) // PACKET * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == 0x47) & (packets[:, 1] < 0x80) if len(packets) else np.empty(0, bool)
    out["errors"] += int((~good).sum())
    packets = packets[good]
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    programs, missing = _programs(packets, pids)
    out["errors"] += missing
    data = []
    # a stream that several programs share is read once
    for pid in dict.fromkeys(pid for _, pid, _ in programs):
        own, _, gaps = _bodies(packets[pids == pid])
        out["errors"] += gaps
        start = _starts(own)
        field = own[:, 3] & 0x20 > 0
        joined = own[np.arange(PACKET) >= start[:, None]]
        ends = np.cumsum(PACKET - start)
        firsts = np.flatnonzero(own[:, 1] & 0x40)
        # what comes before the first unit belongs to one that was not seen from its start
        out["errors"] += int(len(own) > 0 and (len(firsts) == 0 or firsts[0] > 0))
        random = field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        begins = ends[firsts] - (PACKET - start[firsts])
        for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(joined)], strict=True)):
            unit = joined[a:b].tobytes()
            if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
                out["errors"] += 1
                continue
            size = struct.unpack(">H", unit[4:6])[0]
            body = 9 + unit[8]
            end = 6 + size if size else len(unit)
            out["errors"] += int(end != len(unit))
            out["times"].append(_stamp(unit[9:14]) if unit[7] & 0x80 and len(unit) >= 14 else None)
            if random[firsts[k]]:
                out["random_access"].append(out["units"])
            out["units"] += 1
            data.append(unit[body:end])
    return out | {"payload": b"".join(data)}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media, its transport stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            raw = [x or b"" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()),
                                              pa.array([write_stream(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary")


_READ = [("payload", "binary", pa.binary()), ("packets", "long", pa.int64()), ("units", "long", pa.int64()), ("times", "array<long>", pa.list_(pa.int64())),
         ("random_access", "array<long>", pa.list_(pa.int64())), ("errors", "long", pa.int64())]


def streams_read(media: DataFrame) -> DataFrame:
    """The frame (columns that Arrow carries, media among them) with what its streams hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [read_stream(x) for x in part.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[n] for f in found], t) for n, _, t in _READ)],
                                             names=[*part.schema.names, *(n for n, _, _ in _READ)])
    from pyspark.sql.types import StructType

    return media.mapInArrow(run, StructType([*media.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in _READ)).fields]))


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of the stored streams and of what is read back from them, a row per document."""
    back = streams_read(stored(docs))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in (
        ("packets", F.col("packets")), ("units", F.col("units")), ("random", F.size("random_access")),
        ("last", F.coalesce(F.array_max("times"), F.lit(-1))), ("errors", F.col("errors")))))
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                       F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
