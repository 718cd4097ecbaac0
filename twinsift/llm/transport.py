"""Media columns: MPEG transport streams (ISO/IEC 13818-1) as binary columns.

`mux` stores bytes as one private elementary stream: a program association table, a program map table, then one
elementary packet for each access unit, with a presentation timestamp; every `RANDOM_ACCESS_EVERY`-th unit is marked as
a random-access point. `demux` is a general reader of such streams: it parses the tables with their checksums, checks
continuity counters, drops repeated packets, reassembles elementary packets and returns payload, timestamps and
random-access points.

Tables may span several packets, and several sections may share one; a table in several sections is read whole.

Defined cases: a null text counts as empty, and an empty payload is padded to 64 zero bytes; equal texts give equal
media, whatever their ids (no ties arise); repeated rows give a row each; a null id is kept; a very long text is one
stream of as many packets as it needs, with all its timestamps and random-access points listed; empty tables give no rows;
columns other than the two named ones are ignored, so theirs can't clash; null media give null columns; a broken stream
raises TransportError in strict mode and is counted in the result otherwise.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Fixed values of the standard.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_TABLE, PMT_TABLE, PRIVATE_DATA, PRIVATE_STREAM_1 = 0x00, 0x02, 0x06, 0xBD
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

# Choices of this writer.
PMT_PID, DATA_PID, PROGRAM, LENGTH_TAG = 0x0100, 0x0101, 1, 0x80
UNIT_BYTES, UNIT_TICKS, RANDOM_ACCESS_EVERY = 16_384, CLOCK // 25, 4
BLOCK = 64


class TransportError(ValueError):
    """The stream breaks the format."""


@dataclass
class Stream:
    """What demux found: the payload of the first elementary stream, its timestamps and random-access points."""

    payload: bytes = b""
    length: int | None = None
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    discontinuities: int = 0
    repeated: int = 0


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        value <<= 24
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLYNOMIAL if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _timestamp(prefix: int, ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    parts = (prefix << 4 | (ticks >> 30) << 1 | 1) << 32 | ((ticks >> 15 & 0x7FFF) << 1 | 1) << 16 | ((ticks & 0x7FFF) << 1 | 1)
    return parts.to_bytes(5, "big")


def _clock_reference(ticks: int) -> bytes:
    return ((ticks & ((1 << 33) - 1)) << 15 | 0x7E00).to_bytes(6, "big")


def _unit_packets(unit: bytes, index: int, counter: int) -> np.ndarray:
    """The packets of one access unit, as rows of PACKET bytes."""
    ticks = index * UNIT_TICKS
    header = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, ticks)
    data = np.frombuffer(header + unit, dtype=np.uint8)
    first = 188 - 4 - 8
    count = 1 + max(0, -(-(len(data) - first) // 184))
    rows = np.empty((count, PACKET), dtype=np.uint8)
    rows[:, 0] = SYNC
    rows[:, 1] = DATA_PID >> 8
    rows[:, 2] = DATA_PID & 0xFF
    rows[:, 3] = 0x10 | (counter + np.arange(count)) & 15
    rows[0, 1] |= 0x40
    rows[0, 3] |= 0x20
    flags = 0x10 | (0x40 if index % RANDOM_ACCESS_EVERY == 0 else 0)
    here = min(first, len(data))
    rows[0, 4] = 183 - here
    rows[0, 5] = flags
    rows[0, 6:12] = np.frombuffer(_clock_reference(ticks), dtype=np.uint8)
    rows[0, 12 : PACKET - here] = 0xFF
    rows[0, PACKET - here :] = data[:here]
    rest = data[here:]
    whole = len(rest) // 184
    if whole:
        rows[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(whole, 184)
    if tail := len(rest) - whole * 184:
        last = rows[-1]
        last[3] |= 0x20
        last[4] = 183 - tail
        if tail < 183:
            last[5] = 0
            last[6 : PACKET - tail] = 0xFF
        last[PACKET - tail :] = rest[-tail:]
    return rows


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def mux(payload: bytes, length: int | None = None) -> bytes:
    """A transport stream that holds payload; length, if given, goes to a descriptor of the stream."""
    tag = b"" if length is None else bytes([LENGTH_TAG, 8]) + length.to_bytes(8, "big")
    pat = _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + (0xF000 | len(tag)).to_bytes(2, "big") + tag)
    parts, counter = [_table_packet(0, pat), _table_packet(PMT_PID, pmt)], 0
    for index, start in enumerate(range(0, len(payload), UNIT_BYTES)):
        rows = _unit_packets(payload[start : start + UNIT_BYTES], index, counter)
        counter = (counter + len(rows)) & 15
        parts.append(rows.tobytes())
    return b"".join(parts)


def _sections(rows: np.ndarray, pid: int, table: int) -> list[bytes]:
    """Bodies of the checked sections of a table, in order, from the packets of its pid."""
    found, held = [], None  # held: the section that is being gathered
    for row in _checked(rows, Stream()):
        start = 4 + (1 + int(row[4]) if row[3] & 0x20 else 0)
        data = row.tobytes()[start:]
        if row[1] & 0x40:
            pointer, data = (data[0], data[1:]) if data else (0, b"")
            if held is not None:
                held += data[:pointer]
                if 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF) > len(held):
                    raise TransportError(f"a section of table {table} on pid {pid} is cut off")
                found.append(held)
            held, data = None, data[pointer:]
            while len(data) >= 3 and data[0] != 0xFF and len(data) >= (size := 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)):
                found.append(data[:size])
                data = data[size:]
            held = data if data and data[0] != 0xFF else None
        elif held is not None:
            held += data
            if len(held) >= 3 and len(held) >= (size := 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)):
                found.append(held[:size])
                held = None
    bodies = {}
    for data in found:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if size < 12 or data[0] != table:
            raise TransportError(f"no section of table {table} on pid {pid}")
        if section_crc(data[:size]):
            raise TransportError(f"checksum of table {table}")
        if data[5] & 1:  # in force now
            bodies[data[6]] = data[8 : size - 4]
    if held is not None or not bodies:
        raise TransportError(f"no section of table {table} on pid {pid}")
    return [bodies[number] for number in sorted(bodies)]


def _tables(packets: np.ndarray, pids: np.ndarray, found: Stream) -> None:
    for body in _sections(packets[pids == 0], 0, PAT_TABLE):
        for at in range(0, len(body) - 3, 4):
            if program := int.from_bytes(body[at : at + 2], "big"):
                found.programs[program] = int.from_bytes(body[at + 2 : at + 4], "big") & NULL_PID
    for pid in found.programs.values():
        for body in _sections(packets[pids == pid], pid, PMT_TABLE):
            at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while at + 5 <= len(body):
                size = int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF
                found.streams[int.from_bytes(body[at + 1 : at + 3], "big") & NULL_PID] = body[at]
                tag = body[at + 5 : at + 5 + size]
                if found.length is None and tag[:2] == bytes([LENGTH_TAG, 8]):
                    found.length = int.from_bytes(tag[2:10], "big")
                at += 5 + size


def _checked(rows: np.ndarray, found: Stream) -> np.ndarray:
    """Packets of one pid that carry payload, without repeated ones; counts breaks of the continuity counter."""
    rows = rows[rows[:, 3] & 0x10 > 0]
    if len(rows) < 2:
        return rows
    step = (rows[1:, 3].astype(np.int16) - rows[:-1, 3]) & 15
    repeated = np.concatenate(([False], (step == 0) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)))
    found.repeated += int(repeated.sum())
    found.discontinuities += int(((step != 1) & ~repeated[1:]).sum())
    return rows[~repeated]


def _parse_timestamp(data: bytes) -> int:
    return (data[0] >> 1 & 7) << 30 | (int.from_bytes(data[1:3], "big") >> 1) << 15 | int.from_bytes(data[3:5], "big") >> 1


def demux(media: bytes, strict: bool = True) -> Stream:
    """Parse a transport stream and reassemble the first elementary stream of its first program."""
    if len(media) % PACKET or not media:
        raise TransportError("length is no multiple of the packet size")
    packets = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise TransportError("lost synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    found = Stream()
    _tables(packets, pids, found)
    if not found.streams:
        raise TransportError("no program")
    rows = _checked(packets[pids == next(iter(found.streams))], found)
    starts = np.where(rows[:, 3] & 0x20 > 0, 5 + rows[:, 4].astype(np.int32), 4)
    sizes = np.maximum(0, PACKET - starts)
    whole = starts == 4
    if whole.all():
        data = rows[:, 4:].tobytes()
    else:
        data = rows[np.arange(PACKET) >= starts[:, None]].tobytes()
    at = np.concatenate(([0], np.cumsum(sizes)))
    firsts = np.flatnonzero(rows[:, 1] & 0x40)
    if len(rows) and (not len(firsts) or firsts[0]):
        found.discontinuities += 1
    units = []
    for number, first in enumerate(firsts):
        end = at[firsts[number + 1]] if number + 1 < len(firsts) else len(data)
        pes = data[at[first] : end]
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            raise TransportError("no elementary packet where one starts")
        if pes[7] & 0x80:
            found.pts.append(_parse_timestamp(pes[9:14]))
        if rows[first, 3] & 0x20 and rows[first, 4] and rows[first, 5] & 0x40:
            found.random_access.append(number)
        size = int.from_bytes(pes[4:6], "big")
        if size and size + 6 > len(pes):
            found.discontinuities += 1
        units.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
    found.payload = b"".join(units)
    if strict and found.discontinuities:
        raise TransportError(f"{found.discontinuities} breaks of continuity")
    return found


def describe(found: Stream) -> str:
    """A short text feature of a stream."""
    first, last = (found.pts[0], found.pts[-1]) if found.pts else ("-", "-")
    values = np.frombuffer(found.payload, dtype=np.uint8)
    return f"programs={len(found.programs)};units={len(found.pts)};random_access={','.join(map(str, found.random_access))}/{len(found.random_access)};pts={first}-{last};breaks={found.discontinuities};mean={values.mean() if len(values) else 0:.3f}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): the text's UTF-8 bytes, padded, in a transport stream."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary())
                media = [mux(pad(data), len(data)) for data in (value.as_py() or b"" for value in texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parse the streams; digests and features of what was read, timestamps and random-access points."""
    ship(media.sparkSession)
    names = [part.split()[0] for part in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0), batch.column(1), strict=True):
                data = value.as_py()
                if data is None:
                    rows.append((doc_id.as_py(), *[None] * (len(names) - 1)))
                    continue
                found = demux(data)
                rows.append((doc_id.as_py(), found.length, len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), describe(found), found.pts, found.random_access))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, READ)
