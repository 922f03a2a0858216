"""Bytes stored as an MPEG transport stream, and the demultiplexer that reads them back.

The multiplexer writes 188-byte packets: a program association table, a program map table and one private-data stream
whose payload is cut into packetised elementary packets (PES), each with a presentation timestamp; the first packet of
every PES carries an adaptation field, and every ``RANDOM_EVERY``-th PES is marked as a random-access point. The
demultiplexer finds the stream through the tables (checking their CRC-32), checks the continuity counters of every
packet identifier, reassembles the PES and lists timestamps with random-access points.

Defined results: a null or empty text is 0 bytes and its payload 64 zero bytes; equal texts give equal values, whatever
else the rows hold; a stream with a lost, repeated or damaged packet raises ``StreamError`` that says where; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, slices

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
STREAM_TYPE = 0x06  # PES packets with private data
STREAM_ID = 0xBD
#: Payload bytes of a PES, PES between random-access points, and timestamp ticks (90 kHz) from one PES to the next.
PES_BYTES = 8192
RANDOM_EVERY = 4
TICKS = 3600
BLOCK = 64


class StreamError(ValueError):
    """The stream breaks a rule of the format."""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    data = head + body
    return data + crc32_mpeg(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def _read_pts(b: bytes) -> int:
    if not (b[0] & 1 and b[2] & 1 and b[4] & 1):
        raise StreamError("timestamp without marker bits")
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes((-len(data)) % BLOCK if data else BLOCK)


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload``."""
    out = [_PAT, _PMT]
    counter = 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        chunk = payload[at : at + PES_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(k * TICKS & (1 << 33) - 1) + chunk
        # The first packet holds two bytes of adaptation at least, the last what fills it; those between are full.
        flags = 0x40 if k % RANDOM_EVERY == 0 else 0x00
        first = min(len(pes), PACKET - 6)
        stuff = PACKET - 6 - first
        head = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter, 1 + stuff, flags]) + b"\xff" * stuff
        out.append(head + pes[:first])
        counter = counter + 1 & 15
        rest = len(pes) - first
        full = rest // (PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), first).reshape(full, PACKET - 4)
            out.append(block.tobytes())
            counter = counter + full & 15
        if tail := rest - full * (PACKET - 4):
            space = PACKET - 4 - tail  # bytes of adaptation, its length byte included
            field = bytes([space - 1]) + (b"\x00" + b"\xff" * (space - 2) if space > 1 else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field + pes[-tail:])
            counter = counter + 1 & 15
    return b"".join(out)


def _packet_section(packet: bytes, table: int) -> bytes:
    if not packet[1] & 0x40 or packet[3] & 0x30 != 0x10:
        raise StreamError("a table that doesn't start its packet")
    at = 5 + packet[4]
    length = 3 + (int.from_bytes(packet[at + 1 : at + 3], "big") & 0xFFF)
    section = packet[at : at + length]
    if section[0] != table or len(section) != length or crc32_mpeg(section):
        raise StreamError(f"table {table} is damaged")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, bool, int]]]:
    """The payload, and for each PES its timestamp, whether it is a random-access point, and its first payload byte."""
    if len(stream) % PACKET:
        raise StreamError("the length isn't a number of packets")
    a = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(a) == 0 or (a[:, 0] != SYNC).any():
        raise StreamError("lost synchronisation")
    pids = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    has_payload = (a[:, 3] & 0x10) > 0
    for pid in np.unique(pids):
        own = a[(pids == pid) & has_payload, 3] & 15
        if len(own) > 1 and (bad := np.flatnonzero(np.diff(own.astype(np.int16)) % 16 != 1)).size:
            raise StreamError(f"continuity of identifier {pid} breaks after its packet {int(bad[0])}")
    tables = np.flatnonzero(pids == PAT_PID)
    if not tables.size:
        raise StreamError("no program association table")
    pat = _packet_section(stream[tables[0] * PACKET : (tables[0] + 1) * PACKET], 0)
    pmt_pid = int.from_bytes(pat[2:4], "big") & 0x1FFF
    maps = np.flatnonzero(pids == pmt_pid)
    if not maps.size:
        raise StreamError("no program map table")
    pmt = _packet_section(stream[maps[0] * PACKET : (maps[0] + 1) * PACKET], 2)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    data_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    rows = a[(pids == data_pid) & has_payload]
    adapted = (rows[:, 3] & 0x20) > 0
    begin = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    if (begin > PACKET).any():
        raise StreamError("an adaptation field leaves its packet")
    starts = (rows[:, 1] & 0x40) > 0
    if len(rows) and not starts[0]:
        raise StreamError("the stream starts within a PES")
    random = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) > 0)
    keep = np.arange(PACKET)[None, :] >= begin[:, None]
    data = rows[keep].tobytes()
    offset = np.concatenate(([0], np.cumsum(PACKET - begin)))
    firsts = np.flatnonzero(starts)
    out, points, done = [], [], 0
    for k, i in enumerate(firsts):
        end = offset[firsts[k + 1]] if k + 1 < len(firsts) else offset[-1]
        pes = data[offset[i] : end]
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != length + 6 or not pes[7] & 0x80:
            raise StreamError(f"PES {k} is damaged")
        body = pes[9 + pes[8] :]
        points.append((_read_pts(pes[9:14]), bool(random[i]), done))
        out.append(body)
        done += len(body)
    return b"".join(out), points


FIELDS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("points", pa.list_(pa.struct([("pts", pa.int64()), ("random", pa.bool_()), ("at", pa.int64())]))))


def describe(text: str | None) -> tuple[int, int, str, int, int, str, str, list[dict]]:
    """Store a text, read the stored bytes back, and give what ``FIELDS`` names."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    stream = mux(pad(raw))
    back, points = demux(stream)
    random = [p for p in points if p[1]]
    feature = f"packets={len(stream) // PACKET};pes={len(points)};pts={points[0][0]}-{points[-1][0]};random={len(random)};points={zlib.crc32(np.array(random, np.int64).tobytes()):08x}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, [{"pts": t, "random": r, "at": at} for t, r, at in points]


def media_features(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``FIELDS`` of every row; no shuffle. ``points`` lists each PES: its timestamp, whether it is a
    random-access point, and the payload byte that it starts at."""
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = zip(*map(describe, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, (_, t) in zip(found, FIELDS, strict=True))], [id_col, *(n for n, _ in FIELDS)])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    names = ", ".join(f"{n} {kinds.get(t, 'array<struct<pts: long, random: boolean, at: long>>')}" for n, t in FIELDS)
    return docs.select(docs[id_col].alias("k"), docs[text].alias("text")).transform(arrow, run, f"`{id_col}` {kind}, {names}")


def streams(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and the stored form itself, ``media`` (binary), of every row."""
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                media = [mux(pad((t or "").encode("utf-8", "surrogatepass"))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    return docs.select(docs[id_col].alias("k"), docs[text].alias("text")).transform(arrow, run, f"`{id_col}` {kind}, media binary")
