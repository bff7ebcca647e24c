"""Media columns: MPEG transport streams built from and parsed back to bytes.

``pack`` cuts a text's bytes, padded with 255 to a positive multiple of 576,
into access units of 576 bytes. Each is a PES packet with a time stamp, carried
by four 188-byte transport packets; a program association table and a program
map table come first and again before every 40th unit, whose packet has
the random access indicator. ``parse`` takes any such binary column: it finds
the program, checks continuity counters, reassembles PES packets by payload
unit start and returns one row per access unit with its time stamp and
random-access flag, and stream-wide counts of faults.

Defined results: a null or empty text is one unit of padding; null streams
and streams that lack a whole packet or a program have no units; packets
without the sync byte are counted and skipped; equal texts give equal streams.
Extra columns of the caller's are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import column, slices

# Fixed values of the format (ISO/IEC 13818-1) and of the layout chosen here.
PACKET, SYNC, UNIT = 188, 0x47, 576
PID_TABLE, PID_MAP, PID_MEDIA, STREAM_TYPE, STREAM_ID = 0x0000, 0x0100, 0x0101, 0x06, 0xBD
CLOCK, FRAME, RAP_EVERY = 90_000, 3_600, 40
PES_HEAD = 14
PER_UNIT = -(-(PES_HEAD + UNIT) // 184)


def _crc32_mpeg(data: bytes) -> int:
    """CRC of sections: polynomial 04C11DB7, no reflection, no final inversion."""
    flip = int.from_bytes(bytes(int(f"{b:08b}"[::-1], 2) for b in data), "big").to_bytes(len(data), "big")
    return int(f"{zlib.crc32(flip) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _section(pid: int, table: int, body: bytes) -> np.ndarray:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, 0, 1, 0xC1, 0, 0])
    section = head + body
    section += _crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), dtype=np.uint8)


TABLES = np.concatenate([
    _section(PID_TABLE, 0, bytes([0, 1, 0xE0 | PID_MAP >> 8, PID_MAP & 255])),
    _section(PID_MAP, 2, bytes([0xE0 | PID_MEDIA >> 8, PID_MEDIA & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | PID_MEDIA >> 8, PID_MEDIA & 255, 0xF0, 0])),
])


def _template(random_access: bool) -> tuple[np.ndarray, np.ndarray]:
    """The transport packets of a unit with zeros for what varies, and where its bytes go."""
    pes = bytes([0, 0, 1, STREAM_ID, (UNIT + 8) >> 8, (UNIT + 8) & 255, 0x84, 0x80, 5, 0, 0, 0, 0, 0])
    left, out, where = UNIT + PES_HEAD, bytearray(), []
    for i in range(PER_UNIT):
        flags = 0x40 if random_access and i == 0 else 0
        room = 184 - (2 if flags else 0)
        take = min(left, room)
        stuffing = 184 - take
        head = bytes([SYNC, (0x40 if i == 0 else 0) | PID_MEDIA >> 8, PID_MEDIA & 255, 0x30 if stuffing else 0x10])
        if stuffing:
            head += bytes([stuffing - 1]) + (bytes([flags]) + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
        where += range(len(out) + len(head), len(out) + len(head) + take)
        out += head + (pes if i == 0 else b"") + bytes(take - (len(pes) if i == 0 else 0))
        left -= take
    return np.frombuffer(bytes(out), dtype=np.uint8), np.array(where)


PLAIN, RANDOM = _template(False), _template(True)
UNIT_BYTES = PER_UNIT * PACKET


def padded(data: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return np.concatenate([data, np.full(n - len(data), 255, np.uint8)])


def pack(payload: np.ndarray) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of 576."""
    units = payload.reshape(-1, UNIT)
    n = len(units)
    k = np.arange(n)
    block = np.empty((n, UNIT_BYTES), np.uint8)
    pts = (k * FRAME) % (1 << 33)
    stamp = np.stack([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1], axis=1).astype(np.uint8)
    for chosen, (bytes_, where) in ((k % RAP_EVERY == 0, RANDOM), (k % RAP_EVERY != 0, PLAIN)):
        rows = np.flatnonzero(chosen)
        if len(rows):
            part = np.tile(bytes_, (len(rows), 1))
            part[:, where[PES_HEAD:]] = units[rows]
            part[:, where[9:14]] = stamp[rows]
            block[rows] = part
    counters = (np.arange(n * PER_UNIT) & 15).astype(np.uint8).reshape(n, PER_UNIT)
    block[:, 3::PACKET] |= counters
    out = []
    for g, at in enumerate(range(0, n, RAP_EVERY)):
        tables = TABLES.copy()
        tables[3::PACKET] |= g & 15
        out += [tables, block[at : at + RAP_EVERY].reshape(-1)]
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """What one transport stream holds."""

    packets: int = 0
    lost_sync: int = 0
    bad_tables: int = 0
    discontinuities: int = 0
    map_pid: int = -1
    media_pid: int = -1
    stream_type: int = -1
    units: list[np.ndarray] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)


def _tables(p: np.ndarray, pid: np.ndarray, start: np.ndarray, at: np.ndarray, wanted: int, out: Stream) -> list[bytes]:
    """Sections of a table's packets whose CRC holds, one per distinct packet body."""
    good, seen = [], {}
    for i in np.flatnonzero((pid == wanted) & start):
        raw = p[i, at[i] :].tobytes()
        if raw not in seen:
            body = raw[1 + raw[0] :] if raw and raw[0] < len(raw) - 4 else b""
            size = 3 + ((body[1] & 15) << 8 | body[2]) if len(body) > 3 else 0
            seen[raw] = ok = 8 < size <= len(body) and _crc32_mpeg(body[: size - 4]) == int.from_bytes(body[size - 4 : size], "big")
            if ok:
                good.append(body[:size])
        out.bad_tables += not seen[raw]
    return good


def parse(stream: bytes | None) -> Stream:
    out = Stream()
    if not stream or len(stream) < PACKET:
        return out
    p = np.frombuffer(stream, dtype=np.uint8)[: len(stream) // PACKET * PACKET].reshape(-1, PACKET)
    place = np.flatnonzero(p[:, 0] == SYNC)
    out.packets, out.lost_sync = len(place), len(p) - len(place)
    if out.lost_sync:
        p = p[place]
    pid = (p[:, 1] & 31).astype(np.int64) << 8 | p[:, 2]
    start, adapt, has = (p[:, 1] & 64) > 0, (p[:, 3] & 32) > 0, (p[:, 3] & 16) > 0
    at = np.where(adapt, 5 + p[:, 4].astype(np.int64), 4)
    has &= at < PACKET
    flags = np.where(adapt & (p[:, 4] > 0), p[:, 5], 0)
    programs = _tables(p, pid, start & has, at, PID_TABLE, out)
    for body in programs[:1]:
        for i in range(8, len(body) - 4, 4):
            if body[i] << 8 | body[i + 1]:
                out.map_pid = (body[i + 2] & 31) << 8 | body[i + 3]
                break
    for body in _tables(p, pid, start & has, at, out.map_pid, out)[:1] if out.map_pid >= 0 else []:
        i = 12 + ((body[10] & 15) << 8 | body[11])
        if i + 5 <= len(body) - 4:
            out.stream_type, out.media_pid = body[i], (body[i + 1] & 31) << 8 | body[i + 2]
    for own in (PID_TABLE, out.map_pid, out.media_pid):
        counters = p[(pid == own) & has, 3] & 15
        jumps = (counters[1:] - counters[:-1]) & 15
        out.discontinuities += int((jumps != 1).sum())
    media = np.flatnonzero((pid == out.media_pid) & has) if out.media_pid >= 0 else np.zeros(0, int)
    first = np.flatnonzero(start[media])
    if not len(first):
        return out
    media = media[first[0] :]
    # all bytes after the headers, cut at the packets that start a unit
    lengths = PACKET - at[media]
    body = p[media][np.arange(PACKET)[None, :] >= at[media][:, None]]
    cuts = np.append(np.concatenate([[0], np.cumsum(lengths)[:-1]])[start[media]], len(body))
    for lo, hi, i in zip(cuts[:-1], cuts[1:], media[start[media]], strict=True):
        h = body[lo : lo + 14].tolist()
        if hi - lo < 9 or h[:3] != [0, 0, 1]:
            out.bad_tables += 1
            continue
        size, skip = h[4] << 8 | h[5], 9 + h[8]
        stamped = h[7] & 128 and len(h) >= 14
        out.pts.append(((h[9] >> 1 & 7) << 30 | h[10] << 22 | h[11] >> 1 << 15 | h[12] << 7 | h[13] >> 1) if stamped else -1)
        out.random_access.append(bool(flags[i] & 64))
        out.offsets.append(int(place[i]) * PACKET)
        out.units.append(body[lo + skip : min(hi, lo + 6 + size) if size else hi])
    return out


STORED = "doc_id long, n_bytes long, media binary"
UNITS = "doc_id long, unit int, offset long, pts long, random_access boolean, unit_bytes int"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a transport stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch):
                media = [pack(padded(data[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(work, STORED)


def units(stored: DataFrame) -> DataFrame:
    """One row per access unit of each stream: place, time stamp, random access, size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, media in zip(column(batch, "doc_id").to_pylist(), column(batch, "media"), strict=True):
                s = parse(media.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(s.units), pa.int64()), pa.array(range(len(s.units)), pa.int32()), pa.array(s.offsets, pa.int64()), pa.array(s.pts, pa.int64()), pa.array(s.random_access, pa.bool_()), pa.array([len(u) for u in s.units], pa.int32())], ["doc_id", "unit", "offset", "pts", "random_access", "unit_bytes"])

    return stored.select("doc_id", "media").mapInArrow(work, UNITS)


def digest(stored: DataFrame) -> DataFrame:
    """Reads each stored stream back: hashes of its payload and form, and its features as text."""

    def one(media: bytes | None) -> tuple:
        s = parse(media)
        payload = b"".join(u.tobytes() for u in s.units)
        feature = f"units={len(s.units)};pts={s.pts[0] if s.pts else -1}..{s.pts[-1] if s.pts else -1};rap={sum(s.random_access)};pid={s.map_pid},{s.media_pid};type={s.stream_type};lost={s.lost_sync};jumps={s.discontinuities};bad={s.bad_tables};seconds={((s.pts[-1] - s.pts[0] + FRAME) / CLOCK if s.pts else 0):.2f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(m.as_py()) for m in column(batch, "media")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *cols], [f.split()[0] for f in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, DIGEST)
