"""Media columns: MPEG transport streams.

``mux`` stores a byte string as 8-bit samples in a transport stream of one
program: program tables, then elementary packets with a timestamp each, every
one of them a random-access point.  ``demux`` reads any stream of 188-byte
packets: it follows the program tables (and checks their CRC), checks the
continuity counter of every PID, drops repeated packets, reassembles the
elementary packets and keeps their timestamps and random-access flags.

Null media gives no rows; a stream that is cut off or damaged gives what can
be read, with its errors counted.  Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbside.llm.common import materialise, text_bytes

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PAT_TABLE, PMT_TABLE = 0x00, 0x02
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000

#: Samples in an elementary packet, and samples a second: a packet then lasts a whole number of ticks.
UNIT, RATE = 8_192, 8_000
ALIGN = 64


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    out = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return out + bytes([STUFFING]) * (PACKET - len(out))


TABLES = _table_packet(PAT_PID, _section(PAT_TABLE, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(PMT_TABLE, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_DATA, 0xE000 | MEDIA_PID, 0xF000)))


def _stamp(prefix: int, ticks: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | ticks >> 29 & 0x0E | 1, ticks >> 14 & 0xFFFE | 1, ticks << 1 & 0xFFFE | 1)


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """A stream that holds every byte of a payload as a sample."""
    out, cc = [TABLES], 0
    for at in range(0, len(payload), unit):
        ticks = at * CLOCK // rate & (1 << 33) - 1
        data = payload[at : at + unit]
        pes = struct.pack(">3sBHBBB", b"\0\0\1", PRIVATE_STREAM_1, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, ticks) + data
        # the first packet has an adaptation field with the random-access flag and the clock; 176 bytes are left
        clock = struct.pack(">BIH", 0x50, ticks >> 1, (ticks & 1) << 15 | 0x7E00)
        first = pes[:176]
        out += [struct.pack(">BHBB", SYNC, 0x4000 | MEDIA_PID, 0x30 | cc, 183 - len(first)), clock, bytes([STUFFING]) * (176 - len(first)), first]
        cc = cc + 1 & 15
        full = (len(pes) - len(first)) // 184
        if full:
            block = np.empty((full, PACKET), dtype=np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
            block[:, 3] = 0x10 | (cc + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * 184, len(first)).reshape(full, 184)
            out.append(block.tobytes())
            cc = cc + full & 15
        if rest := pes[len(first) + full * 184 :]:
            length = 183 - len(rest)
            out += [struct.pack(">BHBB", SYNC, MEDIA_PID, 0x30 | cc, length), b"\0"[: min(1, length)], bytes([STUFFING]) * (length - 1), rest]
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its packets' (timestamp, random access, data), and what was wrong with it."""

    program: int
    pid: int
    kind: int
    packets: list[tuple[int | None, bool, bytes]] = field(default_factory=list)
    gaps: int = 0
    repeats: int = 0

    def data(self) -> bytes:
        return b"".join(x for _, _, x in self.packets)


@dataclass
class Streams:
    streams: dict[int, Stream]
    packets: int
    table_errors: int
    sync_errors: int


def _tables(payload: bytes, table: int):
    """The body of a section whose CRC is right; None where it is not."""
    at = 1 + payload[0] if payload else 0
    if len(payload) < at + 12 or payload[at] != table:
        return None
    end = at + 3 + ((payload[at + 1] & 15) << 8 | payload[at + 2])
    if end > len(payload) or section_crc(payload[at:end]):
        return None
    return payload[at + 8 : end - 4]


def demux(media: bytes) -> Streams:
    """What a transport stream holds."""
    n = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    good = p[:, 0] == SYNC
    found = Streams({}, n, 0, int((~good).sum()) + (len(media) % PACKET > 0))
    p = p[good & (p[:, 1] & 0x80 == 0)] if n else p  # not those marked as damaged in transport
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    has_field, has_data = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    begin = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    start = p[:, 1] & 0x40 != 0

    def payload(i: int) -> bytes:
        return p[i, begin[i] :].tobytes() if has_data[i] else b""

    programs: dict[int, int] = {}
    for i in np.flatnonzero((pid == PAT_PID) & start):
        body = _tables(payload(i), PAT_TABLE)
        found.table_errors += body is None
        for number, at in struct.iter_unpack(">HH", body or b""):
            if number:
                programs[at & 0x1FFF] = number
    for table, number in programs.items():
        for i in np.flatnonzero((pid == table) & start):
            body = _tables(payload(i), PMT_TABLE)
            found.table_errors += body is None
            at = 4 + ((body[2] & 15) << 8 | body[3]) if body else 0
            while body and at + 5 <= len(body):
                kind, to, info = struct.unpack_from(">BHH", body, at)
                found.streams.setdefault(to & 0x1FFF, Stream(number, to & 0x1FFF, kind))
                at += 5 + (info & 0xFFF)
    for s in found.streams.values():
        mine = np.flatnonzero((pid == s.pid) & has_data)
        if not len(mine):
            continue
        cc = p[mine, 3] & 15
        same = np.zeros(len(mine), dtype=bool)  # a packet may be sent twice
        same[1:] = (cc[1:] == cc[:-1]) & (p[mine[1:], 4:] == p[mine[:-1], 4:]).all(axis=1)
        s.repeats = int(same.sum())
        mine, cc = mine[~same], cc[~same]
        broken = np.zeros(len(mine), dtype=bool)
        broken[1:] = (cc[1:] != (cc[:-1] + 1 & 15)) & (flags[mine[1:]] & 0x80 == 0)
        s.gaps = int(broken.sum())
        size = np.maximum(0, PACKET - begin[mine])
        flat = p[mine][np.arange(PACKET)[None, :] >= begin[mine][:, None]].tobytes()
        at = np.cumsum(size) - size
        starts = np.flatnonzero(start[mine])
        for k, i in enumerate(starts):
            pes = flat[at[i] : at[starts[k + 1]] if k + 1 < len(starts) else len(flat)]
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                s.gaps += 1
                continue
            length = pes[4] << 8 | pes[5]
            stamp = _ticks(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
            s.packets.append((stamp, bool(flags[mine[i]] & 0x40), pes[9 + pes[8] : 6 + length if length else len(pes)]))
    return found


def padded(text: str | None) -> bytes:
    raw = text_bytes(text)
    return raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


def store(docs: DataFrame) -> DataFrame:
    """Each text's bytes, padded with zeros to a positive multiple of 64, as a stream in a written table."""

    def put(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            media = [mux(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(text_bytes(t)) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select("doc_id", "text")
    return materialise(docs.mapInArrow(put, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"))


def elementary_packets(df: DataFrame, media: str, key: str) -> DataFrame:
    """A row for each elementary packet of a column of streams: its place, timestamp, random access and data."""
    df = df.select(key, media)

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                value, one = batch.column(1)[k].as_py(), batch.column(0).slice(k, 1)
                if value is None:
                    continue
                for s in demux(value).streams.values():
                    n = len(s.packets)
                    cols = [pa.array([s.program] * n, pa.int32()), pa.array([s.pid] * n, pa.int32()), pa.array([s.kind] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([x for x, _, _ in s.packets], pa.int64()), pa.array([x for _, x, _ in s.packets], pa.bool_()), pa.array([x for _, _, x in s.packets], pa.binary()), pa.array([s.gaps] * n, pa.int32())]
                    yield pa.RecordBatch.from_arrays([one.take(pa.array([0] * n, pa.int64())), *cols], ["key", "program", "pid", "kind", "packet", "pts", "random_access", "data", "gaps"])

    return df.mapInArrow(read, f"key {df.schema[key].dataType.simpleString()}, program int, pid int, kind int, packet int, pts long, random_access boolean, data binary, gaps int")


def features(stored: DataFrame) -> DataFrame:
    """The digest of each stored stream, computed from the bytes read back."""

    def read(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for media in batch.column("media").to_pylist():
                found = demux(media)
                s = next(iter(found.streams.values()))
                data = s.data()
                x = np.frombuffer(data, np.uint8)
                stamps = [t for t, _, _ in s.packets]
                text = f"program={s.program};pid={s.pid};kind={s.kind};packets={found.packets};units={len(stamps)};pts={stamps[0]}..{stamps[-1]};random_access={sum(r for _, r, _ in s.packets)};gaps={s.gaps};errors={found.table_errors + found.sync_errors};min={x.min()};max={x.max()};sum={x.sum(dtype=np.int64)}"
                for o, v in zip(out, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), text)):
                    o.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(o, t) for o, t in zip(out, types)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    return features(store(docs))
