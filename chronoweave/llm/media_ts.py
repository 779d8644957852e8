"""Media columns as MPEG transport streams.

`mux` stores a payload as one program: a PAT, a PMT and one elementary stream of private data whose
PES packets (access units) carry a PTS; the first transport packet of each is a random-access point
with a PCR. `demux` reads a stream back: it parses the program tables, checks the continuity
counters, reassembles the PES packets and returns payload, time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.session import map_batches

PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
PES_HEADER = 14
#: A payload is filled with bytes 255 to a multiple of this, and dealt into access units of so many.
UNIT, UNITS_PER_PES = 576, 32
#: Clock ticks (90 kHz) between access units, and the first time stamp.
TICKS, FIRST_PTS = 3600, 90_000
#: Bytes of media that one output batch gathers.
BATCH_BYTES = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def section_crc(section: bytes) -> int:
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_TABLE[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID,
    _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a multiple of UNIT."""
    parts, counter, step = [TABLES], 0, UNIT * UNITS_PER_PES
    for k, at in enumerate(range(0, len(payload), step)):
        unit = payload[at : at + step]
        pts = (FIRST_PTS + k * TICKS) % 2**33
        pes = np.frombuffer(
            b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit, np.uint8
        )
        rest = len(pes) - 176
        full, tail = divmod(rest, 184)
        n = 1 + full + (tail > 0)
        out = np.full((n, PACKET), 255, np.uint8)
        out[:, 0] = SYNC
        out[:, 1] = STREAM_PID >> 8
        out[:, 2] = STREAM_PID & 255
        out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        # the first packet: start flag, adaptation field of 7 bytes with random access and PCR
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        base = (pts - TICKS) % 2**33
        out[0, 4:12] = [7, 0x50, base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0]
        out[0, 12:] = pes[:176]
        out[1 : 1 + full, 4:] = pes[176 : 176 + full * 184].reshape(full, 184)
        if tail:
            out[-1, 3] |= 0x20
            out[-1, 4] = 183 - tail
            if tail < 183:
                out[-1, 5] = 0
            out[-1, PACKET - tail :] = pes[-tail:]
        parts.append(out.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers
    packets: int = 0
    continuity_errors: int = 0
    stream_type: int = -1
    error: str | None = None


def _read_section(packet: np.ndarray) -> bytes | None:
    at = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    if at >= PACKET - 4:
        return None
    at += 1 + int(packet[at])
    size = 3 + ((int(packet[at + 1]) & 0x0F) << 8 | int(packet[at + 2])) if at + 3 <= PACKET else PACKET
    section = packet[at : at + size].tobytes()
    return section if len(section) == size >= 12 and section_crc(section) == 0 else None


def demux(media: bytes | None) -> Stream:
    """Read a transport stream; a broken one gives what could be read, and an error."""
    out = Stream()
    if not media or len(media) % PACKET:
        out.error = "not whole packets"
        return out
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    out.packets = len(p)
    if (p[:, 0] != SYNC).any():
        out.error = "sync byte missing"
        return out
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    first = lambda number: next((s for k in np.flatnonzero(pid == number) if (s := _read_section(p[k]))), None)
    pat = first(0)
    if pat is None:
        out.error = "no program table"
        return out
    entries = [(pat[i] << 8 | pat[i + 1], (pat[i + 2] & 0x1F) << 8 | pat[i + 3]) for i in range(8, len(pat) - 4, 4)]
    pmt = first(next((b for a, b in entries if a), -1))
    if pmt is None:
        out.error = "no program map"
        return out
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        out.error = "no elementary stream"
        return out
    out.stream_type, stream = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    numbers = np.flatnonzero(pid == stream)
    p = p[numbers]
    field_, carries = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    counters = p[carries, 3].astype(np.int32) & 15
    out.continuity_errors = int((np.diff(counters) % 16 != 1).sum())
    start = np.where(field_, 5 + p[:, 4].astype(np.int32), 4)
    start[~carries] = PACKET
    out.random_access = numbers[field_ & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)].tolist()
    body = p[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(np.maximum(PACKET - start, 0))
    begins = (ends - np.maximum(PACKET - start, 0))[(p[:, 1] & 0x40 > 0) & carries].tolist()
    units = []
    for a, b in zip(begins, [*begins[1:], len(body)], strict=True):
        pes = body[a:b]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.error = "broken PES packet"
            continue
        if pes[7] & 0x80:
            out.pts.append(_read_stamp(pes[9:14]))
        size = pes[4] << 8 | pes[5]
        unit = pes[9 + pes[8] : 6 + size if size else None]
        if size and len(pes) < 6 + size:
            out.error = "PES packet cut short"
        units.append(unit)
    out.payload = b"".join(units)
    return out


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _in_parts(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES of the column `weight`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


MUXED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])


def _mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                yield doc_id.as_py(), len((text or "").encode()), mux(padded(text))

    yield from _in_parts(rows(), MUXED, 2)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the unpadded text), media (a transport stream) for each row of docs.

    docs: doc_id and text; other columns are passed over. Null and empty texts are one unit of
    bytes 255. Equal texts give equal media; a text is one value, however long.
    """
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _mux_rows, "doc_id bigint, n_bytes bigint, media binary")


READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64()))]
    + [("random_access", pa.list_(pa.int64())), ("continuity_errors", pa.int64()), ("error", pa.string())]
)
READ_DDL = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string,"
    " feature string, pts array<bigint>, random_access array<bigint>, continuity_errors bigint, error string"
)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*batch.columns, strict=True):
            media = media.as_py() or b""
            s = demux(media)
            gaps = np.diff(s.pts)
            feature = (
                f"type={s.stream_type};packets={s.packets};pes={len(s.pts)};rap={len(s.random_access)};pts={s.pts[0] if s.pts else -1}"
                f"-{s.pts[-1] if s.pts else -1};step={int(gaps.max()) if len(gaps) else 0};cc={s.continuity_errors}"
            )
            rows.append(
                (doc_id.as_py(), n_bytes.as_py(), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]))
                + (len(media), hashlib.sha256(media).hexdigest(), feature, s.pts, s.random_access, s.continuity_errors, s.error)
            )
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


def read_media(media: DataFrame) -> DataFrame:
    """Payload digests, time stamps (90 kHz) and random-access points (packet numbers) of a media column.

    media: doc_id, n_bytes, media. A null or broken stream gives an error and what could be read.
    """
    return map_batches(media.select("doc_id", "n_bytes", "media"), _read_rows, READ_DDL)
