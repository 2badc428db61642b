"""Media columns: payloads carried in an MPEG transport stream.

``encode`` wraps a byte payload (8-bit mono samples at 8 kHz) in 188-byte packets: a
program association table, a program map table, then one packetised elementary
stream whose packets carry a presentation time stamp; random-access points carry the
program's clock. Streams are stored as a table, and ``decode`` trusts nothing but the
stored bytes: it puts sections together (over packets, last version counts), checks their
CRCs and the continuity counters, reassembles the elementary packets and lists time stamps,
clocks and random-access points, which are columns of the result.

Defined results: null text is an empty payload, padded like any other; equal texts give
equal bytes and features; repeated rows each give a row; extra columns are ignored; an
empty table gives an empty result. Work is row by row: memory is one batch of streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import lean, small_batches
from emberlake.llm.scratch import Scratch

# Fixed values of the transport stream format.
PACKET, SYNC = 188, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
CLOCK, RATE = 90_000, 8_000
PES_BYTES = 8_000  # samples of a PES packet: one second
KEY_EVERY = 4  # every fourth PES packet starts with a random-access mark
PTS_WRAP = 1 << 33


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
PMT = _table_packet(
    PMT_PID,
    _section(2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0])),
)


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29 & 0x0E), t >> 22 & 0xFF, 0x01 | (t >> 14 & 0xFE), t >> 7 & 0xFF, 0x01 | (t << 1 & 0xFE)])


def _read_pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _pcr(t: int) -> bytes:
    """Program clock reference: 33 bits at 90 kHz, six reserved ones, no extension."""
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def _packets(pes: bytes, counter: int, key: bool, clock: int = 0) -> tuple[bytes, int]:
    """A PES packet as transport packets; the first may carry a random-access mark with the clock, the last is stuffed."""
    head_room = 8 if key else 0
    first = 184 - head_room
    rest = max(0, len(pes) - first)
    n = 1 + -(-rest // 184)
    grid = np.full((n, PACKET), 0xFF, np.uint8)
    grid[:, 0] = SYNC
    grid[:, 1] = MEDIA_PID >> 8
    grid[0, 1] |= 0x40
    grid[:, 2] = MEDIA_PID & 0xFF
    grid[:, 3] = 0x10 | (counter + np.arange(n)) % 16
    data = np.frombuffer(pes, np.uint8)
    whole = rest // 184  # packets after the first without stuffing
    if key:
        grid[0, 3] |= 0x20
        grid[0, 4], grid[0, 5] = 7, 0x50
        grid[0, 6:12] = np.frombuffer(_pcr(clock), np.uint8)
    took = min(len(data), first)
    if took == first:
        grid[0, 4 + head_room :] = data[:first]
    if whole:
        grid[1 : 1 + whole, 4:] = data[first : first + 184 * whole].reshape(whole, 184)
    tail, row = (data[first + 184 * whole :], n - 1) if took == first else (data, 0)
    if len(tail):
        stuff = 184 - len(tail)
        grid[row, 3] |= 0x20
        grid[row, 4] = stuff - 1
        if stuff > 1:
            grid[row, 5] = 0x50 if key and row == 0 else 0
        grid[row, 4 + stuff :] = tail
    return grid.tobytes(), (counter + n) % 16


def encode(payload: bytes) -> bytes:
    """The transport stream of a non-empty payload."""
    parts, counter = [PAT, PMT], 0
    for i, at in enumerate(range(0, len(payload), PES_BYTES)):
        data = payload[at : at + PES_BYTES]
        head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + bytes([0x80, 0x80, 5]) + _pts(now := at * CLOCK // RATE % PTS_WRAP)
        part, counter = _packets(head + data, counter, i % KEY_EVERY == 0, now)
        parts.append(part)
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes = b""
    packets: int = 0
    pts: list[int] = field(default_factory=list)
    pcr: list[int] = field(default_factory=list)  # of the random-access points
    random_access: list[int] = field(default_factory=list)  # packet numbers
    discontinuities: int = 0


def sections(packets: np.ndarray) -> Iterator[bytes]:
    """Sections of one PID's packets, in order, those that span packets put together; a wrong CRC raises."""
    held: bytes | None = None  # the section under way
    for packet in packets:
        if not packet[3] & 0x10:  # no payload
            continue
        body = packet[4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0) :].tobytes()
        if packet[1] & 0x40:  # a section begins after the pointer; what comes before it ends the last one
            begin = 1 + body[0]
            held, body = (held + body[1:begin] if held else b""), body[begin:]
            held, rest = _whole(held) if held else (b"", b"")
            if held:
                yield held
            held = body
        elif held is not None:
            held += body
        while held:
            done, held = _whole(held)
            if not done:
                break
            yield done
        if held is not None and held[:1] == b"\xff":
            held = None  # only stuffing follows


def _whole(data: bytes) -> tuple[bytes, bytes]:
    """The section that ``data`` begins with, if all of it is there, and what is left."""
    if len(data) < 3 or data[0] == 0xFF:
        return b"", data
    end = 3 + ((data[1] & 0x0F) << 8 | data[2])
    if len(data) < end:
        return b"", data
    if crc32_mpeg(data[:end]):
        raise ValueError("a table section's CRC is wrong")
    return data[:end], data[end:]


def _table(packets: np.ndarray, table_id: int) -> bytes:
    """The last version of a table of one section that is in force."""
    found = [s for s in sections(packets) if s[0] == table_id and s[5] & 1]
    if not found:
        raise ValueError(f"no table {table_id}")
    return found[-1]


def decode(media: bytes) -> Stream:
    """Read a stream back through its tables. A broken table raises; lost packets are counted."""
    if len(media) % PACKET:
        raise ValueError("not whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not (grid[:, 0] == SYNC).all():
        raise ValueError("lost synchronisation")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    out = Stream(packets=len(grid))
    pat = _table(grid[pids == PAT_PID], 0)
    programs = {pat[i] << 8 | pat[i + 1]: (pat[i + 2] & 0x1F) << 8 | pat[i + 3] for i in range(8, len(pat) - 4, 4)}
    pmt_pid = next(pid for number, pid in programs.items() if number)
    pmt = _table(grid[pids == pmt_pid], 2)
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    media_pid = (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    rows = np.flatnonzero(pids == media_pid)
    own = grid[rows]
    counters = own[:, 3] & 15
    out.discontinuities = int(((np.diff(counters.astype(np.int16)) % 16) != 1).sum())
    adapted = (own[:, 3] & 0x20) > 0
    skip = np.where(adapted, own[:, 4].astype(np.int32) + 1, 0)
    marked = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    out.random_access = rows[marked].tolist()
    clocks = own[marked & ((own[:, 5] & 0x10) > 0), 6:12]
    out.pcr = [int.from_bytes(c.tobytes(), "big") >> 15 for c in clocks]
    begins = np.flatnonzero(own[:, 1] & 0x40)
    parts = []
    for a, b in zip(begins, [*begins[1:], len(own)], strict=True):
        run = own[a:b]
        if skip[a:b].any():
            keep = np.arange(184) >= skip[a:b, None]
            pes = run[:, 4:][keep].tobytes()
        else:
            pes = run[:, 4:].tobytes()
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("no PES start code")
        length = int.from_bytes(pes[4:6], "big")
        if pes[7] & 0x80:
            out.pts.append(_read_pts(pes[9:14]))
        parts.append(pes[9 + pes[8] : 6 + length])
    out.payload = b"".join(parts)
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their own number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def feature(stream: Stream) -> str:
    """Packets, time stamps, random-access points, then the samples' mean, root mean square and zero share."""
    x = np.frombuffer(stream.payload, np.uint8)
    mean, rms = float(x.mean()), float(np.sqrt((x.astype(np.float64) ** 2).mean()))
    last = stream.pts[-1] if stream.pts else 0
    return f"p{stream.packets};t{len(stream.pts)}:{last};r{','.join(map(str, stream.random_access))};m{mean:.4f};e{rms:.4f};z{float((x == 0).mean()):.4f}"


def with_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a binary column of transport streams and ``n_bytes`` (before padding)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                pay = [payload_of(x) for x in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array([n for _, n in pay], pa.int64()), pa.array([encode(p) for p, _ in pay], pa.binary())], ["doc_id", "n_bytes", out]
                )

    return docs.mapInArrow(lean(run), f"doc_id long, n_bytes long, {out} binary")


READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, timestamps array<long>, clocks array<long>, random_access array<long>, discontinuities long"


def store(media: DataFrame) -> DataFrame:
    """Streams as a stored table, read back: later steps see only what was written."""
    return Scratch(media.sparkSession, "media").keep(media, "streams", "zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Parse stored streams: payload digests, features, time stamps, clocks and random-access points (packet numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                raw = media.as_py()
                s = decode(raw)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), s.packets, s.pts, s.pcr, s.random_access, s.discontinuities))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in READ_SCHEMA.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), READ_SCHEMA)
