"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a binary payload column as one transport stream per row: a program association table, a program
map table and one private elementary stream, cut into PES packets that carry presentation timestamps; every
access unit starts with a clock reference, LEAD ticks before its timestamp, and every ``RAP_EVERY``-th one is marked as a
random-access point. ``demux`` reads such streams, its own or others of 188-byte packets: it follows the program
tables (sections may go over several packets, or share one) to the first program's first elementary stream, leaves out
packets that were sent twice, checks the continuity counters, reassembles the PES packets and returns payload,
timestamps, clock references and random-access points. Encrypted packets and packets of other sizes aren't read.

Both are per-row column operators: no shuffle, memory of a few times one row, however long its text. Defined cases: a
null payload counts as empty; an empty payload gives one empty access unit; rows that are equal give equal streams; extra
columns are carried along, but for those that have the name of a new one; a damaged stream gives ``ok = false`` and what
could be read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0, 0x1000, 0x100
#: Private data in PES packets; its PES stream id.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in an access unit; ticks of the 90 kHz clock between units; units from one random-access point to the next.
UNIT_BYTES, TICKS, RAP_EVERY = 192 * 96, 3600, 8
#: Ticks from a unit's clock reference to its timestamp.
LEAD = 9000
#: Payload bytes of a unit's first packet at most: flags and clock reference take 8.
FIRST_BYTES = 176
PAD_TO = 192

READ_BACK = "payload binary, ok boolean, n_packets bigint, n_units bigint, cc_errors bigint, es_pid int, stream_type int, pts array<bigint>, pcr array<bigint>, rap array<bigint>"


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _crc_table()[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", crc32_mpeg(section))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return packet.ljust(PACKET, b"\xff")


@cache
def _tables() -> bytes:
    pat = struct.pack(">HH", 1, 0xE000 | PMT_PID)
    pmt = struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)
    return _section_packet(PAT_PID, 0, 1, pat) + _section_packet(PMT_PID, 2, 1, pmt)


def _pts_bytes(pts: int) -> bytes:
    return bytes((0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)))


def _pcr_bytes(pcr: int) -> bytes:
    """A clock reference of 33 bits at 90 kHz; its finer part is 0."""
    return struct.pack(">IH", pcr >> 1, (pcr & 1) << 15 | 0x7E00)


def _unit_packets(unit: bytes, number: int, counter: int) -> np.ndarray:
    """One access unit as transport packets; the first has an adaptation field with its clock reference and the random-access flag."""
    pes = struct.pack(">BBBBHBBB", 0, 0, 1, STREAM_ID, len(unit) + 8, 0x80, 0x80, 5) + _pts_bytes((number * TICKS + LEAD) % (1 << 33)) + unit
    body = np.frombuffer(pes, np.uint8)
    first = min(len(body), FIRST_BYTES)
    rest = len(body) - first
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = 183 - first, 0x50 if number % RAP_EVERY == 0 else 0x10
    out[0, 6:12] = np.frombuffer(_pcr_bytes(number * TICKS % (1 << 33)), np.uint8)
    out[0, PACKET - first :] = body[:first]
    whole = rest // 184
    if whole:
        out[1 : 1 + whole, 4:] = body[first : first + whole * 184].reshape(whole, 184)
    if left := rest - whole * 184:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - left
        if left < 183:
            out[-1, 5] = 0
        out[-1, PACKET - left :] = body[-left:]
    return out


def mux_bytes(payload: bytes) -> bytes:
    parts, counter = [_tables()], 0
    for number, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        packets = _unit_packets(payload[at : at + UNIT_BYTES], number, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _whole(buffer: bytes) -> tuple[list[bytes], bytes]:
    """The sections that a buffer holds whole, and what is left of it; stuffing ends it."""
    out = []
    while len(buffer) >= 3 and buffer[0] != 0xFF:
        size = 3 + (struct.unpack(">H", buffer[1:3])[0] & 0xFFF)
        if len(buffer) < size:
            return out, buffer
        out.append(buffer[:size])
        buffer = buffer[size:]
    return out, buffer if buffer[:1] != b"\xff" else b""


def _sections(packets: np.ndarray) -> Iterator[bytes]:
    """The sections carried by one PID's packets, in order; those of damaged runs are left to their checksum."""
    buffer, last = b"", b""
    for row in packets:
        raw = row.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        if raw == last or not raw[3] & 0x10 or at >= PACKET:
            continue
        last = raw
        if raw[1] & 0x40:  # a section starts behind the end of the one before
            start = at + 1 + raw[at]
            done, _ = _whole(buffer + raw[at + 1 : start]) if buffer else ([], b"")
            yield from done
            buffer = raw[start:]
        elif buffer:
            buffer += raw[at:]
        done, buffer = _whole(buffer)
        yield from done


def _section(packets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes | None:
    """The body of the first whole, unbroken section of a table on a PID."""
    for section in _sections(packets[pid == wanted]):
        if section[0] == table_id and len(section) >= 12 and crc32_mpeg(section) == 0:
            return section[8:-4]
    return None


def _sent_once(es: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which packets aren't the second copy of the one before: same counter and payload, the clock reference aside."""
    if len(es) < 2:
        return np.ones(len(es), bool)
    same = (es[1:, 3] & 15 == es[:-1, 3] & 15) & (start[1:] == start[:-1])
    again = np.zeros(len(es), bool)
    at = np.flatnonzero(same)
    inside = np.arange(PACKET)[None, :] >= start[at][:, None]
    again[at + 1] = ((es[at] == es[at + 1]) | ~inside).all(axis=1)
    again[1:] &= ~again[:-1]  # a packet may be sent twice, not three times
    return ~again


def demux_bytes(media: bytes) -> dict:
    """Payload, timestamps and random-access units of the first program's first elementary stream."""
    out = {"payload": b"", "ok": False, "n_packets": len(media) // PACKET, "n_units": 0, "cc_errors": 0, "es_pid": None, "stream_type": None, "pts": [], "pcr": [], "rap": []}
    packets = np.frombuffer(media[: out["n_packets"] * PACKET], np.uint8).reshape(-1, PACKET)
    whole = len(media) % PACKET == 0 and len(packets) > 0 and bool((packets[:, 0] == SYNC).all())
    pid = ((packets[:, 1] & 0x1F).astype(np.int32) << 8) | packets[:, 2]
    pat = _section(packets, pid, PAT_PID, 0)
    programs = [struct.unpack(">HH", pat[i : i + 4]) for i in range(0, len(pat) - 3, 4)] if pat else []
    programs = [(n, p & 0x1FFF) for n, p in programs if n]
    pmt = _section(packets, pid, programs[0][1], 2) if programs else None
    if not pmt or len(pmt) < 9:
        return out
    at = 4 + (struct.unpack(">H", pmt[2:4])[0] & 0xFFF)
    out["stream_type"], out["es_pid"] = pmt[at], struct.unpack(">H", pmt[at + 1 : at + 3])[0] & 0x1FFF
    es = packets[(pid == out["es_pid"]) & (packets[:, 3] & 0x10 > 0)]
    if not len(es):
        return out
    start = np.where(es[:, 3] & 0x20 > 0, 5 + es[:, 4].astype(np.int64), 4)
    once = _sent_once(es, start)
    es, start = es[once], start[once]
    flags = np.where((es[:, 3] & 0x20 > 0) & (es[:, 4] > 0), es[:, 5], 0)
    jumps = ((np.diff(es[:, 3] & 15) & 15) != 1) & (flags[1:] & 0x80 == 0)  # a marked discontinuity is none
    out["cc_errors"] = int(jumps.sum())
    clocks = es[(flags & 0x10 > 0) & (start >= 12), 6:12].astype(np.int64)
    out["pcr"] = (clocks[:, 0] << 25 | clocks[:, 1] << 17 | clocks[:, 2] << 9 | clocks[:, 3] << 1 | clocks[:, 4] >> 7).tolist()
    bytes_of = np.maximum(PACKET - start, 0)
    stream = es[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    offset = np.concatenate(([0], np.cumsum(bytes_of)))
    firsts = np.flatnonzero(es[:, 1] & 0x40)
    flagged = flags & 0x40 > 0
    units, good = [], True
    for k, row in enumerate(firsts):
        pes = stream[offset[row] : offset[firsts[k + 1]] if k + 1 < len(firsts) else offset[-1]]
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            good = False
            continue
        size = struct.unpack(">H", pes[4:6])[0]
        good &= size in (0, len(pes) - 6)
        if pes[7] & 0x80 and len(pes) >= 14:
            a, b, c, d, e = pes[9:14]
            out["pts"].append((a & 0x0E) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
        if flagged[row]:
            out["rap"].append(k)
        units.append(pes[9 + pes[8] :])
    out |= {"payload": b"".join(units), "n_units": len(units), "ok": whole and good and out["cc_errors"] == 0}
    return out


def _fields(df: DataFrame, drop: set[str]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in drop])


def mux(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replace a binary payload column by a column of transport streams."""
    kept = [c for c in df.columns if c not in (payload, media)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [mux_bytes(x or b"") for x in b.column(b.schema.get_field_index(payload)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(rows, pa.binary())], [*kept, media])

    return df.mapInArrow(run, T.StructType([*_fields(df, {payload, media}), T.StructField(media, T.BinaryType())]))


def demux(df: DataFrame, media: str = "media") -> DataFrame:
    """Add what the transport streams of a column hold (READ_BACK); the media column stays."""
    new = T._parse_datatype_string(READ_BACK) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(READ_BACK)
    names = [f.name for f in new]
    kept = [c for c in df.columns if c not in names]
    kinds = {"payload": pa.binary(), "ok": pa.bool_(), "es_pid": pa.int32(), "stream_type": pa.int32(), "pts": pa.list_(pa.int64()), "pcr": pa.list_(pa.int64()), "rap": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [demux_bytes(x or b"") for x in b.column(b.schema.get_field_index(media)).to_pylist()]
            cols = [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *cols], [*kept, *names])

    return df.mapInArrow(run, T.StructType([*_fields(df, set(names)), *new]))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a transport stream, read it back and digest both forms."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    pad = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(float(PAD_TO)))) * PAD_TO
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"), pad.cast("int").alias("full"))
    rows = rows.select("doc_id", "n_bytes", F.expr("rpad(data, full, X'20')").alias("payload"))
    back = demux(mux(rows))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    feature = F.format_string("packets=%d;units=%d;pid=%d;type=%d;cc_errors=%d;ok=%s;pts=%s;rap=%s", "n_packets", "n_units", F.coalesce("es_pid", F.lit(-1)), F.coalesce("stream_type", F.lit(-1)), "cc_errors", F.col("ok").cast("string"), joined("pts"), joined("rap"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 15, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "ok",
    )
