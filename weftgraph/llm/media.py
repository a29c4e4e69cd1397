"""Media columns: MPEG transport streams.

``mux`` stores a byte payload losslessly as one programme with one elementary
stream: the payload is cut into access units, each a PES packet with its time
stamp, dealt over packets of 188 bytes behind a program association table and
a program map table, with continuity counters, clock references and
random-access marks. ``demux`` reads such a stream by its own tables: it finds
the elementary stream through PAT and PMT, checks their CRCs, the sync bytes
and the continuity counters, reassembles the PES packets and lists time stamps
and random-access points.

Equal payloads give equal streams. Defined results: a null payload counts as
empty and gives a stream of tables only; a damaged stream gives its errors in
``problems`` instead of failing the job, and what can be read of it; packets
sent twice count once. Of several elementary streams the one of smallest PID is
read. Input columns named as an output column (``media``; those of ``READ``)
are replaced, others stay. An empty table gives an empty result. Rows pass
through in slices of bounded size, one row at a time; a very long payload is
held by one task, at a cost in proportion to its length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import slices

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, PRIVATE = 0x100, 0x101, 1, 0x06
UNIT_BYTES, UNIT_TICKS, ACCESS_EVERY = 3840, 3003, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, table_ext: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + table_ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return b"\x00" + head + body + crc_mpeg(head + body).to_bytes(4, "big")  # behind the pointer field


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, control << 4 | counter & 15])


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    out, counter, tables = [], 0, 0
    units = range(0, len(payload), UNIT_BYTES)

    def write_tables() -> None:
        nonlocal tables
        for pid, section in ((0, _PAT), (PMT_PID, _PMT)):
            out.append(_head(pid, True, 1, tables) + section.ljust(PACKET - 4, b"\xff"))
        tables += 1

    if not units:
        write_tables()
    for i, at in enumerate(units):
        unit, pts = payload[at : at + UNIT_BYTES], i * UNIT_TICKS & (1 << 33) - 1
        access = i % ACCESS_EVERY == 0
        if access:
            write_tables()
        data = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
        field = bytes([0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big") if access else b""  # clock reference: 33 bits, 6 reserved, 9 of extension
        sent = 0
        while sent < len(data):
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            part = data[sent : sent + room]
            if len(part) < room:  # fill up with an adaptation field
                fill = room - len(part)
                if not field:
                    field, fill = (b"\x00", fill - 2) if fill > 1 else (b"", 0)
                adaptation = bytes([len(field) + fill]) + field + b"\xff" * fill
            else:
                adaptation = bytes([len(field)]) + field if field else b""
            out.append(_head(ES_PID, sent == 0, 3 if adaptation else 1, counter) + adaptation + part)
            sent, counter, field = sent + len(part), counter + 1, b""
    return b"".join(out)


def _payloads(packets: np.ndarray) -> list[bytes]:
    """What each packet carries behind its header and adaptation field."""
    skip = np.where(packets[:, 3] & 0x20 != 0, packets[:, 4].astype(np.int32) + 5, 4)
    return [raw[min(k, PACKET) :] if has else b"" for raw, k, has in zip(map(bytes, packets), skip.tolist(), (packets[:, 3] & 0x10 != 0).tolist())]


def _section_body(packets: np.ndarray, table_id: int) -> bytes | None:
    """The body of the first section of a table that begins in ``packets`` (of one PID) and whose CRC holds."""
    starts, payloads = packets[:, 1] & 0x40 != 0, _payloads(packets)
    for i in np.flatnonzero(starts).tolist():
        raw = payloads[i]
        held = raw[1 + raw[0] :] if raw else b""  # behind the pointer field
        for more, begins in zip(payloads[i + 1 :], starts[i + 1 :].tolist()):
            if len(held) >= 3 and len(held) >= 3 + ((held[1] & 0x0F) << 8 | held[2]):
                break
            held += more[1 : 1 + more[0]] if begins and more else more
            if begins:
                break
        if len(held) < 3 or held[0] != table_id:
            continue
        section = held[: 3 + ((held[1] & 0x0F) << 8 | held[2])]
        if len(section) >= 12 and crc_mpeg(section) == 0:
            return section[8:-4]
    return None


def _elementary(p: np.ndarray, pid: np.ndarray) -> dict[int, int]:
    """PID and type of the elementary streams that the programmes of the association table list."""
    streams: dict[int, int] = {}
    programmes = _section_body(p[pid == 0], 0) or b""
    for k in range(0, len(programmes) - 3, 4):
        if programmes[k : k + 2] == b"\0\0":
            continue  # programme 0 is the network's table
        listed = _section_body(p[pid == ((programmes[k + 2] & 0x1F) << 8 | programmes[k + 3])], 2) or b""
        at = 4 + ((listed[2] & 0x0F) << 8 | listed[3]) if len(listed) >= 4 else len(listed)
        while at + 5 <= len(listed):
            streams[(listed[at + 1] & 0x1F) << 8 | listed[at + 2]] = listed[at]
            at += 5 + ((listed[at + 3] & 0x0F) << 8 | listed[at + 4])
    return streams


def demux(media: bytes) -> dict:
    """payload, pts and random-access points (index of the unit, byte of its first packet), problems."""
    problems: list[str] = []
    none = {"payload": b"", "pts": [], "access_units": [], "access_bytes": [], "stream_type": -1, "packets": len(media) // PACKET, "problems": problems}
    if len(media) % PACKET or not media:
        problems.append("length")
        return none
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        problems.append("sync")
        return none
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    streams = _elementary(p, pid)
    if not streams:
        problems.append("tables")
        return none
    es = min(streams)
    at = np.flatnonzero(pid == es)
    own = p[at]
    if len(own) > 1:
        # a packet may be sent twice in a row, with the same counter and content but for the clock
        again = np.append(False, ((own[1:, 3] ^ own[:-1, 3]) & 15 == 0) & (own[1:, 3] & 0x10 != 0) & (own[1:, 12:] == own[:-1, 12:]).all(1) & (own[1:, :4] == own[:-1, :4]).all(1))
        at, own = at[~again], own[~again]
    control, start = own[:, 3] >> 4 & 3, own[:, 1] & 0x40 != 0
    counters = own[:, 3] & 15
    adapted = control & 2 != 0
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    off = (np.diff(counters.astype(np.int16)) & 15) != (control[1:] & 1)
    if (off & (flags[1:] & 0x80 == 0)).any():
        problems.append("continuity")
    skip = np.where(adapted, own[:, 4].astype(np.int32) + 5, 4)
    access = flags & 0x40 != 0
    keep = (np.arange(PACKET) >= skip[:, None]) & (control & 1 != 0)[:, None]
    stream, ends = own[keep].tobytes(), np.cumsum(keep.sum(1))
    heads = np.flatnonzero(start)
    begins = (ends[heads] - keep[heads].sum(1)).tolist()
    if begins and begins[0] or not begins and stream:
        problems.append("pes")  # bytes before the first packet of a unit
    parts, pts = [], []
    for a, b in zip(begins, [*begins[1:], len(stream)]):
        pes = stream[a:b]
        length = int.from_bytes(pes[4:6], "big")
        # length 0: up to the next unit
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or length and length != len(pes) - 6 or 9 + pes[8] > len(pes):
            problems.append("pes")
            continue
        if pes[7] & 0x80:
            s = pes[9:14]
            if pes[8] < 5:
                problems.append("pes")
                continue
            pts.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        parts.append(pes[9 + pes[8] :])
    marks = np.flatnonzero(access[heads])
    return {"payload": b"".join(parts), "pts": pts, "access_units": marks.tolist(), "access_bytes": (at[heads][marks] * PACKET).tolist(), "stream_type": streams[es], "packets": len(p), "problems": problems}


def store(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``rows`` with the binary column ``media`` in place of the payload."""
    kept = [f for f in rows.schema if f.name not in (payload_col, "media")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, payload_col):
            media = [mux(x or b"") for x in b.column(payload_col).to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(media, pa.binary())], [*names, "media"])

    return rows.select(*(f"`{c}`" for c in names), f"`{payload_col}`").mapInArrow(run, T.StructType([*kept, T.StructField("media", T.BinaryType())]))


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, stream_type int, packets long, pts array<long>, access_units array<long>, access_bytes array<long>, problems array<string>"


def read(rows: DataFrame) -> DataFrame:
    """``rows`` with what their ``media`` holds, which is read back byte by byte, instead of the bytes."""
    out = T.StructType.fromDDL(READ)
    kept = [f for f in rows.schema if f.name != "media" and f.name not in out.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            cols: list[list] = [[] for _ in range(11)]
            for media in b.column("media").to_pylist():
                got = demux(media or b"")
                payload = got["payload"]
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), got["stream_type"], got["packets"], got["pts"], got["access_units"], got["access_bytes"], got["problems"])
                for col, v in zip(cols, values):
                    col.append(v)
            longs, kinds = pa.list_(pa.int64()), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, [*kinds, longs, longs, longs, pa.list_(pa.string())])]
            yield pa.record_batch([*(b.column(c) for c in names), *arrays], [*names, *out.names])

    return rows.select(*(f"`{c}`" for c in names), "media").mapInArrow(run, T.StructType([*kept, *out.fields]))


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text, filled with spaces to a positive multiple of 192."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(data)
    return F.concat(data, F.encode(F.repeat(F.lit(" "), (F.greatest(F.ceil(n / 192), F.lit(1)) * 192 - n).cast("int")), "UTF-8"))
