"""Media columns of MPEG transport streams.

A payload of 8-bit samples is stored in packets of 188 bytes: a program
association table, a program map table and one elementary stream whose
packetized units carry ``UNIT`` frames of 576 samples each with a presentation
timestamp; every ``RANDOM_EVERY``-th unit starts at a random-access point, which carries the clock reference. The
tables are repeated before each of these.

Reading parses the tables to find the elementary stream, checks sync bytes,
section checksums and continuity counters, reassembles the units and lists
their timestamps and random-access points.

Nulls and empty texts are one frame of filling bytes; a null stream reads as nulls, a broken one as nulls with its ``error``. Streams are independent:
equal texts give equal streams, repeated rows repeat results, an empty table stays empty.
Extra columns pass through; output names replace columns of the same name.
"""

from __future__ import annotations

import functools
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, FILL = 576, 255
#: Frames in a unit, units from one random-access point to the next.
UNIT, RANDOM_EVERY = 16, 8
#: Fixed values of the format: packet size, sync byte, ids of the two tables' streams and of ours, its private stream type and id.
PACKET, SYNC, PAT_PID, PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID, PROGRAM = 188, 0x47, 0, 0x100, 0x101, 0x06, 0xBD, 1
#: Ticks of the 90 kHz clock in a frame of 576 samples at 8,000 samples a second.
TICKS = 90_000 * FRAME // 8_000
CLOCK = 1 << 33


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(value)
    return table


def section_crc(data: bytes) -> int:
    """The checksum of a table section: zero over a section with its checksum."""
    value, table = 0xFFFFFFFF, _crc_table()
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ byte]
    return value


def _section(table_id: int, own_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + own_id.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


@functools.cache
def _table_packets() -> np.ndarray:
    """The packets of both tables, with continuity counters of zero."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(
        2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
    )
    out = np.full((2, PACKET), 0xFF, np.uint8)
    for row, (pid, section) in enumerate(((PAT_PID, pat), (PMT_PID, pmt))):
        head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
        out[row, : len(head)] = np.frombuffer(head, np.uint8)
    return out


def _timestamp(ticks: int) -> bytes:
    ticks %= CLOCK
    return bytes([0x21 | ticks >> 29 & 0xE, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of whole frames."""
    packets, counter, tables = [], 0, 0
    step = UNIT * FRAME
    for number, at in enumerate(range(0, len(payload), step)):
        random = number % RANDOM_EVERY == 0
        if random:
            pair = _table_packets().copy()
            pair[:, 3] |= tables & 0xF
            tables += 1
            packets.append(pair)
        body = payload[at : at + step]
        ticks = number * UNIT * TICKS % CLOCK
        unit = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05"
        unit += _timestamp(ticks) + body
        lead = 8 * random  # the adaptation field that marks a random-access point: length, flags, clock reference
        n = -(-(len(unit) + lead) // 184)
        out = np.zeros((n, PACKET), np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 0xF
        counter = (counter + n) & 0xF
        field = np.zeros(n, np.int64)  # bytes of adaptation field
        field[0] = lead
        field[-1] += n * 184 - lead - len(unit)  # filling goes into the last packet's field
        for i in {0, n - 1}:
            if field[i]:
                out[i, 3] |= 0x20
                out[i, 4] = field[i] - 1
                if field[i] > 1:
                    out[i, 5] = 0x50 if random and i == 0 else 0
                    out[i, 6 : 4 + field[i]] = 0xFF
                    if random and i == 0:
                        out[i, 6:12] = [*(ticks >> n & 0xFF for n in (25, 17, 9, 1)), (ticks & 1) << 7 | 0x7E, 0]
        out[np.arange(PACKET) >= 4 + field[:, None]] = np.frombuffer(unit, np.uint8)
        packets.append(out)
    return np.concatenate(packets).tobytes()


class Stream:
    """What a transport stream holds: ``payload``, and for each unit its timestamp and whether it is a random-access point."""

    def __init__(self, media: bytes):
        if not media or len(media) % PACKET:
            raise ValueError("not a whole number of packets")
        packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (packets[:, 0] != SYNC).any():
            raise ValueError("a packet has no sync byte")
        pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
        self.packets, self.discontinuities = len(packets), 0
        for own in np.unique(pid):
            rows = packets[pid == own]
            counters = rows[(rows[:, 3] & 0x10) > 0, 3] & 0xF
            self.discontinuities += int(((np.diff(counters.astype(np.int64)) & 0xF) != 1).sum())
        programs = self._tables(packets[pid == PAT_PID], 0)
        self.program, body = programs, int.from_bytes(programs[2:4], "big") & 0x1FFF
        streams = self._tables(packets[pid == body], 2)
        at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
        self.stream_type, media_pid = streams[at], int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
        self._units(packets[pid == media_pid])

    @staticmethod
    def _tables(packets: np.ndarray, table_id: int) -> bytes:
        """The body of a table's section; all its copies must be equal and have a right checksum."""
        if not len(packets) or (packets[:, 4:] != packets[0, 4:]).any():
            raise ValueError("a table is missing or changes")
        data = packets[0, 5:].tobytes()
        section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
        if section[0] != table_id or section_crc(section):
            raise ValueError("a table's checksum is wrong")
        return section[8:-4]

    def _units(self, packets: np.ndarray) -> None:
        has_field = (packets[:, 3] & 0x20) > 0
        begin = np.where(has_field, 5 + packets[:, 4].astype(np.int64), 4)
        flagged = has_field & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
        flat = packets[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        starts = np.flatnonzero(packets[:, 1] & 0x40)
        first = (ends - (PACKET - begin))[starts]
        parts, self.timestamps, self.random_access = [], [], flagged[starts].tolist()
        for at, end in zip(first.tolist(), [*first[1:].tolist(), len(flat)], strict=True):
            length = int.from_bytes(flat[at + 4 : at + 6], "big")
            if flat[at : at + 3] != b"\x00\x00\x01" or at + 6 + length != end:
                raise ValueError("a unit is cut off")
            a, b, c, d, e = flat[at + 9 : at + 14]
            self.timestamps.append((a & 0xE) << 29 | b << 22 | (c & 0xFE) << 14 | d << 7 | e >> 1)
            parts.append(flat[at + 9 + flat[at + 8] : end])
        self.payload = b"".join(parts)
        clocks = packets[has_field & (packets[:, 4] >= 7) & (packets[:, 5] & 0x10 > 0), 6:11].astype(np.int64)
        self.clocks = (clocks[:, 0] << 25 | clocks[:, 1] << 17 | clocks[:, 2] << 9 | clocks[:, 3] << 1 | clocks[:, 4] >> 7).tolist()

    def feature(self) -> str:
        """Counts, the span of timestamps in ticks, and mean and spread of the samples."""
        samples = np.frombuffer(self.payload, np.uint8)
        total, squares = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
        n = len(samples)
        return (
            f"packets={self.packets} units={len(self.timestamps)} random={sum(self.random_access)}"
            f" first={self.timestamps[0]} last={self.timestamps[-1]} gaps={self.discontinuities}"
            f" mean={total // n} variance={(squares * n - total * total) // (n * n)}"
        )


def padded(text: str | None) -> bytes:
    """The text in UTF-8, filled up to a positive whole number of frames."""
    data = (text or "").encode()
    return data + bytes([FILL]) * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the binary column ``media`` with the transport stream of each whole text."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([mux(padded(x)) for x in texts.to_pylist()], pa.binary())

    return df.withColumn(media, stored(F.col(text)))


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the streams of ``media`` hold: payload and its digests, timestamps, random-access points, ``feature``, and the ``error`` of those that can't be read."""
    kinds = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
        "media_sha256": pa.string(), "feature": pa.string(), "timestamps": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64()), "error": pa.string(),
    }
    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.arrow_udf(ddl + ", timestamps array<long>, random_access array<long>, error string")
    def parsed(values: pa.Array) -> pa.Array:
        rows = []
        for value in values:
            if not value.is_valid:
                rows.append((None,) * len(kinds))
                continue
            data = value.as_buffer().to_pybytes()
            try:
                stream = Stream(data)
            except (ValueError, IndexError) as failure:
                rows.append((*(None,) * (len(kinds) - 1), f"{type(failure).__name__}: {failure}"))
                continue
            points = [i for i, flag in enumerate(stream.random_access) if flag]
            own = stream.payload
            rows.append(
                (len(own), sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(data), sha256(data).hexdigest(), stream.feature(), stream.timestamps, points, None)
            )
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])

    out = df.withColumn("_stream", parsed(F.col(media)))
    return out.withColumns({name: F.col(f"_stream.{name}") for name in kinds}).drop("_stream")
