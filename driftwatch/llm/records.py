"""Length-delimited binary record files of token ids, with an offset index.

A record is one document. Its frame is

    u64 length | u32 masked checksum of the length | payload | u32 masked checksum of the payload

all little-endian, and frames follow each other without anything between. A checksum is CRC-32C, masked by rotating it right by 15
bits and adding a constant. The payload is ``i64 doc_id | u32 tokens | zstd | u32 seal``, zstd of the ids as unsigned
16-bit integers (32-bit ones in a vocabulary of more than 65,536 ids). The seal is chosen so that the last byte of
the frame is a byte 10.

Spark's own text sink writes the frames as raw bytes, without their last one, which is the row end that it adds; a lost task's files are
written again. Files lie under ``records`` of the folder and follow each other by name in the order
of ``doc_id``, each ordered within and made of at most about ``file_bytes`` bytes of text. Reading the files back checks all
checksums, and gives the offset index, written under ``index``: a row for each record with its file,
offset and length, from which ``read_records`` reads any of them in any order.

Nulls and empty texts have the end id only. A null ``doc_id`` comes first and is
read back as null; equal ids are ordered by a hash of their text, then the text;
repeated rows are written as often. Extra columns aren't written; an empty table
gives files without records.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.llm.tokens import text_encoder

#: Fixed values of the frame format: the mask's constant, the reversed polynomial of CRC-32C.
MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78
BLOCK = 256
#: The id that stands for null.
NO_ID = -(1 << 63)
INDEX = "file string, number long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum table of one byte, and of a state that ``BLOCK`` zero bytes follow, by the state's byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    skip = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(BLOCK):
        skip = table[skip & 0xFF] ^ (skip >> np.uint32(8))
    return table, skip


def checksums(parts: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each part, all parts at once: blocks side by side, then block after block.

    Zero bytes in front of a message leave a zero state as it is, so parts are padded there to whole blocks; the
    initial state is folded into the first four bytes instead.
    """
    table, skip = _tables()
    sizes = np.array([max(len(p), 4) for p in parts], np.int64)
    blocks = -(-sizes // BLOCK)
    data = np.zeros((int(blocks.sum()), BLOCK), np.uint8)
    flat, ends = data.reshape(-1), np.cumsum(blocks) * BLOCK
    for part, end in zip(parts, ends.tolist(), strict=True):
        flat[end - len(part) : end] = np.frombuffer(part, np.uint8)
        if len(part) >= 4:
            flat[end - len(part) : end - len(part) + 4] ^= 0xFF
    state = np.zeros(len(data), np.uint32)
    for column in np.ascontiguousarray(data.T):
        state = table[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    first = ends // BLOCK - blocks
    out = np.zeros(len(parts), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    live = len(parts)
    for k in range(int(blocks.max(initial=0))):
        while live and blocks[order[live - 1]] <= k:
            live -= 1
        rows = order[:live]
        now = out[rows]
        moved = skip[0][now & 0xFF] ^ skip[1][now >> 8 & 0xFF] ^ skip[2][now >> 16 & 0xFF] ^ skip[3][now >> 24]
        out[rows] = moved ^ state[first[rows] + k]
    out = out ^ np.uint32(0xFFFFFFFF)
    for i, part in enumerate(parts):
        if len(part) < 4:
            now = 0xFFFFFFFF
            for byte in part:
                now = int(table[(now ^ byte) & 0xFF]) ^ now >> 8
            out[i] = now ^ 0xFFFFFFFF
    return (out >> np.uint32(15) | out << np.uint32(17)) + np.uint32(MASK_DELTA)


def seals(bodies: list[bytes]) -> np.ndarray:
    """Four bytes for each body, as a number, behind which the masked checksum ends in byte 10.

    The other bytes of that checksum are those that the body's own has. The last four bytes lead from any state to any other: the way back is by the tables' last bytes.
    """
    table = _tables()[0]
    last = np.zeros(256, np.uint32)
    last[table >> np.uint32(24)] = np.arange(256, dtype=np.uint32)
    own = checksums(bodies)
    state, wanted = (
        ~((x - np.uint32(MASK_DELTA)) >> np.uint32(17) | (x - np.uint32(MASK_DELTA)) << np.uint32(15)) for x in (own, own & np.uint32(0xFFFFFF) | np.uint32(10 << 24))
    )
    for _ in range(4):
        at = last[wanted >> np.uint32(24)]
        wanted = (wanted ^ table[at]) << np.uint32(8) | at
    return wanted ^ state


def frames(bodies: list[bytes]) -> list[bytes]:
    """The frames of payloads that are sealed here; each ends in byte 10."""
    payloads = [body + seal.tobytes() for body, seal in zip(bodies, seals(bodies).astype("<u4"), strict=True)]
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = checksums(lengths + payloads).astype("<u4")
    half = len(payloads)
    return [
        length + sums[i].tobytes() + payload + sums[half + i].tobytes()
        for i, (length, payload) in enumerate(zip(lengths, payloads, strict=True))
    ]


def payload(doc_id: int | None, ids: np.ndarray, wide: bool, press: zstandard.ZstdCompressor) -> bytes:
    """The payload of one record, before it is sealed."""
    body = press.compress(ids.astype("<u4" if wide else "<u2").tobytes())
    return struct.pack("<qI", NO_ID if doc_id is None else doc_id, len(ids)) + body


def read_payload(data: bytes, wide: bool) -> tuple[int | None, np.ndarray]:
    """The id and token ids of a payload."""
    doc_id, n = struct.unpack_from("<qI", data)
    ids = np.frombuffer(zstandard.decompress(data[12:-4]), "<u4" if wide else "<u2").astype("<u4")
    if len(ids) != n:
        raise ValueError(f"a record of {len(ids)} ids says that it has {n}")
    return None if doc_id == NO_ID else doc_id, ids


def read_frames(content: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The offsets and payloads of a file's records; raises ValueError if a checksum or a frame is wrong."""
    at, offsets, lengths, payloads, sums = 0, [], [], [], []
    while at < len(content):
        length = content[at : at + 8]
        end = at + 12 + (struct.unpack("<Q", length)[0] if len(length) == 8 else len(content))
        if end + 4 > len(content):
            raise ValueError(f"the record at byte {at} is cut off")
        offsets.append(at)
        lengths.append(length)
        payloads.append(content[at + 12 : end])
        sums += [content[at + 8 : at + 12], content[end : end + 4]]
        at = end + 4
    told = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2).T.ravel()
    if (checksums(lengths + payloads) != told).any():
        raise ValueError("a record's checksum is wrong")
    return np.array(offsets, np.int64), payloads


def write_records(
    docs: DataFrame, path: str, json_path: str, ranks_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 1 << 28
) -> None:
    """Writes the record files of all documents to the folder ``path``."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = text_encoder(json_path, ranks_path), zstandard.ZstdCompressor(level=1)
        wide = encoder.quick.n_vocab > 1 << 16
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            made = [payload(one, np.append(encoder.encode(value or ""), np.uint32(end_id)), wide, press) for one, value in rows]
            yield pa.RecordBatch.from_arrays([pa.array([frame[:-1] for frame in frames(made)], pa.binary())], ["frame"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(framed, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(f"{path}/records")


def write_index(spark: SparkSession, path: str, json_path: str, ranks_path: str) -> DataFrame:
    """Reads and checks the files and writes their offset index: a row for each record, with the ids before it in its file."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = text_encoder(json_path, ranks_path).quick.n_vocab > 1 << 16
        names = [field.split(" ")[0] for field in INDEX.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                offsets, payloads = read_frames(content.as_buffer().to_pybytes())
                docs, tokens, crcs = [], [], []
                for data in payloads:
                    one, ids = read_payload(data, wide)
                    docs.append(one)
                    tokens.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                count = np.array(tokens, np.int64)
                columns = [[file.as_py()] * len(docs), np.arange(len(docs)), offsets, [len(p) for p in payloads]]
                columns += [docs, count, count.cumsum() - count, crcs]
                kinds = [pa.string(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files.select("path", "content").mapInArrow(indexed, INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of the folder ``path``."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, wanted: DataFrame, path: str, json_path: str, ranks_path: str) -> DataFrame:
    """``doc_id``, ``file``, ``offset`` and ``ids`` of those rows of the index that are ``wanted``, in no order: rows that are shuffled or sampled are cut out by their offsets.

    Each file is opened once, for all of its wanted records, and files of none aren't opened. Only the checksums of these records are checked; a wrong
    one raises ValueError. A row that is wanted twice comes twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = text_encoder(json_path, ranks_path).quick.n_vocab > 1 << 16
        names = ["doc_id", "file", "offset", "ids"]
        for batch in batches:
            for file, content, wanted in zip(*batch.columns, strict=True):
                data, rows = memoryview(content.as_buffer()), wanted.as_py()
                for at in range(0, len(rows), 1000):
                    some = rows[at : at + 1000]
                    found = [read_frames(bytes(data[r["offset"] : r["offset"] + r["length"] + 16]))[1][0] for r in some]
                    docs, ids = zip(*(read_payload(x, wide) for x in found), strict=True)
                    columns = [pa.array(docs, pa.int64()), pa.array([file.as_py()] * len(some)), pa.array([r["offset"] for r in some]), pa.array(ids, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))  # of one file, whose size is bounded
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    some = files.select(F.col("path").alias("file"), "content").join(places, "file")
    return some.select("file", "content", "wanted").mapInArrow(cut, "doc_id long, file string, offset long, ids array<long>")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before, in the order of files and offsets.

    Only one row for each file is put in order in one task; their number is that of the files, not of the records.
    """
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    joined = index.join(files, index.file == files.of)
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("of", "base")
