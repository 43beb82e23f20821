"""Centroid clustering over subvector dictionaries.

Vectors become integers, ``floor(scale * x)``. Their dimensions are cut into blocks, and each chunk of vectors is dictionary-encoded without loss: a block's distinct
subvectors, and for each vector a code into them. Chunks are written once; a round reads
codes and dictionaries only. In a round each distinct subvector's squared distances to the centroids' same block are computed once, and a vector's distance
is the sum of its codes' entries, so all distances are exact.

A round's sums and counts are added up within each chunk and then by cluster, so what reaches the driver is one row for each
cluster and dimension. Centroids, of bounded number, go to all tasks. What a lost executor had
is computed again from the written chunks.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite, and of integers within ±2^27, where exact distances fit a long; all
others have no row. A null id is kept as it is and never starts a centroid. Repeated ids are vectors of their own; of starts with equal ids the smaller vector comes first.
Ties of distance go to the smaller number. With fewer vectors than centroids each is one; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.session import materialize

#: Integers beyond don't have exact distances.
LARGEST = 1 << 27
#: Vectors of a chunk; codes have 16 bits.
CHUNK = 1 << 15
CHUNKS = "ids array<long>, codes binary, sizes array<int>, entries binary"


def integers(vectors: DataFrame, id_: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``x``, the integers of each vector that is kept."""
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST))
    return vectors.where((F.size(vector) == dims) & good).select(F.col(id_).cast("long").alias("id"), whole.alias("x"))


def coded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block and each row's code."""
    code = np.zeros(len(column), np.int64)
    for values in column.T:  # rows so far by the next dimension's values: never larger than the number of rows squared
        known, at = np.unique(values, return_inverse=True)
        code = np.unique(code * len(known) + at.ravel(), return_inverse=True)[1].ravel()
    first = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    first[code] = np.arange(len(code))
    return column[first], code.astype(np.uint16)


def encode(rows: DataFrame, block: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of at most ``chunk`` vectors: ids, codes (a row for each block), and each block's number of entries and the entries themselves."""

    def encoded(ids: list[np.ndarray], xs: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(xs)
        parts = [coded(x[:, i : i + block]) for i in range(0, x.shape[1], block)]
        codes = np.stack([code for _, code in parts]).tobytes()
        entries = b"".join(np.ascontiguousarray(e, np.int32).tobytes() for e, _ in parts)
        columns = [pa.concat_arrays(ids)], [codes], [[len(e) for e, _ in parts]], [entries]
        kinds = pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary()
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(columns[0][0])], pa.int32()), columns[0][0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "codes", "sizes", "entries"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        xs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)
            at = 0
            while at < batch.num_rows:
                n = min(chunk - held, batch.num_rows - at)
                ids.append(batch.column(0).slice(at, n))
                xs.append(x[at : at + n])
                held, at = held + n, at + n
                if held == chunk:
                    yield encoded(ids, xs)
                    ids, xs, held = [], [], 0
        if held:
            yield encoded(ids, xs)

    return rows.select("id", "x").mapInArrow(chunks, CHUNKS)


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, a row each, and the block size of the dictionaries."""

    points: np.ndarray
    block: int

    def tables(self, sizes: list[int], entries: bytes) -> Iterator[np.ndarray]:
        """For each block the squared distance of each entry to each centroid."""
        flat, at = np.frombuffer(entries, np.int32).astype(np.int64), 0
        for i, size in enumerate(sizes):
            part = self.points[:, i * self.block : (i + 1) * self.block]
            width = part.shape[1]
            sub = flat[at : at + size * width].reshape(size, width)
            at += size * width
            table = np.zeros((size, len(part)), np.int64)
            for d in range(width):
                table += (sub[:, d : d + 1] - part[:, d]) ** 2
            yield table

    def nearest(self, n: int, codes: bytes, sizes: list[int], entries: bytes, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid and the distance of each of a chunk's ``n`` vectors."""
        code = np.frombuffer(codes, np.uint16).reshape(-1, n)
        tables = [*self.tables(sizes, entries)]
        cluster, distance = np.empty(n, np.int32), np.empty(n, np.int64)
        for a in range(0, n, step):
            total = sum(table[c[a : a + step]] for table, c in zip(tables, code, strict=True))
            cluster[a : a + step] = total.argmin(1)
            distance[a : a + step] = total.min(1)
        return cluster, distance

    def digests(self) -> list[str]:
        """The sha256 of each centroid's components, in decimal and joined by commas."""
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.points.tolist()]


def _sums(chunks: DataFrame, now: Centroids) -> DataFrame:
    """``cluster``, ``n`` and ``sums`` by dimension of all vectors nearest to each centroid."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = now.points.shape
        n_all, all_ = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch.column(0)[row])
                codes, sizes, entries = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                cluster, _ = now.nearest(n, codes, sizes, entries)
                n_all += np.bincount(cluster, minlength=k)
                code, flat, at = np.frombuffer(codes, np.uint16).reshape(-1, n), np.frombuffer(entries, np.int32).astype(np.int64), 0
                for i, size in enumerate(sizes):  # entries of each cluster are counted, then added up once each
                    width = min(now.block, dims - i * now.block)
                    times = np.bincount(cluster.astype(np.int64) * size + code[i], minlength=k * size).reshape(k, size)
                    all_[:, i * now.block : i * now.block + width] += times @ flat[at : at + size * width].reshape(size, width)
                    at += size * width
        held = np.flatnonzero(n_all)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dims, pa.int32()), pa.array(all_[held].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n_all[held]), sums], ["cluster", "n", "sums"])

    parts = chunks.mapInArrow(summed, "cluster int, n long, sums array<long>")
    by = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim")
    return by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def moved(chunks: DataFrame, now: Centroids) -> Centroids:
    """The centroids after a round: floors of the means of their vectors; empty ones stay."""
    points = now.points.copy()
    for row in _sums(chunks, now).collect():  # a row for each cluster and dimension
        points[row["cluster"], row["dim"]] = row["s"] // row["n"]
    return Centroids(points, now.block)


def assigned(chunks: DataFrame, now: Centroids) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of every vector."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0).slice(row, 1).flatten()
                cluster, distance = now.nearest(len(ids), *(batch.column(i)[row].as_py() for i in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return chunks.mapInArrow(nearest, "id long, cluster int, distance long")


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<id>``, in the order of that."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    found = rows.where(F.col("id").isNotNull()).select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([row["x"] for row in found], np.int64)


def cluster(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, block: int = 2
) -> tuple[DataFrame, Centroids]:
    """The final assignment ``(id, cluster, distance)`` of all kept vectors, and the final centroids."""
    rows = integers(vectors, id_, vector, dims, scale)
    now = Centroids(starts(rows, k, seed), block)
    if not len(now.points):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), now
    chunks = materialize(encode(rows, block), "vector-chunks")
    for _ in range(rounds):
        now = moved(chunks, now)
    return assigned(chunks, now), now


def with_inertia(found: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; what meets the rows is one row for each cluster."""
    digests = found.sparkSession.createDataFrame(list(enumerate(centroids.digests())), "_of int, centroid_sha256 string")
    sums = found.groupBy(F.col("cluster").alias("_of")).agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    known = sums.join(digests, "_of").crossJoin(F.broadcast(total))
    return found.join(F.broadcast(known), found.cluster == known._of).drop("_of")
