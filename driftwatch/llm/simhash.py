"""SimHash near-dedup with a pigeonring filter.

A fingerprint has 64 bits in a ring of ``RING`` segments of 16 bits. Two
fingerprints that differ in at most ``BUDGET`` = 2 bits have a segment from
which every chain of 1, 2, 3, 4 consecutive segments differs in at most
length * 2 / 4 bits, rounded down: 0, 1, 1, 2. So the segment at the start is
equal, and of the next two (4 bytes) three bytes are equal at least. Each
distinct fingerprint is filed under its 4 starts times the 4 bytes that may
differ, 16 keys of 40 equal bits each. Rows that share a key are candidates; they must
keep the chain budgets and then the full Hamming check.

Copies never meet: equal fingerprints are one row from the start. A bucket holds
at most 2 ** 24 distinct fingerprints (its free bits), so a task's memory is
bounded, and it emits at most one link for each of its rows, to the row that
its local component is named after. Small buckets compare their rows by
vectorised offsets. A bucket over ``DENSE`` rows groups its rows by the variants
that differ in one free bit or none instead: two rows share one exactly if
they differ in at most two of the free bits. That is as exact and takes time in
proportion to its rows.

Components come from rounds of large-star and small-star links, with all joins
on keys that AQE can split.

Nulls, empty texts and texts of white space have fingerprint zero. A null
``doc_id`` is a document of its own id null: it links like any other, but never
names a component, unless all its members are null. Repeated rows repeat
results, ties can't arise, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.components import components
from driftwatch.session import materialize

RING, WIDTH, BUDGET = 4, 16, 2
#: Buckets of more rows are linked by variants.
DENSE = 256
#: From so many rows on, the variants of a bucket are not all made at once.
VAST = 1 << 18
SEED = 42
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ONE = np.uint64(1)


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of the shingles of ``words`` words of a whole text."""
    found = text.encode().translate(LOWERED).split()
    if not found:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(found) <= words:
        shingles = [join(found)]
    else:
        shingles = map(join, zip(*(found[i:] for i in range(words)), strict=False))
    return majority(np.fromiter((digest(x, SEED) for x in shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # bounds the memory that a long text takes
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(x or "", words) for x in texts.to_pylist()], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(name, of(F.col(text)))


def _segment(values: np.ndarray, i: int) -> np.ndarray:
    """Segment ``i`` of the ring, counted from the lowest bits."""
    return (values >> np.uint64(WIDTH * (i % RING))) & np.uint64(0xFFFF)


def ring_keys(values: np.ndarray) -> np.ndarray:
    """The 16 keys of each fingerprint: the start, the byte left open, and the 40 bits that must be equal."""
    keys = []
    for start in range(RING):
        head, chain = _segment(values, start), _segment(values, start + 1) << np.uint64(16) | _segment(values, start + 2)
        for byte in range(4):
            low = chain & np.uint64((1 << 8 * byte) - 1)
            high = chain >> np.uint64(8 * (byte + 1)) << np.uint64(8 * byte)
            keys.append(np.uint64(start * 4 + byte) << np.uint64(40) | head << np.uint64(24) | high | low)
    return np.stack(keys, 1)


def chain_holds(start: np.ndarray, differ: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Whether the chains from segment ``start`` keep their shares of ``budget``; ``differ`` are the bits that differ."""
    sums, ok = np.zeros(len(differ), np.int64), np.ones(len(differ), bool)
    for length in range(RING):
        shift = (np.uint64(WIDTH) * ((start + np.uint64(length)) % np.uint64(RING))).astype(np.uint64)
        sums += np.bitwise_count((differ >> shift) & np.uint64(0xFFFF))
        ok &= sums <= (length + 1) * budget // RING
    return ok


def within(one: np.ndarray, two: np.ndarray, budget: int) -> np.ndarray:
    """Whether two fingerprints differ in ``budget`` bits or fewer: pairs without a segment whose chains hold go before the full check."""
    differ, ok = one ^ two, np.zeros(len(one), bool)
    for start in range(RING):
        left = np.flatnonzero(~ok)
        ok[left] = chain_holds(np.full(len(left), start, np.uint64), differ[left], budget)
    ok[ok] = np.bitwise_count(differ[ok]) <= budget
    return ok


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's local component, by pointer jumping over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _dense_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints at ``BUDGET`` = 2 bits or fewer, by shared variants."""
    varying = np.bitwise_or.reduce(values ^ values[0])
    masks = [np.uint64(0), *(ONE << np.uint64(i) for i in range(64) if varying >> np.uint64(i) & ONE)]
    if len(values) > VAST:
        return _vast_links(values, masks)
    variants = np.concatenate([values ^ mask for mask in masks])
    rows = np.tile(np.arange(len(values)), len(masks))
    order = np.argsort(variants, kind="stable")
    same = variants[order][1:] == variants[order][:-1]
    return rows[order[1:][same]], rows[order[:-1][same]]


def _vast_links(values: np.ndarray, masks: list[np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """The same links by looking up each row's neighbours, one difference at a time: memory in proportion to the rows alone."""
    order = np.argsort(values)
    ranked, root = values[order], np.arange(len(values))
    for i, mask in enumerate(masks):
        for other in masks[:i]:
            near = ranked ^ (mask ^ other)
            at = np.minimum(np.searchsorted(ranked, near), len(ranked) - 1)
            rows = np.flatnonzero(ranked[at] == near)
            if len(rows):
                a, b = np.concatenate([rows, np.arange(len(root))]), np.concatenate([at[rows], root])
                root = _roots(len(root), a, b)
    return order, order[root]


def bucket_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key, sorted by key: one for each row at most, to the root of its local component."""
    n = len(keys)
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    left, right = [], []
    rows = np.flatnonzero((size > 1) & (size <= DENSE))
    starts = keys >> np.uint64(42)
    for off in range(1, DENSE):
        rows = rows[rows + off < ends[rows]]
        if not len(rows):
            break
        differ = values[rows] ^ values[rows + off]
        ok = chain_holds(starts[rows], differ)
        ok[ok] = np.bitwise_count(differ[ok]) <= BUDGET
        left.append(rows[ok])
        right.append(rows[ok] + off)
    for i in np.flatnonzero(np.diff(bounds) > DENSE):
        a, b = _dense_links(values[bounds[i] : bounds[i + 1]])
        left.append(a + bounds[i])
        right.append(b + bounds[i])
    if not left:
        return values[:0], values[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    root = _roots(n, a, b)
    rows = np.flatnonzero(root != np.arange(n))
    return values[rows], values[root[rows]]


def links(distinct: DataFrame, name: str = "fp") -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct fingerprints at two or fewer bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            keys = ring_keys(values)
            columns = [keys.ravel().view(np.int64), np.repeat(values, keys.shape[1]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of a bucket that may go on
        for batch in batches:
            keys, values = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            if not len(keys):
                continue
            whole = np.searchsorted(keys, keys[-1])
            if held and keys[0] != held[-1][0][-1] or whole:
                held.append((keys[:whole], values[:whole]))
                yield batch_of(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((keys[whole:], values[whole:]))
        if held:
            yield batch_of(*map(np.concatenate, zip(*held, strict=True)))

    def batch_of(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        pairs = bucket_links(keys, values) if len(keys) else (values, values)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], ["a", "b"])

    keys = distinct.select(F.col(name)).mapInArrow(keyed, "key long, fp long")
    sorted_ = keys.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_.mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per document: its id, ``fingerprint`` in hexadecimal and ``component_id``, the smallest id of its component."""
    marked = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words)
    marked = materialize(marked.select("doc_id", "fp"), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = components(links(classes))
    named = classes.join(found, classes.fp == found.node, "left").select(
        classes.fp, "first", F.coalesce("component", classes.fp).alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component. Rows of null id stay."""
    found = near_duplicates(docs, doc_id, text, words)
    spare = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_spare")).distinct()
    return docs.join(spare, F.col(doc_id) == F.col("_spare"), "left_anti")
