"""SimHash near-dedup at a similarity: five-word shingles and a Jaccard similarity of 0.8 or more.

Fingerprints and pigeonring chains as in ``simhash``, with a wide budget; a shingle's hash is mixed from its words' hashes. At a similarity of 4/5
two fingerprints of 64 bits differ in 10 bits on average and in more than ``BITS`` = 28 about once in 10^8 pairs; they are
taken over the set of shingles, as the similarity is. No equal segments are sure within so many bits, so the keys
under which texts are filed are shingles: with all shingles in one common order, two sets of
the similarity share one among the first ``n - ceil(4 n / 5) + 1`` of each. A pair of one key must have a
chain of segments that keeps its shares of the budget, then pass the full Hamming check, and at last the exact similarity of the whole sets.

The order is by hash, but shingles that are common in a sample of the texts come
last. The sample only sets the order: results are the same with any. Texts of equal words are one
class from the start. Buckets of up to ``SMALL`` classes give all pairs whose
sizes allow the similarity. Larger ones give each class with the bucket's first, and
then, when these are verified and joined to components, all pairs of different components.
Two sets of the similarity share more keys than one: what lies beyond the prefixes can't make up for
too few (``fewest``), so pairs of fewer common keys are left out before they are verified. In a large bucket each row
has with it the class's keys of all large buckets: so a pair is counted at once, and emitted in the first of the buckets that it shares.
A pair that shares small buckets too is known from these.
Large buckets of one component need nothing more. Of the others, those of over ``HOT`` classes are split over tasks before pairs are looked for: a pair needs two
common keys of large buckets, so a class is filed under its pairs of keys, or one is enough (``fewest``), which the sizes of the two sets must just allow, so it is
filed under the size of the smaller set.
No pair that could join two components is left out.

Nulls, empty texts and texts of white space are copies. A null ``doc_id`` links like
any other, but never names a component and is never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.components import components
from driftwatch.llm.simhash import LOWERED, SEED, majority, within
from driftwatch.session import materialize

WORDS = 5
#: Bits in which fingerprints may differ.
BITS = 28
#: Buckets of up to so many classes give all their pairs at once.
SMALL = 64
#: Texts in the sample, the share of them from which on a shingle is common, and the most common shingles that are sent to all tasks.
SAMPLE, COMMON, MOST = 4_000, 1 / 1000, 1 << 16
#: Classes of a large bucket from which on it is split by second keys and sizes.
HOT = 1 << 13
#: Slots by which documents of no candidate pair are left out before a join.
SLOTS = 1 << 20
#: Pairs in a batch, and bytes of rows of buckets that are taken together.
BATCH, HELD = 1 << 16, 4 << 20
#: Odd factors by which the hashes of words become the hash of a shingle.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def split(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased."""
    return (text or "").encode().translate(LOWERED).split()


def class_of(found: list[bytes]) -> bytes:
    """The digest of a text's words, of 128 bits, which copies have in common."""
    return xxhash.xxh3_128_digest(b" ".join(found), SEED)


def shingles(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text's words, each mixed from the words' hashes; fewer words are one shingle."""
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    width = min(words, len(found))
    out = np.zeros(len(found) - width + 1, np.uint64)
    for i in range(width):
        out = out * MIX[0] + hashes[i : i + len(out)]
    for factor in MIX[1:]:
        out = (out ^ (out >> np.uint64(33))) * factor
    return np.unique(out ^ (out >> np.uint64(33)))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first of the hashes, one of which every set of similarity 4/5 or more shares. ``common`` is sorted and comes last."""
    if not len(hashes):
        return hashes
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1]


def _classes(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([class_of(split(x)) for x in texts.to_pylist()], pa.binary())

    return of(text)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _common(docs: DataFrame, words: int) -> np.ndarray:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(split(x), words) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    n = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE / max(n, 1)), seed=SEED)
    least = max(4, round(COMMON * min(n, SAMPLE)))
    counts = sample.mapInArrow(hashed, "h long").groupBy("h").count().where(F.col("count") >= least)
    found = [r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(MOST).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _column(values: pa.Array) -> np.ndarray:
    """A column of numbers, of digests, or of lists of numbers as an array of arrays."""
    if pa.types.is_binary(values.type):
        fixed = values.cast(pa.binary(16))
        return np.frombuffer(fixed.buffers()[1], "V16")[fixed.offset : fixed.offset + len(fixed)]
    if not pa.types.is_list(values.type):
        return values.to_numpy()
    out = np.empty(len(values), object)
    flat, ends = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
    for i in range(len(values)):
        out[i] = flat[ends[i] : ends[i + 1]]
    return out


def _names(classes: np.ndarray) -> pa.Array:
    """Digests as Arrow has them; numbers stay numbers."""
    if classes.dtype.kind != "V":
        return pa.array(classes)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(classes), [None, pa.py_buffer(classes.tobytes())]).cast(pa.binary())


def _buckets(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """``of`` over the columns of whole buckets, many at once. Rows are sorted by the first column."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, HELD
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            rows = pa.concat_batches(held)
            key = rows.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if whole:
                yield from of(*map(_column, rows.slice(0, whole).columns))
            held = [rows.slice(whole)]
            size = held[0].nbytes
            limit = max(HELD, 2 * size)
    if held and (rows := pa.concat_batches(held)).num_rows:
        yield from of(*map(_column, rows.columns))


def _batch(key: np.ndarray, a: np.ndarray, b: np.ndarray | None, n: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    one = _names(a)
    other = pa.nulls(len(a), one.type) if b is None else _names(b)
    return pa.RecordBatch.from_arrays([pa.array(key), one, other, pa.array(n), pa.array(fp)], ["key", "a", "b", "n", "fp"])


def _paired(key: np.ndarray, cls: np.ndarray, n: np.ndarray, fp: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
    return _batch(key[a], cls[a], cls[b], fewest(n[a], n[b]), fp[a])


def fewest(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least number of keys that the prefixes of two sets of these sizes share if the sets have the similarity.

    Up to the lesser of the last keys both prefixes are whole, and beyond it one of the sets has ``ceil(4 n / 5) - 1`` at most.
    """
    return -(-4 * (n + m) // 9) - np.maximum(-(-4 * n // 5), -(-4 * m // 5)) + 1


def _may_be(n: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether sizes and fingerprints of two rows allow the similarity."""
    ok = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    if bits < 64:
        ok[ok] = within(fp[a[ok]].view(np.uint64), fp[b[ok]].view(np.uint64), bits)
    return ok


def first_pairs(key: np.ndarray, cls: np.ndarray, n: np.ndarray, fp: np.ndarray, bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """All pairs of small buckets; of others each class with the first, and its rows with a null ``b``."""
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size, ends = np.repeat(np.diff(bounds), np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    rows = np.flatnonzero((size > 1) & (size <= SMALL))
    large = np.flatnonzero(size > SMALL)
    firsts = np.repeat(bounds[:-1], np.diff(bounds))[large]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield large, firsts
        left = rows
        for off in range(1, SMALL):
            left = left[left + off < ends[left]]
            if not len(left):
                return
            yield left, left + off

    one: list[np.ndarray] = []
    two: list[np.ndarray] = []
    for a, b in pairs():
        a, b = a[cls[a] != cls[b]], b[cls[a] != cls[b]]
        ok = _may_be(n, fp, a, b, bits)
        one.append(a[ok])
        two.append(b[ok])
        if sum(map(len, one)) >= BATCH:
            yield _paired(key, cls, n, fp, one, two)
            one, two = [], []
    yield _paired(key, cls, n, fp, one, two)
    yield _batch(key[large], cls[large], None, n[large], fp[large])


def cross_pairs(
    bucket: np.ndarray, key: np.ndarray, second: np.ndarray, label: np.ndarray, cls: np.ndarray, n: np.ndarray, fp: np.ndarray, keys: list[np.ndarray], bits: int = BITS
) -> Iterator[pa.RecordBatch]:
    """The pairs of different labels in each bucket whose sizes, fingerprints and numbers of common large buckets allow the similarity.

    Rows are sorted by bucket and label, the ``keys`` of each in ascending order. A pair comes in the bucket of the smallest ``key`` that it shares, and
    of the next one as ``second`` where that isn't the same.
    """
    new = np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])
    bounds = np.flatnonzero(new)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    groups = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (label[1:] != label[:-1]), [True]]))
    others = np.repeat(groups[1:], np.diff(groups))  # where the next label begins
    flat, size = np.concatenate([np.zeros(0, np.int64), *keys]), np.array([len(x) for x in keys], np.int64)
    start = np.cumsum(size) - size
    values, ids = np.unique(flat, return_inverse=True)
    mine, then, mark = np.searchsorted(values, key), np.searchsorted(values, second), np.zeros(len(values), bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held, last = 0, len(bucket) - 1
    for row in [*np.flatnonzero(others < ends).tolist(), last]:
        near = np.arange(others[row], ends[row])
        near = near[5 * np.minimum(n[row], n[near]) >= 4 * np.maximum(n[row], n[near])]
        if bits < 64:
            near = near[within(np.full(len(near), fp[row]).view(np.uint64), fp[near].view(np.uint64), bits)]
        if len(near):
            mark[ids[start[row] : start[row] + size[row]]] = True
            first = np.cumsum(size[near]) - size[near]
            at = np.repeat(start[near] - first, size[near]) + np.arange(size[near].sum())
            shared = mark[ids[at]]
            ok = np.add.reduceat(shared, first, dtype=np.int64) >= fewest(n[row], n[near])
            ok &= ~np.logical_or.reduceat(shared & (ids[at] < then[row]) & (ids[at] != mine[row]), first)
            mark[ids[start[row] : start[row] + size[row]]] = False
            near = near[ok]
            left.append(np.full(len(near), row))
            right.append(near)
            held += len(near)
        if held >= BATCH or row == last and held:
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([_names(cls[a]), _names(cls[b])], ["a", "b"])
            left, right, held = [], [], 0


def _split(rows: DataFrame) -> DataFrame:
    """Rows ``(key, label, cls, n, fp, keys, k)`` of large buckets with the ``bucket`` in which their pairs are looked for: their own, or for one of over ``HOT`` classes several smaller ones.

    With n and m the sizes of the larger and the smaller set, one common key is enough where ``4 (n + m) / 9`` isn't over ``ceil(4 n / 5)``: up to three m for each n.
    """
    columns = ["bucket", "key", "second", "label", "cls", "n", "fp", "keys"]
    cold = rows.where(F.col("k") <= HOT).select(F.col("key").alias("bucket"), "key", F.col("key").alias("second"), *columns[3:])
    hot = rows.where(F.col("k") > HOT)
    later = F.explode(F.filter("keys", lambda x: x > F.col("key"))).alias("second")
    by_second = hot.select("key", later, *columns[3:]).withColumn("bucket", F.xxhash64("key", "second"))
    least = F.ceil(4 * F.col("n") / 5)
    most = F.least(F.col("n"), F.floor(9 * least / 4) - F.col("n"))
    smaller = F.when(most >= least, F.sequence(least, most)).otherwise(F.array().cast("array<long>"))
    sizes = F.explode(F.array_union(F.array(F.col("n").cast("long")), smaller.cast("array<long>"))).alias("size")
    by_size = hot.select("key", F.col("key").alias("second"), *columns[3:], sizes).withColumn("bucket", F.xxhash64("key", F.lit("size"), "size"))
    return cold.unionByName(by_second.select(*columns)).unionByName(by_size.select(*columns))


def _enough(pairs: DataFrame) -> DataFrame:
    """The distinct pairs that share enough keys; each key gives a pair once, and ``n`` is the number that they need."""
    both = pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return both.where("k >= n").select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs whose whole sets have the similarity."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sets = [], []
            for mine, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if class_of(found := split(text)) == mine:  # the id may have another text too
                    cls.append(mine)
                    sets.append(shingles(found, words))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), _lists(sets)], ["cls", "hashes"])

    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    needed = materialize(needed.join(classes, "cls"), "near-needed")
    slot = F.pmod(F.xxhash64(F.col("first").cast("string")), F.lit(SLOTS)).cast("int")
    marks = np.zeros(SLOTS, bool)
    marks[[r[0] for r in needed.where(F.col("first").isNotNull()).select(slot).distinct().collect()]] = True

    @F.arrow_udf("boolean")
    def may_be(slots: pa.Array) -> pa.Array:
        return pa.array(marks[slots.to_numpy()])

    some = docs.where(may_be(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SLOTS)).cast("int")))
    texts = some.join(needed, F.col("doc_id") == F.col("first")).select("cls", "text")
    nameless = needed.where(F.col("first").isNull()).select("cls")  # only documents of null id have these sets
    texts = texts.unionByName(
        docs.where("doc_id IS NULL").withColumn("_d", _classes(F.col("text"))).join(nameless, F.col("_d") == F.col("cls")).select("cls", "text")
    )
    sets = texts.mapInArrow(whole, "cls binary, hashes array<long>").groupBy("cls").agg(F.first("hashes").alias("hashes"))
    sets = materialize(sets, "near-sets")
    one = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("one"))
    two = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("two"))
    both = F.size(F.array_intersect("one", "two"))
    return pairs.join(one, "a").join(two, "b").where(5 * both >= 4 * (F.size("one") + F.size("two") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id of its component, of every document. With 64 ``bits`` no fingerprint keeps a pair from the exact similarity."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    common = _common(docs, words)

    @F.arrow_udf("struct<cls:binary,n:long,fp:long,keys:array<long>>")
    def marked(texts: pa.Array) -> pa.Array:
        digests, sizes, prints, keys = [], [], [], []
        for x in texts.to_pylist():
            found = split(x)
            hashes = shingles(found, words)
            digests.append(class_of(found))
            sizes.append(len(hashes))
            prints.append(majority(hashes))
            keys.append(prefix(hashes, common))
        prints = pa.array(np.array(prints, np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), prints, _lists(keys)], ["cls", "n", "fp", "keys"])

    # read twice: to write the prefixes beside the ids would take more disk than time
    marks = materialize(docs.select("doc_id", _classes(F.col("text")).alias("cls")), "near-marks")
    classes = materialize(marks.groupBy("cls").agg(F.min("doc_id").alias("first")), "near-classes")
    sets = docs.select(marked("text").alias("m")).groupBy("m.cls").agg(*[F.first(f"m.{x}").alias(x) for x in ("n", "fp", "keys")])
    keys = sets.select(F.explode("keys").alias("key"), "cls", "n", "fp").repartition("key").sortWithinPartitions("key", "cls")
    found = materialize(keys.mapInArrow(lambda rows: _buckets(rows, lambda *x: first_pairs(*x, bits)), "key long, a binary, b binary, n long, fp long"), "near-buckets")
    # a class that shares large buckets has more common keys than its pairs here say: what is left out for that comes again below
    pairs = materialize(_enough(found.where("b IS NOT NULL")), "near-pairs")
    links = materialize(_verified(pairs, classes, docs, words), "near-links")
    joined = components(links)
    large = found.where("b IS NULL")
    if not large.isEmpty():
        lists = materialize(large.groupBy(F.col("a").alias("cls")).agg(F.array_sort(F.collect_list("key")).alias("keys")), "near-large")  # of a prefix at most
        label = F.coalesce("component", "a").alias("label")
        rows = large.join(joined, large.a == joined.node, "left").select("key", label, F.col("a").alias("cls"), "n", "fp")
        mixed = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("key", "k")
        rows = _split(rows.join(mixed, "key").join(lists, "cls").select("key", "label", "cls", "n", "fp", "keys", "k"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "label", "cls")
        more = rows.mapInArrow(lambda batches: _buckets(batches, lambda *x: cross_pairs(*x, bits)), "a binary, b binary")
        sized = large.groupBy("key").agg(F.lit(True).alias("large"))
        small = found.where("b IS NOT NULL").join(sized, "key", "left_anti")
        small = small.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k < n")
        one, two = (lists.select(F.col("cls").alias(c), F.col("keys").alias(f"{c}_keys")) for c in "ab")
        known = small.join(one, "a").join(two, "b").where(F.col("k") + F.size(F.array_intersect("a_keys", "b_keys")) >= F.col("n")).select("a", "b")
        more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(known).distinct()
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
        links = materialize(links.unionByName(_verified(more, classes, docs, words)), "near-links")
        joined = components(links)
    of_class = classes.join(joined, classes.cls == joined.node, "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    return marks.select("doc_id", "cls").join(of_class.join(smallest, "component").select("cls", "component_id"), "cls").select("doc_id", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component. Rows of null id stay."""
    found = near_duplicates(docs, doc_id, text, words, bits)
    spare = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_spare")).distinct()
    return docs.join(spare, F.col(doc_id) == F.col("_spare"), "left_anti")
