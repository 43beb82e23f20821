"""The near-dedup of the pipeline against brute force over the exact similarity of five-word shingles."""

import random

import corpus_pipeline
import pytest
from conftest import SMALL

from driftwatch.llm import neardup


def brute(rows):
    """The smallest id of each row's component."""
    sets = []
    for _, text in rows:
        words = [w.lower() for w in (text or "").split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((doc, low.get(top(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small,hot,bits", [(2, 1 << 13, 28), (2, 2, 28), (64, 2, 64)])
def test_equals_brute_force(frame, monkeypatch, small, hot, bits):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "HOT", hot)
    random.seed(small)
    base = [" ".join(f"w{random.randrange(3000)}" for _ in range(120)) for _ in range(6)]
    rows = [(i, edited(base[i % 6], random.choice([0, 1, 2, 3, 4, 8]))) for i in range(120)]
    rows += [(None, None), (200, ""), (201, " \t"), (202, "One two"), (203, "one  TWO"), (None, base[0]), (204, base[1].upper()), (205, "a " * 300)]
    rows += [(None, edited("x y z " + base[2], 0)), (None, "only here without an id at all")]
    got = neardup.near_duplicates(frame(rows, "doc_id long, text string"), bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def large_rows(draw, groups, phrase):
    """Rows of one large bucket: sets that share its key, each group alike; ``phrase`` keys lie in all of them."""
    np, rows, key = neardup.np, [], 5
    for g in range(groups):
        base = [1 << 40 | g << 12 | i for i in range(draw.randint(6, 60))]
        for member in range(3):
            own = {*base} - {*draw.sample(base, len(base) // 10 * (member % 2))} | {key, *phrase}
            if member == 2:
                own |= {1 << 50 | g << 12 | i for i in range(len(base) // 5)}
            rows.append((g * 3 + member, own))
    return rows


def pairs_in(buckets):
    """What ``cross_pairs`` finds in all buckets."""
    np, out = neardup.np, []
    rows = sorted(buckets)
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(7)]
    keys = np.empty(len(rows), object)
    keys[:] = [np.array(r[7], np.int64) for r in rows]
    for batch in neardup.cross_pairs(*columns, keys, 64):
        out += [tuple(sorted(x)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    return out


def test_split_buckets_give_the_pairs_of_whole_ones(spark, monkeypatch):
    draw = random.Random(4)
    sets = large_rows(draw, 25, (7, 9))
    rows = [(5, c, c, len(own), 0, sorted(own)[: len(own) - -(-4 * len(own) // 5) + 1], len(sets)) for c, own in sets]
    schema = "key long, label long, cls long, n long, fp long, keys array<long>, k long"
    found = {}
    for hot in (1, 1 << 13):
        monkeypatch.setattr(neardup, "HOT", hot)
        split = neardup._split(spark.createDataFrame(rows, schema)).collect()
        buckets = [(r["bucket"], r["label"], r["key"], r["second"], r["cls"], r["n"], r["fp"], r["keys"]) for r in split]
        found[hot] = pairs_in([(b, k, s, label, c, n, f, ks) for b, label, k, s, c, n, f, ks in sorted(buckets)])
        if hot == 1:
            sizes = [sum(x[0] == b for x in buckets) for b in {x[0] for x in buckets}]
            assert len(sizes) > 20
    assert {*found[1]} == {*found[1 << 13]} and len(found[1 << 13]) > 20


def test_a_hot_key_of_many_classes_takes_time_in_proportion(spark, monkeypatch):
    """Classes that share one phrase alone: split by size, twice as many take about twice the time."""
    import time

    monkeypatch.setattr(neardup, "HOT", 64)
    took = []
    for n in (8_000, 32_000):
        draw = random.Random(n)
        rows = [(5, c, c, draw.randint(5, 4 * n // 80), draw.getrandbits(63), [5], n) for c in range(n)]
        split = neardup._split(spark.createDataFrame(rows, "key long, label long, cls long, n long, fp long, keys array<long>, k long"))
        buckets = [(r["bucket"], r["key"], r["second"], r["label"], r["cls"], r["n"], r["fp"], r["keys"]) for r in split.collect()]
        began = time.perf_counter()
        pairs_in(buckets)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 2


def test_prefixes_of_alike_sets_meet():
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 60)
        pool = [random.randrange(1 << 64) for _ in range(2 * n)]
        both, spare = pool[:n], pool[n : n + n // 4]
        one, two = (neardup.np.array(sorted(x), neardup.np.uint64) for x in (both, both + spare))
        common = neardup.np.array(sorted(random.sample(pool, n // 2)), neardup.np.uint64)
        assert {*neardup.prefix(one, common).tolist()} & {*neardup.prefix(two, common).tolist()}


def test_the_stage_drops_edited_copies(spark, frame):
    random.seed(3)
    text = " ".join(f"w{random.randrange(3000)}" for _ in range(200))
    docs = frame([(1, text), (2, edited(text, 4)), (3, edited(text, 150))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, SMALL).collect()} == {1, 3}


def test_nothing_stays_nothing(frame):
    assert neardup.keep_first(frame([], "doc_id long, text string")).count() == 0


def test_alike_sets_share_the_fewest_keys():
    random.seed(2)
    for _ in range(500):
        n = random.randint(1, 90)
        pool = [random.randrange(1 << 64) for _ in range(2 * n)]
        lost, new = random.randint(0, n // 5), random.randint(0, n // 5)
        one, two = ({*pool[:n]}, {*pool[lost : n + new]})
        if 5 * len(one & two) >= 4 * len(one | two):
            none = neardup.np.zeros(0, neardup.np.uint64)
            x, y = ({*neardup.prefix(neardup.np.array(sorted(s), neardup.np.uint64), none).tolist()} for s in (one, two))
            assert len(x & y) >= neardup.fewest(neardup.np.int64(len(one)), neardup.np.int64(len(two)))


def test_classes_are_digests_of_128_bits():
    """They go into arrays and back, also from the middle of a batch; texts of equal words have the same."""
    pa = neardup.pa
    made = [neardup.class_of(neardup.split(x)) for x in ("a b", "A  b", "", None, "a c", "\0")]
    assert {*map(len, made)} == {16} and made[0] == made[1] != made[4] and made[2] == made[3]
    column = pa.array([b"\0" * 16, *made, b"\xff" * 15 + b"\0"], pa.binary())
    for some in (column, column.slice(2, 3), column.slice(7)):
        assert neardup._names(neardup._column(some)).equals(some)
    classes = neardup._column(column)
    assert (classes[1:] != classes[:-1]).tolist() == [a != b for a, b in zip(column[1:].to_pylist(), column[:-1].to_pylist(), strict=True)]
