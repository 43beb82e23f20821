"""Centroid clustering against direct distances, and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from driftwatch.llm import centroids as C


def plainly(rows, k, rounds, dims):
    """The contract's rounds with a full distance for each vector and centroid."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [[] for _ in now]
        for _, v in kept:
            own[near(v)[1]].append(v)
        now = [[sum(x) // len(x) for x in zip(*vs)] if vs else c for vs, c in zip(own, now)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str) if now else [], now


@pytest.mark.parametrize("block,chunk", [(1, 1 << 15), (2, 50), (3, 7), (8, 1 << 15)])
def test_equals_direct_distances(frame, monkeypatch, block, chunk):
    monkeypatch.setattr(C.encode, "__defaults__", (chunk,))
    draw = random.Random(block)
    rows = [(i, [draw.choice([-0.5, -0.25, 0.0, 0.013, 0.37]) * draw.choice([1, 1, -3]) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]  # a hot vector
    found, now = C.cluster(frame(rows, "vec_id long, embedding array<double>"), dims=8, k=9, rounds=3, block=block)
    want, points = plainly(rows, 9, 3, 8)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and now.points.tolist() == points


def test_nulls_bad_vectors_repeats_and_clashing_columns(frame):
    rows = [(1, [0.5, 0.5], 7), (1, [0.1, 0.2], 8), (None, [0.4, 0.4], 9), (2, None, 1), (3, [0.1], 1), (4, [0.1, None], 1), (5, [float("nan"), 0.1], 1), (6, [float("inf"), 0.1], 1), (7, [1e300, 0.0], 1)]
    found, now = C.cluster(frame(rows, "vec_id long, embedding array<double>, cluster int"), dims=2, k=5, rounds=2)
    want, points = plainly([r[:2] for r in rows[:-1]], 5, 2, 2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and now.points.tolist() == points
    full = {r["id"]: r for r in C.with_inertia(found, now).collect()}
    assert full[None]["inertia"] == sum(w[2] for w in want) and len(full[1]["centroid_sha256"]) == 64


def test_no_vectors(frame, spark):
    for rows in ([], [(1, None)]):
        found, now = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=2)
        assert C.with_inertia(found, now).collect() == []


def test_dictionaries_are_lossless():
    x = np.random.default_rng(3).integers(-5, 5, (500, 3))
    entries, code = C.coded(x)
    assert (entries[code] == x).all() and len(entries) == len(np.unique(x, axis=0))
