"""Centroid clustering against a plain loop in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from candlewright.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string, id string"


def plain(rows, k=16, rounds=3):
    """rows: (id, vector); the contract with loops over every centroid."""
    kept = [(i, tuple(math.floor(64 * x) if abs(x) < 2.0 ** 900 else int(x) * 64 for x in v), v) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = {i: hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, *_ in kept}
    seeds = sorted(kept, key=lambda r: (r[0] is None, digest[r[0]], r[2]))[:k]
    centroids = [list(s[1]) for s in seeds]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x, _ in kept]
        for j in range(len(centroids)):
            own = [x for (_, x, _), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(x)) for i, x, _ in kept]
    fits = lambda n: n if n < 1 << 63 else None
    total = sum(d for _, d, _ in found)
    own = {j: sum(d for _, d, a in found if a == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fits(d), fits(own[j]), fits(total), sha[j]) for i, d, j in found), key=repr)


def clusters(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, clustering.clusters_of(df).collect()), key=repr)


def vectors(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(scale=spread, size=64)]) for i in range(n)]


def test_clusters_nulls_ties_and_repeated_rows(spark):
    rows = vectors(400, 1)
    rows += [(i + 1000, rows[7][1]) for i in range(150)]  # many equal vectors
    rows += rows[:30] + [(3, rows[50][1])]  # repeated rows, and an id with another vector
    rows += [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [None] + [0.1] * 63), (2004, [float("nan")] * 64),
             (2005, [float("inf")] * 64)]
    assert clusters(spark, rows) == plain(rows)


def test_whole_numbers_tie_between_centroids(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 1 / 64, -1 / 64])] * 2 + [0.0] * 62) for i in range(120)]
    assert clusters(spark, rows) == plain(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    assert clusters(spark, vectors(5, 4)) == plain(vectors(5, 4))
    assert clusters(spark, vectors(1, 4)) == plain(vectors(1, 4))
    assert clusters(spark, [(1, None)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert clustering.clusters_of(empty).collect() == []


def test_components_beyond_a_long(spark):
    rows = vectors(60, 5)
    rows += [(100 + i, [float(np.float32(x * 10.0 ** (3 * i)))] * 64) for i, x in enumerate([1.1, -2.2, 3.3, 1.7, 2.9, -1.3])]
    assert clusters(spark, rows) == plain(rows)
    doubles = spark.createDataFrame([(1, [1e308] * 64), (2, [-1e308] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, clustering.clusters_of(doubles).collect()))
    assert got == plain([(1, [1e308] * 64), (2, [-1e308] * 64), (3, [0.5] * 64)])


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_the_two_nearest_with_fewer_comparisons(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-200, 200, size=(32, 64))
    x = c[rng.integers(0, 32, size=3000)] + rng.integers(-20, 20, size=(3000, 64))
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    none = np.full(len(x), -1), np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    *state, compared = clustering.shallot(x, clustering.Centroids(c), *none)
    order = np.lexsort((np.broadcast_to(np.arange(32), d.shape), d), axis=1)
    assert (state[0] == order[:, 0]).all() and (state[1] == order[:, 1]).all()
    moved = c + rng.integers(-3, 4, size=c.shape)
    d = ((x[:, None] - moved) ** 2).sum(axis=2)
    *again, later = clustering.shallot(x, clustering.Centroids(moved, c), *state)
    assert (again[0] == d.argmin(axis=1)).all()
    assert compared < d.size and later < len(x)
    best = np.sqrt(np.sort(d, axis=1))
    assert (again[2] >= best[:, 0] * (1 - 1e-9)).all() and (again[3] <= best[:, 1] * (1 + 1e-9)).all()


def test_rounds_leave_one_block_table_and_exchange_no_vectors(spark):
    df = spark.createDataFrame(vectors(300, 6), "vec_id long, embedding array<float>")
    plan = clustering._assigned(clustering._blocks(clustering.usable(df)), clustering.Centroids(np.zeros((2, 64), dtype=np.int64)))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
