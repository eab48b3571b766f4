"""Centroid clustering against a plain double loop, and Orchard's search against all distances."""

import hashlib
import random

import numpy as np
import pytest

from tidewater.llm.centroids import cluster_vectors, nearest, neighbour_lists


def brute(rows, size, k, rounds, salt="3:"):
    kept = [
        (key, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v])
        for key, v in rows
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((far(v, c), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for i in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = [sum(d for d, c in at if c == i) for i in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((key, c, d, inertia[c], sum(inertia), sha[c]) for (key, _), (d, c) in zip(kept, at)), key=repr
    )


def vectors(seed, n, size):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(middles)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot) for i in range(n // 2)] + [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, []), (902, hot[:-1]), (903, [*hot, 0.0]), (904, [None, *hot[1:]])]
    rows += [(905, [float("nan"), *hot[1:]]), (906, [float("inf"), *hot[1:]]), (907, [-float("inf"), *hot[1:]])]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, Cluster string, key int")


@pytest.mark.parametrize("size,k,rounds", [(4, 8, 10), (3, 3, 2), (1, 5, 4)])
def test_matches_brute_force(spark, size, k, rounds):
    rows = vectors(size, 60, size)
    got = cluster_vectors(frame(spark, rows).repartition(3), size=size, clusters=k, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, size, k, rounds)


def test_search_finds_the_nearest_from_every_start():
    r = np.random.default_rng(2)
    for k in (1, 2, 9, 40):
        centroids = r.integers(-6, 6, (k, 3))
        centroids[-1] = centroids[0]
        x = r.integers(-8, 8, (300, 3))
        far = ((x[:, None] - centroids[None]) ** 2).sum(-1)
        for start in range(min(k, 4)):
            at, best = nearest(x, centroids, start, neighbour_lists(centroids))
            assert (best == far.min(1)).all() and (at == far.argmin(1)).all()


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [9.0, 9.0])]
    got = cluster_vectors(frame(spark, rows), size=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 2, 8, 10)
    empty = cluster_vectors(frame(spark, [(1, None), (2, [1.0])]), size=2)
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_the_exact_range_are_refused(spark):
    with pytest.raises(Exception, match="a component is beyond"):
        cluster_vectors(frame(spark, [(1, [3e8, 0.0])]), size=2).collect()
