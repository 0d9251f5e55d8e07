"""Centroid clustering: filtering trees against all distances, and rounds against a plain loop."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm.centroids import LARGEST, Tree, clustered


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_tree_assigns_like_all_distances(data):
    n, k, d = data.draw(st.integers(1, 200)), data.draw(st.integers(1, 12)), data.draw(st.integers(1, 5))
    most = data.draw(st.sampled_from([2, 30, 300, LARGEST]))
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    points, centroids = rng.integers(-most, most + 1, (n, d)), rng.integers(-most, most + 1, (k, d))
    if data.draw(st.booleans()):
        points = points[rng.integers(0, max(1, n // 10), n)]
    tree = Tree.of(np.arange(n), points, leaf=data.draw(st.integers(1, 8)))
    assert sorted(tree.ids.tolist()) == list(range(n)) and (tree.points == points[tree.ids]).all()
    assert (tree.sums[0] == points.sum(axis=0)).all()
    tree = Tree.unpacked(tree.packed(), d)
    whole, at, cluster, far = tree.assigned(centroids)
    found = np.full(n, -1)
    found[tree.ids[at]] = cluster
    for node, z in whole:
        mine = tree.ids[tree.first[node] : tree.first[node] + tree.size[node]]
        assert (found[mine] == -1).all() and (tree.sums[node] == points[mine].sum(axis=0)).all()
        found[mine] = z
    exact = ((points[:, None, :].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2).astype(np.int64)
    assert (found == exact.argmin(axis=1)).all()
    assert (far == exact[tree.ids[at], cluster]).all()


def test_far_clusters_are_assigned_whole():
    rng = np.random.default_rng(0)
    centres = rng.integers(-10_000, 10_000, (8, 64))
    points = np.repeat(centres, 200, axis=0) + rng.integers(-9, 10, (1600, 64))
    whole, at, _, _ = Tree.of(np.arange(1600), points).assigned(centres)
    assert len(whole) < 200 and len(at) < 400


def plain(rows, k, rounds, dimensions):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) and abs(256 * x) <= LARGEST for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), z) for z, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for z in range(len(centroids)):
            its = [v for (_, v), m in zip(kept, mine, strict=True) if m == z]
            if its:
                centroids[z] = [sum(c) // len(its) for c in zip(*its, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted((i, z, d, sum(e for _, e, y in found if y == z), total, hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for i, d, z in found)


@pytest.mark.parametrize("k", [5, 500])
def test_plain(spark, k):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 7)]) for i in range(150)]
    rows += [(None, [0.0] * 4), (200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0]), (205, []), (206, [1e300, 0.0, 0.0, 0.0])]
    rows += [(3, rows[3][1]), (3, [9.0, 9.0, 9.0, 9.0]), (300, rows[4][1]), (301, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    found = clustered(df, k=k, rounds=3, dimensions=4, block=40, leaf=4)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, k, 3, 4)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert clustered(df).collect() == [] and clustered(df.where("false")).collect() == []
