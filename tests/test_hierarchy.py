"""Clusters of the density hierarchy: joins over cells against a whole matrix of distances."""

import numpy as np
from hypothesis import given, settings, strategies as st

from driftcloud.operators import refinement
from driftcloud.params import Params


def tree_by_matrix(xyz, near):
    """A minimum spanning tree over mutual reachability distances (Prim), shortest edge first."""
    n = len(xyz)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(near, n) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (w[at] < best) & ~inside
        best[closer], via[closer] = w[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), int(via[at]), at))
    return sorted(edges)


def clusters_by_matrix(xyz, least, near, epsilon):
    if len(xyz) < 2:
        return np.full(len(xyz), -1)
    return refinement.tree_clusters(len(xyz), tree_by_matrix(xyz, near), least, epsilon)


def groups_of(number, names=None):
    names = np.arange(len(number)) if names is None else names
    return {frozenset(names[number == k].tolist()) for k in set(number.tolist()) - {-1}}


def cloud(rng):
    parts = [rng.normal(rng.uniform(-30, 30, 3), rng.choice([0.05, 0.3, 2.0]), (rng.integers(1, 40), 3)) for _ in range(rng.integers(0, 5))]
    parts.append(rng.uniform(-40, 40, (rng.integers(0, 12), 3)))
    if rng.random() < 0.4:  # ties: a grid, and repeated points
        parts.append(np.stack(np.meshgrid(*[np.arange(rng.integers(1, 5)) * 0.5] * 3), axis=-1).reshape(-1, 3) + 10)
        parts.append(np.repeat(rng.uniform(-5, 5, (2, 3)), rng.integers(1, 9), axis=0))
    return np.concatenate(parts)


def test_clusters_equal_the_matrix(spark):
    """200 clouds as the sweeps of one table."""
    rng = np.random.default_rng(8)
    clouds = [cloud(rng) for _ in range(200)]
    rows = [(s % 3, s, int(i), *map(float, xyz)) for s, c in enumerate(clouds) for i, xyz in enumerate(c)]
    rows.append((0, 0, 100_000, float("nan"), 0.0, 0.0))
    points = spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double").repartition(6)
    some = 0
    for least, near, epsilon in ((5, 4, 0.7),):
        out = refinement.cluster_hdbscan(points, Params(cluster_size=least, cluster_least=near, cluster_epsilon=epsilon)).collect()
        got = {(r.sweep_idx, r.point_idx): r.cluster for r in out}
        want = {}
        for s, c in enumerate(clouds):
            number = clusters_by_matrix(c, least, near, epsilon)
            for i in np.flatnonzero(number >= 0):
                want[s, int(i)] = int(np.flatnonzero(number == number[i])[0])
        assert len(out) == len(got) and got == want
        some += len(set(want.values()))
    assert some > 20
    assert refinement.cluster_hdbscan(points.limit(0), Params()).count() == 0


def test_dense_points_meet_few_others(spark, monkeypatch):
    """Core distances as by all pairs, of a place four orders denser than the first radius and of lone points; pairs grow with the points alone."""
    rng, pairs = np.random.default_rng(4), []
    own = refinement._within
    monkeypatch.setattr(refinement, "_within", lambda *a: (found := own(*a), pairs.append(found.count()))[0])
    cloud = np.concatenate([rng.uniform(-0.1, 0.1, (2000, 3)), rng.uniform(-20, 20, (60, 3)), np.full((5, 3), 30.0)])
    rows = [(0, 1, i, *map(float, xyz)) for i, xyz in enumerate(cloud)] + [(0, 2, 0, 1.0, 1.0, 1.0), (0, 2, 1, 1.0, 1.0, 3.0)]
    out = refinement.core_distances(spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, x double, y double, z double"), 4, 0.175).collect()
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(axis=2))
    want = {(1, i): c for i, c in enumerate(np.sort(d, axis=1)[:, 3].tolist())} | {(2, 0): 2.0, (2, 1): 2.0}
    assert {(r.sweep_idx, r.point_idx): r.core for r in out} == want and len(out) == len(want)
    assert sum(pairs) < 60 * len(rows)


def test_ties_do_not_depend_on_the_tree():
    rng = np.random.default_rng(3)
    for _ in range(200):
        c = np.unique(rng.integers(0, 7, (rng.integers(2, 60), 3)), axis=0).astype(float)
        turned = rng.permutation(len(c))
        one, other = clusters_by_matrix(c, 4, 3, 0.5), clusters_by_matrix(c[turned], 4, 3, 0.5)
        assert groups_of(one) == groups_of(other, turned)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=30))
def test_tree_spans(values):
    """A spanning tree has an edge for each point but one, and says as much as all edges do."""
    xyz = np.array([[float(v), 0.0, 0.0] for v in values])
    n, tree = len(xyz), tree_by_matrix(xyz, 2)
    assert len(tree) == n - 1
    d = np.abs(xyz[:, None, 0] - xyz[None, :, 0])
    core = np.sort(d, axis=1)[:, min(2, n) - 1]
    every = sorted((float(max(d[i, j], core[i], core[j])), i, j) for i in range(n) for j in range(i))
    by_all, by_tree = (refinement.tree_clusters(n, edges, 3, 1.0) for edges in (every, tree))
    assert groups_of(by_all) == groups_of(by_tree) and all(len(g) >= 3 for g in groups_of(by_all))
