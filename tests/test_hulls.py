"""Exact hulls against all planes through three points, and growth of clusters to them."""

from itertools import combinations

import numpy as np
import pytest

from driftcloud.operators import refinement
from driftcloud.params import Params

SCHEMA = "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double"


def planes_by_triples(p):
    out = []
    for a, b, c in combinations(p, 3):
        n = np.cross(b - a, c - a)
        if (size := np.sqrt(n @ n)) > 1e-6:  # of three points in a line the plane is noise
            s = p @ (n / size) - a @ n / size
            if s.max() <= 1e-9 and s.min() < -1e-9:
                out.append((*n / size, a @ n / size))
            if s.min() >= -1e-9 and s.max() > 1e-9:
                out.append((*-n / size, -(a @ n) / size))
    return np.array(out).reshape(-1, 4)


def within(planes, q, slack=1e-9):
    return (q @ planes[:, :3].T - planes[:, 3] <= slack).all(axis=1) if len(planes) else np.zeros(len(q), bool)


@pytest.mark.parametrize("seed", range(12))
def test_planes_equal_those_of_all_triples(seed):
    rng = np.random.default_rng(seed)
    for p in (rng.normal(size=(rng.integers(4, 22), 3)), rng.integers(0, 3, (15, 3)).astype(float), np.column_stack([rng.normal(size=(9, 2)), np.zeros(9)]), np.repeat(rng.normal(size=(2, 3)), 3, axis=0), rng.normal(size=(12, 3)) * [10, 1, 0.01]):
        q = np.concatenate([p, rng.uniform(p.min(axis=0) - 0.1, p.max(axis=0) + 0.1, (300, 3))])
        want = planes_by_triples(p)
        got = refinement.hull_planes(p)
        assert (len(got) > 0) == (len(want) > 0)
        assert (within(got, q, 1e-8) == within(want, q, 1e-8)).all()


def test_clusters_grow_to_their_hulls(spark):
    rng = np.random.default_rng(4)
    rows, clusters, want = [], [], set()
    for sweep in range(6):
        groups = [rng.normal(size=(n, 3)) * s + c for n, s, c in ((60, 1.0, 0.0), (4, 6.0, 15.0), (3, 1.0, -20.0), (8, [1, 1, 0], 30.0))]
        rest = rng.uniform(-6, 20, (400, 3))
        p = np.concatenate([*groups, rest])
        rows += [(0, sweep, i, *map(float, x)) for i, x in enumerate(p)]
        at = 0
        for g in groups:
            clusters += [(0, sweep, at + k, at) for k in range(len(g))]
            if len(g) >= 4:
                want |= {(sweep, int(i)) for i in np.flatnonzero(within(planes_by_triples(g), p))}
            at += len(g)
    gpoints = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = gpoints.selectExpr("scene_id", "sweep_idx", "point_idx", "cast(3 as byte) as label")
    of = spark.createDataFrame(clusters, "scene_id long, sweep_idx int, point_idx int, cluster int")
    out = refinement.expand_hull_exact(labels, of, gpoints).collect()
    assert len(out) == len(rows) and {(r.sweep_idx, r.point_idx) for r in out if r.label == 0} == want
    outer = {(r.sweep_idx, r.point_idx) for r in refinement.expand_hull(labels, of, gpoints).collect() if r.label == 0}
    assert want < outer  # the polytope of few directions holds more
    assert refinement.expand_hull_exact(labels.limit(0), of.limit(0), gpoints.limit(0)).count() == 0
    near = gpoints.where("sweep_idx = 0 and point_idx < 60")
    dynamic = near.selectExpr("scene_id", "sweep_idx", "point_idx", "cast(0 as byte) as label")
    for hull in ("outer", "exact"):
        assert refinement.refine(dynamic, near, Params(refine="density", hull=hull, cluster_epsilon=2.0)).count() == 60
