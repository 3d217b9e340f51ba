"""Density clusters against a whole matrix of distances, and how many rows they take."""

import numpy as np
import pytest

from driftcloud.operators import refinement
from driftcloud.params import Params

SCHEMA = "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double"


def by_matrix(xyz, least, eps):
    """Cluster of each point (its smallest core), -1 for noise."""
    if not len(xyz):
        return np.zeros(0, int)
    d = xyz[:, None] - xyz[None]
    close = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= eps * eps
    core = close.sum(axis=1) >= least
    name = np.where(core, np.arange(len(xyz)), len(xyz))
    links = close & core[:, None] & core[None]
    while True:
        new = np.where(core, np.where(links, name[None], len(xyz)).min(axis=1), len(xyz))
        if (new == name).all():
            break
        name = new
    out = np.where(close & core[None], name[None], len(xyz)).min(axis=1)
    return np.where(out == len(xyz), -1, out)


def cloud(rng, eps):
    """Blobs from sparse to dense, repeated points, a grid with ties, and slanted sheets about a radius apart."""
    parts = [rng.uniform(-8, 8, (rng.integers(0, 40), 3))]
    for _ in range(rng.integers(0, 4)):
        parts.append(rng.normal(rng.uniform(-4, 4, 3), rng.choice([0.05, 0.3, 1.0]), (rng.integers(1, 120), 3)))
    if rng.random() < 0.4:
        parts.append(np.stack(np.meshgrid(*[np.arange(rng.integers(1, 6)) * 0.35] * 3), axis=-1).reshape(-1, 3))
        parts.append(np.repeat(rng.uniform(-5, 5, (2, 3)), rng.integers(1, 9), axis=0))
    if rng.random() < 0.5:
        n, away = 200, eps * rng.uniform(0.9, 1.1) * np.sqrt(1.5)
        u, v = rng.uniform(0, 2, (2, n, 2)).transpose(0, 2, 1).reshape(2, -1)
        sheet = np.stack([u, v, 0.5 * u + 0.5 * v], axis=1)
        sheet[n:, 2] += away
        parts.append(sheet + rng.uniform(-5, 5, 3))
    xyz = np.concatenate(parts)
    return xyz[rng.permutation(len(xyz))]


@pytest.mark.parametrize("few", [refinement.FEW, 1])
def test_clusters_equal_the_matrix(spark, monkeypatch, few):
    """With one comparison allowed, cells are cut until boxes decide alone."""
    monkeypatch.setattr(refinement, "FEW", few)
    rng, eps, least = np.random.default_rng(5), 0.7, 5
    clouds = [cloud(rng, eps) for _ in range(60)]
    rows = [(s % 3, s, int(i), *map(float, xyz)) for s, c in enumerate(clouds) for i, xyz in enumerate(c)]
    rows.append((0, 0, 100_000, float("nan"), 0.0, 0.0))
    out = refinement.cluster_density(spark.createDataFrame(rows, SCHEMA).repartition(6), Params(cluster_epsilon=eps, cluster_least=least)).collect()
    got = {(r.sweep_idx, r.point_idx): r.cluster for r in out}
    want = {(s, int(i)): int(number[i]) for s, c in enumerate(clouds) for number in [by_matrix(c, least, eps)] for i in np.flatnonzero(number >= 0)}
    assert len(out) == len(got) and got == want


def test_pairs_do_not_grow_with_density(spark, monkeypatch):
    """Four times the points in the same place don't write four times the rows; all pairs would be sixteen times as many."""
    rows = []

    def counting(df, by=()):
        out = saved(df, by)
        rows.append(out.count())
        return out

    saved = refinement.saved
    monkeypatch.setattr(refinement, "saved", counting)
    most = []
    for n in (1000, 4000):
        rows.clear()
        xyz = np.random.default_rng(1).uniform(0, 2, (n, 3))
        points = spark.createDataFrame([(0, 0, i, *map(float, v)) for i, v in enumerate(xyz)], SCHEMA)
        out = refinement.cluster_density(points, Params(cluster_epsilon=0.7, cluster_least=5)).collect()
        assert len(out) == n and {r.cluster for r in out} == {0}
        most.append(max(rows))
    assert most[1] < 4 * most[0]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 400 cores with names in any order: the rounds are those of its logarithm, not of its length."""
    written = []

    def counting(df, by=()):
        written.append(1)
        return saved(df, by)

    saved = refinement.saved
    monkeypatch.setattr(refinement, "saved", counting)
    names = [np.arange(400), np.arange(400)[::-1], np.random.default_rng(2).permutation(400)]
    rows = [(0, s, int(i), 0.5 * at, 0.0, 0.0) for s, order in enumerate(names) for at, i in enumerate(order)]
    out = refinement.cluster_density(spark.createDataFrame(rows, SCHEMA), Params(cluster_epsilon=0.7, cluster_least=2)).collect()
    assert len(out) == 1200 and {r.cluster for r in out} == {0} and len(written) < 30
