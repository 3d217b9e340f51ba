"""Operators on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcloud.functions import geometry
from driftcloud.operators import evaluation, images, motion, refinement, tracks
from driftcloud.params import COARSE, Adaptive, Grid, Params

P = Params(grid=COARSE)
POINT = "scene_id long, sweep_idx int, point_idx int"


def test_range_bounds_are_kept(spark):
    rows = [(0, 0, i, float(x), 0.0, 0.0) for i, x in enumerate([2.5, 50, 2.4999, 50.001, 0])]
    points = spark.createDataFrame(rows, f"{POINT}, x double, y double, z double")
    assert sorted(r.point_idx for r in images.filter_range(points, P).collect()) == [0, 1]
    assert images.filter_range(points, P.with_(range_enabled=False)).count() == 5


def test_pose_and_inverse_undo_each_other(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    pose = dict(r00=c, r01=-s, r02=0.0, r10=s, r11=c, r12=0.0, r20=0.0, r21=0.0, r22=1.0, tx=4.0, ty=-2.0, tz=1.0)
    df = spark.createDataFrame([pose | {"x": 1.0, "y": 2.0, "z": 3.0}])
    g = geometry.transformed("", F.col("x"), F.col("y"), F.col("z"))
    inv = F.struct(*[v.alias(k) for k, v in geometry.inverted().items()]).alias("inv")
    back = df.select(*[v.alias(n) for n, v in zip(("a", "b", "c"), g)], inv).select(*geometry.transformed("inv", F.col("a"), F.col("b"), F.col("c"))).first()
    assert np.allclose(back, (1, 2, 3))


def test_projection_edges(spark):
    rows = [(0.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (1.0, 0.0, 5.0), (1.0, 0.0, 0.0)]
    out = geometry.with_projection(spark.createDataFrame(rows, "lx double, ly double, lz double"), COARSE).collect()
    origin, back, high, front = out
    assert not origin.in_fov and origin.v is None
    assert back.in_fov and back.h == COARSE.width - 1  # no wrap at pi
    assert not high.in_fov
    assert front.in_fov and front.h == COARSE.width // 2


@pytest.mark.parametrize("depth,want", [(5.0, 0.1), (15.0, 0.11), (1e6, 0.5)])
def test_adaptive_epsilon(spark, depth, want):
    got = spark.range(1).select(geometry.adaptive_epsilon(F.lit(depth), 0.1, Adaptive())).first()[0]
    assert got == pytest.approx(want)


def test_adaptive_epsilon_off_is_not_clamped(spark):
    assert spark.range(1).select(geometry.adaptive_epsilon(F.lit(1.0), 9.0, Adaptive(enabled=False))).first()[0] == 9.0


def test_grid_size():
    assert (Grid().width, Grid().height) == (900, 33)
    assert (COARSE.width, COARSE.height) == (180, 9)


def test_unknown_occlusion_is_an_error():
    with pytest.raises(ValueError):
        motion.occlusion_detailed("BESIDE", *[None] * 7, P)


BOX = "scene_id long, sweep_idx int, tx double, ty double, tz double, w double, l double, h double, qw double, qx double, qy double, qz double"


def test_box_faces_and_turned_corner(spark):
    turn = math.pi / 8
    box = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 2.0, 4.0, 2.0, 1.0, 0.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.0, 2.0, 4.0, 2.0, math.cos(turn), 0.0, 0.0, math.sin(turn))], BOX)
    pts = [(0, 0, 0, 2.0, 1.0, 1.0), (0, 0, 1, 2.01, 0.0, 0.0), (0, 1, 0, 1.9, -0.9, 0.0), (0, 1, 1, 1.2, 1.2, 0.0)]
    hit = tracks.points_in_boxes(spark.createDataFrame(pts, f"{POINT}, gx double, gy double, gz double"), box)
    assert sorted((r.sweep_idx, r.point_idx) for r in hit.collect()) == [(0, 0), (1, 1)]


def test_extrapolation_limit(spark):
    ann = spark.createDataFrame([(0, 1, "a", 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, "c")], "scene_id long, instance_id long, sample_id string, ts_us long, tx double, ty double, tz double, w double, l double, h double, qw double, qx double, qy double, qz double, category string")
    sweeps = spark.createDataFrame([(0, 0, 750_000, False, "x"), (0, 1, 750_001, False, "x")], "scene_id long, sweep_idx int, ts_us long, is_key_frame boolean, sample_id string")
    assert [r.sweep_idx for r in tracks.boxes_asof(ann, sweeps, P).collect()] == [0]


def test_iou_without_positives(spark):
    labels = spark.createDataFrame([(0, 0, 0, 1)], f"{POINT}, label int")
    out = evaluation.with_iou(evaluation.confusion(evaluation.match_gt(labels, labels.limit(0)))).first()
    assert (out.tp, out.fp, out.fn, out.tn, out.iou) == (0, 0, 0, 1, 0.0)


def test_clusters_noise_and_hull(spark):
    rng = np.random.default_rng(1)
    pts = [(0, 0, i, *map(float, xyz)) for i, xyz in enumerate(np.concatenate([rng.normal(0, 0.2, (30, 3)), rng.normal(10, 0.2, (30, 3)), [[5.0, 5, 5]]]))]
    g = spark.createDataFrame(pts, f"{POINT}, gx double, gy double, gz double")
    for method in (refinement.cluster_density, refinement.cluster_hdbscan):
        found = {r.point_idx: r.cluster for r in method(g, P).collect()}
        # a lone point on the way between two groups is noise by density; in the hierarchy it leaves one of them at its birth
        assert len(set(found.values())) == 2 and (method is refinement.cluster_hdbscan or 60 not in found)
        assert all(found[i] < 30 for i in found if i < 30) and all(found[i] >= 30 for i in found if 30 <= i < 60)
    labels = g.select("scene_id", "sweep_idx", "point_idx", F.when(F.col("point_idx") == 3, 1).otherwise(0).cast("byte").alias("label"))
    clusters = refinement.cluster_density(g.where("point_idx <> 3"), P)
    out = {r.point_idx: r.label for r in refinement.expand_hull(refinement.drop_noise(labels, clusters), clusters, g).collect()}
    assert out[60] == 3 and out[0] == 0


@pytest.mark.parametrize("distance, score", [(20.0, 1.0), (12.0, 0.0)])
def test_static_surface_around_an_empty_pixel_counts(spark, distance, score):
    """A candidate in an empty pixel of the past image, inside a triangle of static points in the pixels around it."""
    p, g = Params(mcc_include_current=False, mcc_sweeps=1), Grid()
    phi, theta = g.phi_min + 455.5 * g.h_res, g.theta_min + 24.5 * g.v_res
    at = lambda dp, dt, d: (d * math.cos(theta + dt) * math.cos(phi + dp), d * math.cos(theta + dt) * math.sin(phi + dp), d * math.sin(theta + dt))
    offsets = [(-0.45, -0.5), (0.45, -0.5), (0.0, 1.0)]
    rows = [(0, 0, i, *at(math.radians(a), math.radians(b), 20.0)) for i, (a, b) in enumerate(offsets)] + [(0, 1, 0, *at(0.0, 0.0, distance))]
    gpoints = spark.createDataFrame(rows, f"{POINT}, gx double, gy double, gz double").withColumn("rng", F.sqrt(F.expr("gx * gx + gy * gy + gz * gz")))
    same = {n: float(n in ("r00", "r11", "r22")) for n in geometry.POSE}
    sweeps = spark.createDataFrame([{"scene_id": 0, "sweep_idx": i} | same for i in range(2)])
    own = images.own_projection(gpoints.drop("rng"), sweeps, p)
    static = motion.static_points(own, gpoints.where("sweep_idx = 0"), p.with_(init_sweeps=1))
    candidates = gpoints.where("sweep_idx = 1")
    assert static.count() == 3
    row = motion.mcc_score(motion.mcc_frames(candidates, gpoints, sweeps, images.depth_image(own), static, p), candidates).first()
    assert (row.checked, row.score) == (1, score)


def test_history_looks_back_and_ahead(spark):
    """k counts sweeps back; negative ones are sweeps to come; images without points are no history."""
    sweeps = spark.createDataFrame([(0, s, *[1.0 if n in ("r00", "r11", "r22") else 0.0 for n in geometry.POSE]) for s in range(4)], f"scene_id long, sweep_idx int, {', '.join(f'{n} double' for n in geometry.POSE)}")
    points = spark.createDataFrame([(0, s, 0, 5.0 + s, 0.0, 0.0) for s in (0, 1, 3)], f"{POINT}, gx double, gy double, gz double")
    ready = images.ready_images(points, sweeps)
    seen = lambda frames, start: sorted((r.sweep_idx, r.k, r.di) for r in images.history_join(points, ready, P, frames, start).collect())
    assert seen(2, 1) == [(1, 1, 0), (3, 2, 1)]
    assert seen(-1, -3) == [(0, -3, 3), (0, -1, 1), (1, -2, 3)]
    assert seen(0, 1) == []
