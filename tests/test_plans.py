"""Stages together, files and streams."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from driftcloud import fixtures
from driftcloud.operators import evaluation, images, motion, refinement, tracks
from driftcloud.params import COARSE, Params
from driftcloud.plans import experiments
from driftcloud.plans.labelling import Scene
from driftcloud.session import saved
from driftcloud.sources import files
from driftcloud.streaming.labeller import stream_label

SF = "/root/testdata/sf0.001"
P = Params(grid=COARSE, init_sweeps=3, mcc_sweeps=3)


def _points(spark):
    return fixtures.points(spark, SF).where("sweep_idx < 6")


def test_stream_equals_batch(spark, tmp_path):
    points, sweeps = _points(spark), fixtures.sweeps(spark)
    for i in range(6):
        points.where(F.col("sweep_idx") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    stream_label(source, sweeps, P, str(tmp_path / "history"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = ["scene_id", "sweep_idx", "point_idx", "label"]
    batch = Scene(points, sweeps, P).label_geometric().select(*key)
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*key)
    assert batch.count() == streamed.count() > 0
    assert batch.exceptAll(streamed).isEmpty()


def test_sweep_files(spark, tmp_path):
    for folder, first in (("x", 0), ("y", 100)):
        (tmp_path / folder).mkdir()
        np.arange(first, first + 10, dtype=np.float32).tofile(tmp_path / folder / "a.bin")
    sweeps = spark.createDataFrame([(0, 0, "x/a.bin"), (0, 1, "x/missing.bin")], "scene_id long, sweep_idx int, filename string")
    rows = files.read_sweep_files(sweeps, str(tmp_path)).orderBy("point_idx").collect()
    assert [(r.sweep_idx, r.point_idx, r.x, r.y, r.z) for r in rows] == [(0, 0, 0.0, 1.0, 2.0), (0, 1, 5.0, 6.0, 7.0)]


def test_sweep_files_open_only_what_is_asked(spark, tmp_path):
    """Equal names in nested folders; a pipe beside them, which would block whoever opens it; slices; an incomplete row."""
    root = tmp_path / "samples"
    (root / "samples").mkdir(parents=True)
    for at, n, first in ((root / "x.bin", 2, 0), (root / "samples" / "x.bin", 3, 50)):
        np.arange(first, first + 5 * n + 2, dtype=np.float32).tofile(at)
    os.mkfifo(root / "damaged.bin")
    sweeps = spark.createDataFrame([(0, 0, "x.bin"), (1, 4, "samples/x.bin"), (0, 1, "none/x.bin"), (0, 2, None)], "scene_id long, sweep_idx int, filename string")
    for folder in (str(root), f"file://{root}"):
        rows = files.read_sweep_files(sweeps, folder, rows_at_once=2).collect()
        assert sorted((r.scene_id, r.sweep_idx, r.point_idx, r.x) for r in rows) == [(0, 0, 0, 0.0), (0, 0, 1, 5.0), (1, 4, 0, 50.0), (1, 4, 1, 55.0), (1, 4, 2, 60.0)]
    assert "Broadcast" not in files.read_sweep_files(sweeps, str(root))._jdf.queryExecution().executedPlan().toString()


def test_covered_sweeps(spark, tmp_path):
    """A covered sweep without dynamic points is scored, one that the ground truth wasn't made for is not."""
    gt = spark.createDataFrame([(0, 1, 2), (0, 1, 4), (1, 0, 3)], "scene_id long, sweep_idx int, point_idx int")
    sweeps = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "scene_id long, sweep_idx int")
    path = str(tmp_path / "gt")
    files.write_gt_labels(gt, path, 1.0, sweeps=sweeps)
    files.write_gt_labels(gt.where("scene_id = 1"), path, 1.0, sweeps=sweeps.where("scene_id = 1"))
    boundaries = files.read_gt_boundaries(spark, path, 1.0)
    assert sorted((r.scene_id, r.sweep_idx, r.n, r.until) for r in boundaries.collect()) == [(0, 0, 0, 0), (0, 1, 2, 2), (1, 0, 1, 1)]
    labels = spark.createDataFrame([(0, s, p, 0) for s in range(3) for p in range(5)], "scene_id long, sweep_idx int, point_idx int, label int")
    scored = evaluation.confusion(evaluation.match_gt(files.covered(labels, boundaries), files.read_gt_labels(spark, path, 1.0)))
    assert sorted((r.sweep_idx, r.tp, r.fp) for r in scored.collect()) == [(0, 0, 5), (1, 2, 3)]


def test_gt_labels_round_trip(spark, tmp_path):
    gt = spark.createDataFrame([(0, 1, 2), (1, 1, 3)], "scene_id long, sweep_idx int, point_idx int")
    files.write_gt_labels(gt, str(tmp_path / "gt"), 1.0)
    files.write_gt_labels(gt.where("scene_id = 0"), str(tmp_path / "gt"), 1.0)
    assert files.read_gt_labels(spark, str(tmp_path / "gt"), 1.0).count() == 2


def test_halving_keeps_the_best_third(spark):
    rows = [(t, s, t, 9 - t, 0, 0) for t in range(9) for s in range(2)]
    out = experiments.successive_halving(spark.createDataFrame(rows, "trial_id int, scene_id long, tp long, fp long, fn long, tn long")).collect()
    assert sorted(r.trial_id for r in out if r.rung == 0 and r.survives) == [6, 7, 8]
    assert [r.trial_id for r in out if r.rung == 1 and r.survives] == [8]


def test_brackets_and_draws():
    plan = experiments.brackets(81)
    assert [b.trials for b in plan] == [81, 34, 15, 8, 5]
    assert plan[0].budgets == (1, 3, 9, 27, 81) and plan[0].keeps == (27, 9, 3, 1, 1) and plan[-1].budgets == (81,)
    assert experiments.brackets(2) == [experiments.Bracket(1, (2,), (1,))]
    ranges = {"epsilon": (0.5, 2.0), "vote": (3, 4), "name": "abc"}
    trials = experiments.draw_trials(400, ranges, seed=3)
    assert trials == experiments.draw_trials(500, ranges, seed=3)[:400] != experiments.draw_trials(400, ranges, seed=4)
    assert all(0.5 <= t["epsilon"] < 2 for t in trials) and {t["vote"] for t in trials} == {3, 4} and {t["name"] for t in trials} == set("abc")
    assert abs(sum(t["epsilon"] for t in trials) / 400 - 1.25) < 0.1


def test_tolerance_trials_by_hand(spark):
    """Every trial's counts by a plain loop; a point without margins, null margins, equal tolerances, margins on a tolerance."""
    rng = np.random.default_rng(4)
    rows = [(s, w, i, k, None if rng.random() < 0.2 else float(rng.integers(0, 8)) / 4) for s in range(3) for w in range(2) for i in range(12) for k in range(1, 5) if i]
    margins = spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, k int, margin double")
    points = [(s, w, i) for s in range(3) for w in range(2) for i in range(12)]
    gt = [p for p in points if p[2] % 3 == 0]
    key = "scene_id long, sweep_idx int, point_idx int"
    trials = experiments.draw_trials(25, {"epsilon": [0.0, 0.25, 0.6, 1.0, 1.5], "vote": [1, 2, 4, 9]}, seed=1)
    got = experiments.tolerance_trials(margins, spark.createDataFrame(points, key), spark.createDataFrame(gt, key), trials).collect()
    want = {(t["trial_id"], s): [0, 0, 0, 0] for t in trials for s in range(3)}
    for t in trials:
        for p in points:
            votes = sum(r[4] is not None and r[4] > t["epsilon"] for r in rows if r[:3] == p)
            want[t["trial_id"], p[0]][(0 if votes >= t["vote"] else 2) + ((p in gt) == (votes < t["vote"]))] += 1
    want = {k: (a, b, d, c) for k, (a, b, c, d) in want.items()}  # of what is left, ground truth is fn
    assert {(r.trial_id, r.scene_id): (r.tp, r.fp, r.fn, r.tn) for r in got} == want
    assert experiments.tolerance_trials(margins, points=spark.createDataFrame(points, key), gt=spark.createDataFrame(gt, key), trials=[]).isEmpty()


def test_hyperband_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(t * 5, s, *map(int, rng.integers(0, 6, 3)), 1) for t in range(17) for s in range(7)]
    schema = "trial_id int, scene_id long, tp long, fp long, fn long, tn long"
    want = set()
    first = 0
    for b, bracket in enumerate(experiments.brackets(9)):
        left = [5 * t for t in range(first, first + bracket.trials)]
        first += bracket.trials
        for r, (budget, keep) in enumerate(zip(bracket.budgets, bracket.keeps)):
            sums = {t: np.array([x[2:5] for x in rows if x[0] == t and x[1] < budget]).sum(axis=0) for t in left}
            ious = {t: (v[0] / v.sum() if v.sum() else 0.0) for t, v in sums.items()}
            best = sorted(left, key=lambda t: (-ious[t], t))[:keep]
            want |= {(b, r, budget, t, round(float(ious[t]), 9), t in best) for t in left}
            left = best
    for parts in (1, 5):  # the same for every partitioning
        got = experiments.hyperband(spark.createDataFrame(rows, schema).repartition(parts), 9).collect()
        assert {(r.bracket, r.rung, r.budget, r.trial_id, round(r.iou, 9), r.survives) for r in got} == want and len(got) == len(want)
    assert experiments.hyperband(spark.createDataFrame([], schema), 9).isEmpty()


def test_metadata_to_ground_truth(spark, tmp_path):
    """From metadata files through sweeps and annotations to the points in a moving box."""
    tables = {
        "sample": [{"token": f"s{i}", "scene_token": "A", "timestamp": 1_000_000 * i} for i in range(2)],
        "sample_data": [{"token": f"d{i}", "sample_token": f"s{i}", "calibrated_sensor_token": "c", "ego_pose_token": f"e{i}", "filename": f"sweeps/{i}.bin", "timestamp": 1_000_000 * i, "is_key_frame": True, "channel": c} for i in (1, 0) for c in ("LIDAR_TOP", "CAM")],
        "calibrated_sensor": [{"token": "c", "rotation": [1.0, 0.0, 0.0, 0.0], "translation": [0.0, 0.0, 1.0]}],
        "ego_pose": [{"token": f"e{i}", "rotation": [1.0, 0.0, 0.0, 0.0], "translation": [10.0 * i, 0.0, 0.0]} for i in range(2)],
        "sample_annotation": [{"token": f"a{i}", "sample_token": f"s{i}", "instance_token": "car", "translation": [20.0 + 5 * i, 0.0, 0.0], "size": [2.0, 2.0, 4.0], "rotation": [1.0, 0.0, 0.0, 0.0], "category_name": "car"} for i in range(2)],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    read = {name: files.read_metadata(spark, str(tmp_path), name) for name in tables}
    sweeps = files.assemble_sweeps(files.list_sweeps(read["sample_data"], read["sample"]), read["calibrated_sensor"], read["ego_pose"])
    assert [(r.sweep_idx, r.ts_us, r.tx, r.tz, r.filename) for r in sweeps.orderBy("sweep_idx").collect()] == [(0, 0, 0.0, 1.0, "sweeps/0.bin"), (1, 1_000_000, 10.0, 1.0, "sweeps/1.bin")]
    assert files.slice_sweeps(sweeps, 1, 1).count() == files.slice_sweeps(sweeps, 0, 1).count() == 1
    (tmp_path / "sweeps").mkdir()
    for i in range(2):  # in the sensor's frame: one point in the box, one beside it
        np.array([[20.0 - 5 * i, 0, -1, 0, 0], [5, 5, 0, 0, 0]], np.float32).tofile(tmp_path / "sweeps" / f"{i}.bin")
    points = files.read_sweep_files(sweeps, str(tmp_path))
    gpoints = images.to_global(points, sweeps)
    gt = tracks.generate_gt(gpoints, files.assemble_annotations(read["sample_annotation"], read["sample"]), sweeps, P)
    assert sorted((r.sweep_idx, r.point_idx) for r in gt.collect()) == [(0, 0), (1, 0)]
    labels = gpoints.select("scene_id", "sweep_idx", "point_idx", F.lit(0).alias("label"))
    assert files.covered(labels, gt.where("sweep_idx = 1")).count() == 2
    assert [(r.n_sweeps, r.n_points) for r in files.sweep_counts(labels).collect()] == [(2, 4)]


def test_refinement_leaves_sweeps_that_it_cannot_cluster(spark):
    """Too few dynamic points, or one that isn't finite: the labels stay; elsewhere noise goes."""
    near = [(0.1 * i, 0.0, 0.0) for i in range(6)]
    rows = [(0, 0, i, *xyz) for i, xyz in enumerate([*near, (50.0, 0.0, 0.0)])] + [(0, 1, i, *xyz) for i, xyz in enumerate(near[:3])] + [(0, 2, i, *xyz) for i, xyz in enumerate([*near, (float("nan"), 0.0, 0.0), (50.0, 0.0, 0.0)])]
    gpoints = spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double")
    labels = gpoints.select("scene_id", "sweep_idx", "point_idx", F.lit(0).cast("byte").alias("label"))
    for method in ("density", "hdbscan"):
        out = refinement.refine(labels, gpoints, P.with_(refine=method, cluster_epsilon=0.7, cluster_least=5)).collect()
        assert len(out) == len(rows)
        assert {(r.sweep_idx, r.point_idx) for r in out if r.label != 0} <= {(0, k) for k in range(7)}
        assert (0, 6) in {(r.sweep_idx, r.point_idx) for r in out if r.label == 3}
    size = refinement.refine(labels, gpoints, P.with_(refine="density", cluster_epsilon=0.7, cluster_least=5, cluster_size=9)).where("sweep_idx = 0 and label = 3")
    assert size.count() == 7


def test_labels_of_earlier_sweeps_as_static_points(spark):
    """The wave's labels are the ones that one pass gives when it is told them for the sweeps before; ground alone gives others."""
    points, sweeps = fixtures.points(spark, SF).where("sweep_idx < 4 and scene_id = 0"), fixtures.sweeps(spark)
    p = Params(grid=COARSE, init_sweeps=2, history=2, vote=1, mcc_sweeps=2, mcc_include_current=False, mcc_interpolate=False, mcc_threshold=0.4, mcc_h=3 * COARSE.h_res, mcc_v=1.5 * COARSE.v_res, static_source="labels")
    scene = Scene(points, sweeps, p)
    wave = saved(scene.label_points())
    scene.static = saved(motion.static_points(scene.own, wave.where("label in (1, 4)"), p))
    again = saved(scene.after_first_pass(saved(scene.first_pass())))
    key = ["scene_id", "sweep_idx", "point_idx", "label"]
    assert wave.count() == again.count() > 300 and wave.select(key).exceptAll(again.select(key)).isEmpty()
    ground = saved(Scene(points, sweeps, p.with_(static_source="ground")).label_points())
    assert wave.select(key).exceptAll(ground.select(key)).count() > 0


def test_baked_tables_join_without_a_shuffle(spark, tmp_path):
    """Labels meet ground truth bucket by bucket; scenes are pushed down; covered sweeps without ground truth are scored, others not."""
    rows = [(c, s, k, 0 if k < 2 else 1, float(k), float(s), 0.0) for c in (0, 1) for s in range(4) for k in range(6)]
    points = spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, label int, gx double, gy double, gz double")
    gt = spark.createDataFrame([(c, s, k) for c in (0, 1) for s in (0, 2) for k in (0, 3)], "scene_id long, sweep_idx int, point_idx int")
    sweeps = spark.createDataFrame([(c, s) for c in (0, 1) for s in range(3)], "scene_id long, sweep_idx int")
    files.bake_labels(points.select(*files.BAKED_BY, "label"), points.drop("label"), gt, sweeps, "baked", str(tmp_path / "b"), buckets=4)
    labels, truth, made_for = files.read_baked(spark, "baked", [1])
    matched = evaluation.match_gt(labels, truth.hint("merge"))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "EqualTo(scene_id,1)" in plan
    out = evaluation.confusion(matched).collect()
    assert sorted((r.scene_id, r.sweep_idx, r.tp, r.fp, r.fn) for r in out) == [(1, 0, 1, 1, 1), (1, 1, 0, 2, 0), (1, 2, 1, 1, 1)]
    assert files.read_baked(spark, "baked")[0].count() == 36 and made_for.count() == 3
    p = P.with_(refine="density", cluster_epsilon=1.5, cluster_least=2)
    assert refinement.refine(labels.select(*files.BAKED_BY, "label"), labels.drop("label"), p).count() == 18
    for name in ("labels", "gt", "sweeps"):
        spark.sql(f"drop table baked_{name}")


def test_sinks_classes_and_selection(spark, tmp_path):
    trials = spark.createDataFrame([(0, 4, 0.1, 0.5), (1, 5, 0.2, 0.7), (2, 6, 0.3, 0.7)], "trial_id int, `vote.least` int, `vote.epsilon` double, iou double")
    experiments.export_best(trials, str(tmp_path / "best"))
    (best,) = spark.read.json(str(tmp_path / "best")).collect()
    assert (best.trial_id, best.iou, best.vote.least, best.vote.epsilon) == (1, 0.7, 5, 0.2)  # of equal ones the first
    gpoints = spark.createDataFrame([(c, 0, k, float(k), 0.0, 1.0) for c in (0, 1) for k in range(3)], "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double")
    labels = gpoints.selectExpr("scene_id", "sweep_idx", "point_idx", "cast(case point_idx when 0 then 0 when 1 then 4 else 1 end as byte) as label")
    assert {(r.point_idx, r.label_class) for r in evaluation.label_class(labels).collect()} == {(0, "dynamic"), (1, "ground"), (2, "static")}
    files.write_point_labels(labels, gpoints, str(tmp_path / "labels"))
    stored = spark.read.parquet(str(tmp_path / "labels"))
    assert sorted((r.scene_id, r.point_idx, r.label, r.gx) for r in files.select_scenes(stored, [1]).collect()) == [(1, 0, 0, 0.0), (1, 1, 4, 1.0), (1, 2, 1, 2.0)]
    assert files.select_scenes(stored, "all").count() == 6


def test_veto_takes_back_what_the_static_map_speaks_against(spark):
    """Points that a motion test turned dynamic keep their label if they fit the static map; what was dynamic before stays."""
    points, sweeps = fixtures.points(spark, SF).where("sweep_idx < 4 and scene_id = 0"), fixtures.sweeps(spark)
    p = Params(grid=COARSE, init_sweeps=2, history=2, mcc_sweeps=2, mcc_interpolate=False, mcc_threshold=0.4, mcc_h=3 * COARSE.h_res, mcc_v=1.5 * COARSE.v_res)
    scene = Scene(points, sweeps, p)
    before = saved(scene.first_pass())
    turn = lambda labels: labels.withColumn("label", F.when(F.col("point_idx") % 2 == 0, 0).otherwise(F.col("label")).cast("byte"))
    out = {(r.sweep_idx, r.point_idx): r.label for r in scene.event_with_mcc(before, turn, veto=True).collect()}
    old = {(r.sweep_idx, r.point_idx): r.label for r in before.collect()}
    scores = {(r.sweep_idx, r.point_idx): r.score for r in scene.scores(scene.bare).collect()}
    want = {k: (v if k[1] % 2 or v == 0 or scores[k] >= p.mcc_threshold else 0) for k, v in old.items()}
    assert out == want and any(want[k] != 0 for k in want if k[1] % 2 == 0)
