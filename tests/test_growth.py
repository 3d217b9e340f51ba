"""What the queries write and shuffle grows with their points, and places carried along change no result."""

import pytest
from pyspark.sql import functions as F

from driftcloud import fixtures, queries, session
from driftcloud.operators import evaluation, ground, refinement
from driftcloud.params import DYNAMIC, OCCLUDED_BY, UNDETERMINED
from driftcloud.plans import experiments, labelling

SF = "/root/testdata/sf0.001"
KEY = ["scene_id", "sweep_idx", "point_idx"]


def same(a, b):
    assert a.columns == b.columns
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["drop_noise", "evaluate_covered"])
def test_votes_write_a_row_a_point(spark, monkeypatch, name):
    """Not a row for each of a point's past images."""
    rows = []

    def counting(df, by=()):
        out = session.saved(df, by)
        if set(KEY) <= set(df.columns) and "target" not in df.columns:
            rows.append(out.count())
        return out

    for module in (queries, refinement):
        monkeypatch.setattr(module, "saved", counting)
    queries.QUERIES[name](spark, SF).count()
    assert max(rows) <= queries._points(spark, SF).count()


@pytest.mark.parametrize("name", ["drop_noise", "event_parallel_away"])
def test_large_images_are_shuffled_with_the_same_result(spark, monkeypatch, name):
    few = session.saved(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(session, "LOOKUP_ROWS", 0)
    assert same(few, queries.QUERIES[name](spark, SF)) and few.count() > 0


@pytest.mark.parametrize("grow", [refinement.expand_hull, refinement.expand_hull_exact])
def test_hulls_need_no_join_of_all_points(spark, grow):
    """Places of labels and clusters are enough; labels that are null stay, unless a hull holds the point."""
    cube = [(0, 0, i, float(i % 2), float(i // 2 % 2), float(i // 4)) for i in range(8)]
    rows = [*((*c, DYNAMIC, 0) for c in cube), (0, 0, 8, 0.5, 0.5, 0.5, 3, None), (0, 0, 9, 5.0, 5.0, 5.0, None, None), (0, 0, 10, 0.2, 0.3, 0.4, None, None), (0, 0, 11, 6.0, 5.0, 5.0, DYNAMIC, None)]
    every = session.saved(spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double, label byte, cluster int"))
    labels, clusters = every.drop("cluster"), every.where("cluster is not null").drop("label")
    quiet = refinement.drop_noise(labels, clusters)
    want = {i: 0 for i in (*range(9), 10)} | {9: None, 11: 3}
    out = {r.point_idx: r.label for r in grow(quiet, clusters, every.limit(0)).collect()}
    assert out == want
    bare = refinement.drop_noise(labels.select(*KEY, "label"), clusters.select(*KEY, "cluster"))
    assert same(grow(quiet, clusters, every.limit(0)), grow(bare, clusters.select(*KEY, "cluster"), every.drop("label", "cluster")))
    assert quiet.where(F.col("gx").isNull()).isEmpty()


def test_points_are_numbered_in_ranges(spark, monkeypatch):
    """The same numbers as by a window over a whole sweep, rows without keys included; no task sorts a sweep."""
    monkeypatch.setattr(fixtures, "RANGE_ROWS", 10)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.unionByName(rows.limit(30).withColumn("l_orderkey", F.lit(None).cast("long"))).unionByName(rows.limit(7).withColumn("l_suppkey", F.lit(None).cast("long")))
    numbered = fixtures._numbered(rows)
    assert same(numbered, rows.withColumn("_number", F.expr(fixtures._NUMBER).cast("long"))) and numbered.count() == rows.count()
    assert "_range" in next(x for x in numbered._jdf.queryExecution().executedPlan().toString().splitlines() if " Window " in x)
    assert fixtures._numbered(rows.limit(0)).isEmpty()


def test_planes_move_no_places(spark, monkeypatch):
    """Corners are drawn by point numbers and planes go to the points, also where Spark by itself would broadcast nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        points = session.saved(queries._points(spark, SF))
        plans = []
        monkeypatch.setattr(ground, "saved", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), session.saved(df))[1])
        plan = ground.ransac_planes(points, queries.P)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and len(plans) == 4
    assert not any("x#" in line for text in plans for line in text.splitlines() if " Sort [" in line and "k0" not in text)


@pytest.mark.parametrize("name", ["mcc_score", "event_parallel_away", "event_perpendicular"])
def test_only_candidates_are_written(spark, monkeypatch, name):
    """Of the first pass, the points that are asked; of all points their own places alone."""
    written = []

    def counting(df, by=()):
        out = session.saved(df, by)
        if {"point_idx", "gx"} <= set(df.columns):
            written.append(out.count())
        return out

    for module in (queries, labelling):
        monkeypatch.setattr(module, "saved", counting)
    out = queries.QUERIES[name](spark, SF).count()
    assert sum(written) <= (out if name == "mcc_score" else 0)


@pytest.mark.parametrize("label", [DYNAMIC, OCCLUDED_BY, UNDETERMINED])
def test_candidates_are_the_points_of_the_label(spark, label):
    scene = queries._scene(spark, SF, gap=True)
    want = session.saved(scene.with_points(scene.first_pass(), label))
    assert want.count() > 0 and same(scene.candidates(label), want)


def test_trials_are_one_chain(spark, monkeypatch):
    """Four trials write fewer tables than two of them alone, one after the other, and each gives what it gives alone."""
    grid = [(s, s, i, 0.3 * i, 0.01 * (i % 7), 0.0) for s in range(2) for i in range(40)] + [(s, s, 100 + i, 50.0 + 0.9 * i, 0.0, 0.0) for s in range(2) for i in range(6)]
    rows = [(*r, DYNAMIC if r[2] % 5 else UNDETERMINED) for r in grid] + [(2, 0, 0, 0.0, 0.0, 0.0, DYNAMIC), (2, 0, 1, 1.0, 0.0, 0.0, OCCLUDED_BY), (0, -3, 5, 1.0, 0.0, 0.0, DYNAMIC)]
    every = session.saved(spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double, label byte"))
    gt = every.where("point_idx % 3 = 0").select(*KEY)
    p, trials, counted = queries.P.with_(refine="density"), [(0.5, 3), (1.0, 1)], []

    def counting(df, by=()):
        counted.append(df)
        return session.saved(df, by)

    monkeypatch.setattr(refinement, "saved", counting)
    monkeypatch.setattr(experiments, "saved", counting)
    alone = []
    for epsilon, least in trials:
        refined = refinement.refine(every, every, p.with_(cluster_epsilon=epsilon, cluster_least=least))
        alone.append(tuple(evaluation.confusion(evaluation.match_gt(refined, gt), ()).first()))
    few, trials, alone = len(counted), 2 * trials, 2 * alone
    counted.clear()
    out = experiments.sweep_refinement(every, every, gt, p, trials).orderBy("trial_id").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in out] == alone and [(r.trial_id, r.cluster_epsilon, r.cluster_least) for r in out] == [(i, *t) for i, t in enumerate(trials)]
    assert len(set(alone)) > 1 and len(counted) <= few
    assert experiments.sweep_refinement(every, every, gt, p, []).isEmpty()


def test_rows_that_look_few_are_not_broadcast(spark, monkeypatch):
    """Spark's estimates by files of few bytes a row, and of rows before an explode, lie below its threshold here: these joins have a hint."""
    rows = [(0, 1, i, 0.3 * (i % 20), 0.2 * (i // 20), 0.1 * (i % 3), DYNAMIC) for i in range(200)]
    points = session.saved(spark.createDataFrame(rows, "scene_id long, sweep_idx int, point_idx int, gx double, gy double, gz double, label byte"))
    plans = []
    monkeypatch.setattr(refinement, "saved", lambda df, by=(): (plans.append(df._jdf.queryExecution().executedPlan().toString()), session.saved(df, by))[1])
    clusters = session.saved(refinement.cluster_density(points, queries.CLUSTERS))
    refinement.core_distances(points.withColumnsRenamed({"gx": "x", "gy": "y", "gz": "z"}), 4, 0.2)
    joins = [line for text in plans for line in text.splitlines() if "Join " in line]
    assert joins and not any("BroadcastHashJoin" in line and ("cx#" in line or "point_idx#" in line) for line in joins)
    for joined in (evaluation.match_gt(points, session.saved(points.select(*KEY))), refinement.drop_noise(points, clusters)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
