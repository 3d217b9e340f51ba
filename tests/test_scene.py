"""What of a scene's tables is moved between stages."""

from pyspark.sql import functions as F

from driftcloud import fixtures
from driftcloud.params import COARSE, DYNAMIC, GROUND, OCCLUDED_BY, Params
from driftcloud.plans.labelling import Scene, ground_prelabeller
from driftcloud.session import saved

SF = "/root/testdata/sf0.001"
P = Params(grid=COARSE, init_sweeps=3, mcc_sweeps=3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_label_are_not_joined_again(spark):
    """Labels have the places of their points; ground points and the other ones are told apart without a shuffle."""
    scene = Scene(fixtures.points(spark, SF).where("sweep_idx < 6"), fixtures.sweeps(spark), P)
    assert "hashpartitioning" not in _plan(scene.marked) and "SortMergeJoin" not in _plan(scene.marked)
    first = saved(scene.first_pass())
    assert "Join" not in _plan(scene.with_points(first, DYNAMIC))
    for label in (DYNAMIC, OCCLUDED_BY, GROUND):
        with_places, joined = scene.with_points(first, label), scene.with_points(first.select("scene_id", "sweep_idx", "point_idx", "label"), label)
        assert with_places.columns == joined.columns and with_places.count() == joined.count() and with_places.exceptAll(joined).isEmpty()
    old = first.where(F.col("label") == OCCLUDED_BY)
    changed = scene.relabelled(first, old.where("point_idx % 2 = 0"), OCCLUDED_BY, DYNAMIC)
    want = first.withColumn("label", F.when((F.col("label") == OCCLUDED_BY) & (F.col("point_idx") % 2 == 0), DYNAMIC).otherwise(F.col("label")).cast("byte"))
    assert changed.count() == want.count() > old.count() > 0 and changed.exceptAll(want).isEmpty()


def test_prelabellers_that_are_given_do_the_same(spark):
    """Ground by broadcast planes is the ground of the prelabeller, with every later label; a sweep without a plane has none."""
    points = fixtures.points(spark, SF).where("sweep_idx < 6").where("sweep_idx <> 4 or z > 0")
    scenes = [Scene(points, fixtures.sweeps(spark), P, given) for given in (None, [ground_prelabeller, ground_prelabeller])]
    one, other = (saved(s.ground) for s in scenes)
    assert one.count() == other.count() > 0 and one.exceptAll(other).isEmpty() and one.where("sweep_idx = 4").isEmpty()
    one, other = (saved(s.label_geometric()) for s in scenes)
    assert one.columns == other.columns and one.count() == other.count() > 0 and one.exceptAll(other).isEmpty()
