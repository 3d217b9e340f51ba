"""Ground plane per sweep by random sampling of triplets, with ranks from plain integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import Params
from ..session import lookup, saved

SWEEP = ["scene_id", "sweep_idx"]


def ground_disk(points: DataFrame, p: Params) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.where((x * x + y * y <= p.ground_radius**2) & z.between(p.ground_z_min, p.ground_z_max))


def sample_rank(trial: Column, corner: int, n: Column) -> Column:
    """Which of the n disk points is a trial's corner: an integer mix that any SQL engine repeats."""
    return (F.col("scene_id") * 7919 + F.col("sweep_idx") * 104729 + trial * 1299709 + F.lit(corner * 15485863) + 12345) % 2147483647 % n


def ransac_planes(points: DataFrame, p: Params) -> DataFrame:
    """The plane of most inliers per sweep (ties: the first trial): nx, ny, nz (upwards), d, inliers.

    Points are ranked by their numbers alone; of their places only the corners' are looked up, and planes go to where the points are.
    """
    disk = ground_disk(points, p).select(*SWEEP, "point_idx", "x", "y", "z")
    trials = saved(disk.groupBy(*SWEEP).agg(F.count("*").alias("n")).where("n >= 3").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(p.ground_trials - 1)))).withColumns({f"k{j}": sample_rank(F.col("trial"), j, F.col("n")) for j in range(3)}))
    drawn = trials.select(*SWEEP, F.explode(F.array("k0", "k1", "k2")).alias("rank")).groupBy(*SWEEP).agg(F.collect_set("rank").alias("ranks"))
    ranked = disk.select(*SWEEP, "point_idx").withColumn("rank", F.row_number().over(Window.partitionBy(*SWEEP).orderBy("point_idx")).cast("long") - 1)
    picked = lookup(saved(ranked.join(drawn, SWEEP).where(F.array_contains("ranks", F.col("rank"))).select(*SWEEP, "point_idx", "rank")))
    corners = saved(disk.join(picked, [*SWEEP, "point_idx"]))
    for j in range(3):
        trials = trials.join(corners.select(*SWEEP, F.col("rank").alias(f"k{j}"), F.struct("x", "y", "z").alias(f"c{j}")), [*SWEEP, f"k{j}"])
    a = [F.col(f"c1.{c}") - F.col(f"c0.{c}") for c in "xyz"]
    b = [F.col(f"c2.{c}") - F.col(f"c0.{c}") for c in "xyz"]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    planes = trials.select(*SWEEP, "trial", "c0", *[c.alias(f"m{i}") for i, c in enumerate(cross)]).withColumn("size", F.expr("sqrt(m0 * m0 + m1 * m1 + m2 * m2)")).where("size > 1e-6")
    planes = planes.select(*SWEEP, "trial", "c0", *[(F.col(f"m{i}") / F.col("size") * F.when(F.col("m2") < 0, -1.0).otherwise(1.0)).alias(n) for i, n in enumerate(("nx", "ny", "nz"))])
    planes = planes.select(*SWEEP, "trial", "nx", "ny", "nz", (-(F.col("nx") * F.col("c0.x") + F.col("ny") * F.col("c0.y") + F.col("nz") * F.col("c0.z"))).alias("d"))
    inliers = disk.join(lookup(saved(planes)), SWEEP).groupBy(*SWEEP, "trial").agg(F.count_if(F.abs(distance()) <= p.ground_inlier).alias("inliers"), *[F.first(c).alias(c) for c in ("nx", "ny", "nz", "d")])
    return inliers.groupBy(*SWEEP).agg(F.max_by(F.struct("nx", "ny", "nz", "d", "inliers"), F.struct("inliers", -F.col("trial"))).alias("best")).select(*SWEEP, "best.*")


def distance() -> Column:
    return F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")


def mark_ground(points: DataFrame, planes: DataFrame, p: Params) -> DataFrame:
    """Points with is_ground; planes are a row a sweep, so nothing but these moves."""
    normal = planes.select(*SWEEP, "nx", "ny", "nz", "d")
    return points.join(F.broadcast(normal), SWEEP, "left").select(*points.columns, F.coalesce(F.abs(distance()) <= p.ground_distance, F.lit(False)).alias("is_ground"))


def prelabel_ground(points: DataFrame, planes: DataFrame, p: Params) -> DataFrame:
    """Ground points of each sweep: scene_id, sweep_idx, point_idx."""
    return points.join(planes, SWEEP).where(F.abs(distance()) <= p.ground_distance).select(*SWEEP, "point_idx")
