"""The registered queries: each operator over points derived from lineitem, or tracks derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures, oracles
from .functions.geometry import adaptive_epsilon as adaptive_epsilon_column, norm
from .operators import evaluation, ground, images, motion, refinement, tracks
from .operators.images import PLACE, POINT
from .params import DYNAMIC, OCCLUDED_BY, UNDETERMINED
from .plans import experiments
from .plans.labelling import Scene, label_histogram as histogram
from .session import lookup, saved
from .sources import files

P = oracles.P
VOTES = (1, 2, 3, 4, 5, 6, 7, 8, 9)
EVENTS, WIDE, CLUSTERS = oracles.EVENTS, oracles.WIDE, oracles.CLUSTERS


def _gap(points: DataFrame) -> DataFrame:
    """Scene 1 without sweep 14: the sweep after it has no previous image."""
    return points.where("not (scene_id = 1 and sweep_idx = 14)")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.points(spark, sf_dir)


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sweeps = saved(fixtures.sweeps(spark))
    return saved(images.to_global(images.filter_range(_points(spark, sf_dir), P), sweeps).select(*POINT, *PLACE)), sweeps


def _dilated(gpoints: DataFrame, sweeps: DataFrame) -> DataFrame:
    return lookup(saved(images.depth_image_dilated(images.depth_image(images.own_projection(gpoints, sweeps, P)), P)))


def _scene(spark: SparkSession, sf_dir: str, gap: bool = False) -> Scene:
    points = _points(spark, sf_dir)
    return Scene(_gap(points) if gap else points, fixtures.sweeps(spark), EVENTS)


def filter_range(spark, sf_dir):
    return images.filter_range(_points(spark, sf_dir), P).groupBy("scene_id", "sweep_idx").agg(F.count("*").alias("n_kept"))


def to_global(spark, sf_dir):
    moved = images.to_global(images.filter_range(_points(spark, sf_dir), P), fixtures.sweeps(spark))
    return moved.groupBy("scene_id", "sweep_idx").agg(*[F.round(F.sum(c), 3).alias(c) for c in ("gx", "gy", "gz")])


def project_spherical(spark, sf_dir):
    gpoints, sweeps = _base(spark, sf_dir)
    return images.own_projection(gpoints, sweeps, P).where("in_fov").groupBy("scene_id", "di", "v", "h").agg(F.count("*").alias("n"))


def _image(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    gpoints, sweeps = _base(spark, sf_dir)
    return images.depth_image(images.own_projection(gpoints, sweeps, P)), sweeps


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def depth_image(spark, sf_dir):
    return _rounded(_image(spark, sf_dir)[0], "min_depth", "max_depth")


def depth_image_dilated(spark, sf_dir):
    return _rounded(images.depth_image_dilated(_image(spark, sf_dir)[0], P), "min_depth", "max_depth")


def unproject_pixel(spark, sf_dir):
    image, sweeps = _image(spark, sf_dir)
    return _rounded(images.unproject_pixels(image, sweeps, P).select("scene_id", "di", "v", "h", "gx", "gy", "gz"), "gx", "gy", "gz")


def adaptive_epsilon(spark, sf_dir):
    kept = images.filter_range(_points(spark, sf_dir), P)
    return kept.select(*POINT, F.round(adaptive_epsilon_column(norm(F.col("x"), F.col("y"), F.col("z")), P.mcc_forward, P.mcc_forward_adaptive), 6).alias("eps"))


def occlusion_coarse(spark, sf_dir):
    gpoints, sweeps = _base(spark, sf_dir)
    dilated = _dilated(gpoints, sweeps)
    return images.occlusion_coarse(gpoints, sweeps, P, dilated).groupBy("scene_id", "sweep_idx", "k", "label").agg(F.count("*").alias("n"))


def occlusion_vote(spark, sf_dir):
    gpoints, sweeps = _base(spark, sf_dir)
    dilated = _dilated(gpoints, sweeps)
    voted = images.occlusion_vote(images.occlusion_coarse(gpoints, sweeps, P, dilated), gpoints, P)
    return voted.groupBy("scene_id", "sweep_idx", "label").agg(F.count("*").alias("n"))


def ransac_ground(spark, sf_dir):
    kept = saved(images.filter_range(_points(spark, sf_dir), P))
    planes = ground.ransac_planes(kept, P)
    n = ground.prelabel_ground(kept, planes, P).groupBy("scene_id", "sweep_idx").agg(F.count("*").alias("n_ground"))
    return n.join(planes.select("scene_id", "sweep_idx", "inliers"), ["scene_id", "sweep_idx"])


def mcc_score(spark, sf_dir):
    s = _scene(spark, sf_dir)
    return _rounded(s.scores(saved(s.candidates(DYNAMIC))), "score")


def mcc_interpolate(spark, sf_dir):
    s = _scene(spark, sf_dir)
    candidates = s.candidates(DYNAMIC)
    asked = candidates.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(P.mcc_sweeps - 1)))).withColumn("di", F.col("sweep_idx") - F.col("k")).where("di >= 0")
    seen = images.project(asked, images.ready_images(s.bare, s.sweeps), P).where("in_fov").join(s.image.select("scene_id", "di", "v", "h"), ["scene_id", "di", "v", "h"], "left_anti")
    return _rounded(motion.mcc_interpolate(saved(seen), s.static, WIDE), "surface")


def event_parallel_away(spark, sf_dir):
    s = _scene(spark, sf_dir)
    return motion.event_parallel_away(s.candidates(OCCLUDED_BY), s.sweeps, s.bare, s.image, EVENTS)


def event_perpendicular(spark, sf_dir):
    s = _scene(spark, sf_dir, gap=True)
    return motion.event_perpendicular(s.candidates(UNDETERMINED), s.sweeps, s.bare, s.static, EVENTS)


def label_geometric(spark, sf_dir):
    return _scene(spark, sf_dir).label_geometric()


def label_histogram(spark, sf_dir):
    return histogram(_scene(spark, sf_dir, gap=True).label_geometric())


def _refining(spark, sf_dir) -> Scene:
    points = _points(spark, sf_dir)
    return Scene(points, fixtures.sweeps(spark), EVENTS.with_(refine="density", cluster_epsilon=CLUSTERS.cluster_epsilon, cluster_least=CLUSTERS.cluster_least))


def _scene_gt(spark, s: Scene) -> DataFrame:
    """Ground truth of the points that the scene keeps."""
    return saved(tracks.generate_gt(s.gpoints, fixtures.annotations(spark), s.sweeps, P))


def label_points(spark, sf_dir):
    return _refining(spark, sf_dir).label_points()


def evaluate_labels(spark, sf_dir):
    """The refined labels of each sweep against ground truth."""
    scene = _refining(spark, sf_dir)
    matched = evaluation.match_gt(scene.label_points(), _scene_gt(spark, scene))
    return _rounded(evaluation.with_iou(evaluation.confusion(matched)), "iou")


def sweep_refinement(spark, sf_dir):
    scene = _scene(spark, sf_dir)
    return _rounded(experiments.sweep_refinement(scene.placed_labels(), scene.bare, _scene_gt(spark, scene), EVENTS.with_(refine="density"), oracles.REFINEMENTS), "iou")


def _event_tracks(spark, sf_dir) -> DataFrame:
    """Users as instances that move along their events' values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null and value is not null")
    return events.select(F.expr("user_id % 2").alias("scene_id"), F.col("user_id").alias("instance_id"), F.col("event_id").cast("string").alias("sample_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", F.col("value").cast("double").alias("tx"), (F.col("event_id") % 97).cast("double").alias("ty"), F.lit(0.0).alias("tz"))


def track_velocity(spark, sf_dir):
    one = _event_tracks(spark, sf_dir).groupBy("scene_id", "instance_id", "ts_us").agg(*[F.min_by(c, "event_id").alias(c) for c in ("tx", "ty", "tz")])
    return tracks.track_velocity(one, None).select("scene_id", "instance_id", "ts_us", *[F.round(c, 6).alias(c) for c in ("vx", "vy", "vz")])


def _gt(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    gpoints, sweeps = _base(spark, sf_dir)
    return saved(tracks.generate_gt(gpoints, fixtures.annotations(spark), sweeps, P)), gpoints, sweeps


def boxes_asof(spark, sf_dir):
    """Boxes of all instances with the number of points in each sweep's boxes."""
    gpoints, sweeps = _base(spark, sf_dir)
    boxes = saved(tracks.boxes_asof(fixtures.annotations(spark), sweeps, P))
    n = tracks.points_in_boxes(gpoints, boxes).groupBy("scene_id", "sweep_idx").agg(F.count("*").alias("n_inside"))
    return _rounded(boxes.join(n, ["scene_id", "sweep_idx"], "left"), "tx", "ty", "tz", "vx", "vy", "vz", "qw", "qx", "qy", "qz").drop("w", "l", "h", "category").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))


def generate_gt(spark, sf_dir):
    return _gt(spark, sf_dir)[0]


def gt_offsets(spark, sf_dir):
    gt, _, sweeps = _gt(spark, sf_dir)
    return tracks.gt_offsets(gt, sweeps)


def _coarse(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels of each point and past image, and ground truth."""
    gt, gpoints, sweeps = _gt(spark, sf_dir)
    return saved(images.occlusion_coarse(gpoints, sweeps, P, _dilated(gpoints, sweeps))), gt


def _voted(gpoints: DataFrame, sweeps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A label of each point of a ready sweep, with its columns ``keep``."""
    return images.vote_in_place(images.ready_sweeps(gpoints, P), images.ready_images(gpoints, sweeps), _dilated(gpoints, sweeps), P, keep)


def _matched(spark, sf_dir) -> DataFrame:
    gt, gpoints, sweeps = _gt(spark, sf_dir)
    return evaluation.match_gt(_voted(gpoints, sweeps), gt)


def confusion(spark, sf_dir):
    return _rounded(evaluation.with_iou(evaluation.confusion(_matched(spark, sf_dir))), "iou")


def iou_report(spark, sf_dir):
    return _rounded(evaluation.report(_matched(spark, sf_dir)), "iou")


def error_class(spark, sf_dir):
    return evaluation.error_class(_matched(spark, sf_dir))


def gt_class(spark, sf_dir):
    gt, gpoints, _ = _gt(spark, sf_dir)
    return evaluation.gt_class(_points(spark, sf_dir), gpoints, gt).groupBy("scene_id", "sweep_idx", "gt_class").agg(F.count("*").alias("n"))


def evaluate_covered(spark, sf_dir):
    """Votes of the sweeps that ground truth covers: it was made for the first 18 of scene 0 and all of scene 1, where one has no moving object."""
    gt, gpoints, sweeps = _gt(spark, sf_dir)
    made_for = fixtures.sweeps(spark).where(oracles.COVERED)
    boundaries = saved(tracks.gt_offsets(gt.where(oracles.COVERED).where(oracles.FOUND), made_for))
    matched = evaluation.match_gt(files.covered(_voted(gpoints, sweeps), boundaries), gt.where(oracles.FOUND))
    return _rounded(evaluation.with_iou(evaluation.confusion(matched)), "iou").join(boundaries.select("scene_id", "sweep_idx", F.col("n").alias("n_gt")), ["scene_id", "sweep_idx"])


def sweep_geometric(spark, sf_dir):
    coarse, gt = _coarse(spark, sf_dir)
    return _rounded(experiments.sweep_geometric(coarse, gt, VOTES), "iou")


def sweep_epsilon(spark, sf_dir):
    gt, gpoints, sweeps = _gt(spark, sf_dir)
    dilated = _dilated(gpoints, sweeps)
    margins = images.occlusion_margins(gpoints, sweeps, P, dilated)
    return _rounded(experiments.sweep_epsilon(margins, images.ready_sweeps(gpoints, P), gt, P.vote, oracles.EPSILONS), "iou")


def sweep_mcc(spark, sf_dir):
    s = _scene(spark, sf_dir)
    labels = saved(s.first_pass())
    gt = tracks.generate_gt(s.gpoints, fixtures.annotations(spark), s.sweeps, P)
    return _rounded(experiments.sweep_mcc(labels, s.scores(s.with_points(labels, DYNAMIC)), gt, oracles.THRESHOLDS), "iou")


def best_trial(spark, sf_dir):
    coarse, gt = _coarse(spark, sf_dir)
    return _rounded(experiments.best_trial(experiments.sweep_geometric(coarse, gt, VOTES)), "iou")


def trial_results(spark, sf_dir):
    coarse, gt = _coarse(spark, sf_dir)
    return _rounded(experiments.trial_results(experiments.sweep_geometric(coarse, gt, VOTES)), "iou", "behind")


def successive_halving(spark, sf_dir):
    coarse, gt = _coarse(spark, sf_dir)
    return _rounded(experiments.successive_halving(saved(experiments.scene_trials(coarse, gt, VOTES))), "iou")


def hyperband(spark, sf_dir):
    """Drawn tolerances and votes in brackets; the budget counts sweeps of both scenes at once."""
    gt, gpoints, sweeps = _gt(spark, sf_dir)
    dilated = _dilated(gpoints, sweeps)
    margins = images.occlusion_margins(gpoints, sweeps, P, dilated)
    counts = experiments.tolerance_trials(margins, images.ready_sweeps(gpoints, P), gt, oracles.DRAWN, "sweep_idx")
    return _rounded(experiments.hyperband(saved(counts), oracles.BUDGET, unit="sweep_idx"), "iou")


def _dynamic(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    gpoints, sweeps = _base(spark, sf_dir)
    labels = saved(_voted(gpoints, sweeps, PLACE))
    return labels.where(F.col("label") == DYNAMIC).drop("label"), labels, gpoints


def cluster_density(spark, sf_dir):
    return refinement.cluster_density(_dynamic(spark, sf_dir)[0], CLUSTERS)


def drop_noise(spark, sf_dir):
    dynamic, labels, _ = _dynamic(spark, sf_dir)
    return refinement.drop_noise(labels.select(*POINT, "label"), refinement.cluster_density(dynamic, CLUSTERS))


def expand_hull(spark, sf_dir):
    dynamic, labels, gpoints = _dynamic(spark, sf_dir)
    clusters = saved(dynamic.join(refinement.cluster_density(dynamic, CLUSTERS), POINT))
    return refinement.expand_hull(refinement.drop_noise(labels, clusters), clusters, gpoints)


def expand_hull_exact(spark, sf_dir):
    dynamic, labels, gpoints = _dynamic(spark, sf_dir)
    clusters = saved(dynamic.join(refinement.cluster_density(dynamic, CLUSTERS), POINT))
    return refinement.expand_hull_exact(refinement.drop_noise(labels, clusters), clusters, gpoints)


def cluster_hdbscan(spark, sf_dir):
    return refinement.cluster_hdbscan(_dynamic(spark, sf_dir)[0], CLUSTERS)


QUERIES = {
    f.__name__: f
    for f in (
        filter_range, to_global, project_spherical, depth_image, depth_image_dilated, unproject_pixel, adaptive_epsilon, occlusion_coarse, occlusion_vote,
        ransac_ground, mcc_score, mcc_interpolate, event_parallel_away, event_perpendicular, label_geometric, label_histogram, label_points, evaluate_labels, track_velocity, boxes_asof,
        generate_gt, gt_offsets, confusion, iou_report, error_class, gt_class, evaluate_covered, sweep_geometric, sweep_epsilon, sweep_mcc, best_trial, trial_results, successive_halving, hyperband, sweep_refinement, cluster_density, drop_noise,
        expand_hull, expand_hull_exact, cluster_hdbscan,
    )
}
