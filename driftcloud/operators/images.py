"""Range filter, global coordinates, spherical depth images and the coarse occlusion pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import POSE, fenced, inverted, norm, transformed, unprojected, with_projection
from ..params import DYNAMIC, EMPTY, OCCLUDED_BY, UNDETERMINED, Params

POINT, IMAGE = ["scene_id", "sweep_idx", "point_idx"], ["scene_id", "di"]
PLACE = ("gx", "gy", "gz")


def filter_range(points: DataFrame, p: Params) -> DataFrame:
    """Points within the range, bounds included; all points where the filter is off."""
    if not p.range_enabled:
        return points
    return points.where(norm(F.col("x"), F.col("y"), F.col("z")).between(p.min_range, p.max_range))


def to_global(points: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Adds gx, gy, gz by each sweep's pose."""
    gx, gy, gz = transformed("", F.col("x"), F.col("y"), F.col("z"))
    posed = points.join(sweeps.select("scene_id", "sweep_idx", *POSE), ["scene_id", "sweep_idx"])
    return posed.select(*points.columns, gx.alias("gx"), gy.alias("gy"), gz.alias("gz"))


def inverse_poses(sweeps: DataFrame) -> DataFrame:
    """One row per image: scene_id, di and the pose that takes global points into it."""
    return sweeps.select("scene_id", F.col("sweep_idx").alias("di"), F.struct(*[c.alias(n) for n, c in inverted().items()]).alias("inv"))


def ready_images(gpoints: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Inverse poses of the images that have a kept point."""
    present = gpoints.select("scene_id", F.col("sweep_idx").alias("di")).distinct()
    return inverse_poses(sweeps).join(present, IMAGE, "left_semi")


def project(df: DataFrame, images: DataFrame, p: Params) -> DataFrame:
    """Rows with gx, gy, gz and an image (scene_id, di): adds depth, phi, theta, in_fov, v, h."""
    lx, ly, lz = transformed("inv", F.col("gx"), F.col("gy"), F.col("gz"))
    local = fenced(df.join(images, IMAGE), {"lx": lx, "ly": ly, "lz": lz}).drop("inv")
    return with_projection(local, p.grid).drop("lx", "ly", "lz")


def own_projection(gpoints: DataFrame, sweeps: DataFrame, p: Params) -> DataFrame:
    """Every kept point in its own sweep's image."""
    return project(gpoints.withColumn("di", F.col("sweep_idx")), inverse_poses(sweeps), p)


def depth_image(proj: DataFrame) -> DataFrame:
    """Least and greatest depth and number of points per pixel; an absent pixel is empty."""
    return proj.where("in_fov").groupBy("scene_id", "di", "v", "h").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.count("*").alias("n"))


def _window(p: Params) -> list[tuple[int, int]]:
    return [(dv, dh) for dv in range(-p.window_v, p.window_v + 1) for dh in range(-p.window_h, p.window_h + 1)]


def spread(image: DataFrame, p: Params) -> DataFrame:
    """Each occupied pixel at all pixels whose window has it: v, h of these, pv, ph and the place in the window.

    A window over the rim of an image has its edge pixels more than once; the first place counts.
    """
    g = p.grid
    offsets = F.array(*[F.struct(F.lit(-dv).alias("dv"), F.lit(-dh).alias("dh"), F.lit(k).alias("place")) for k, (dv, dh) in enumerate(_window(p))])
    out = image.withColumnsRenamed({"v": "pv", "h": "ph"}).withColumn("o", F.explode(offsets))
    out = out.withColumns({"v": F.col("pv") + F.col("o.dv"), "h": F.col("ph") + F.col("o.dh"), "place": F.col("o.place")}).drop("o")
    return out.where(F.col("v").between(0, g.height - 1) & F.col("h").between(0, g.width - 1))


def depth_image_dilated(image: DataFrame, p: Params) -> DataFrame:
    """Least and greatest depth over each pixel's window."""
    return spread(image, p).groupBy("scene_id", "di", "v", "h").agg(F.min("min_depth").alias("min_depth"), F.max("max_depth").alias("max_depth"), F.sum("n").alias("n"))


def unproject_pixels(image: DataFrame, sweeps: DataFrame, p: Params) -> DataFrame:
    """Global point of each pixel's centre at its greatest depth."""
    x, y, z = unprojected(F.col("v"), F.col("h"), F.col("max_depth"), p.grid)
    local = fenced(image.join(sweeps.select("scene_id", F.col("sweep_idx").alias("di"), *POSE), IMAGE), {"x": x, "y": y, "z": z})
    gx, gy, gz = transformed("", F.col("x"), F.col("y"), F.col("z"))
    return local.select(*image.columns, gx.alias("gx"), gy.alias("gy"), gz.alias("gz"))


def ready_sweeps(df: DataFrame, p: Params) -> DataFrame:
    """Rows of sweeps that have enough sweeps before them."""
    return df.where(F.col("sweep_idx") >= p.init_sweeps - 1)


def history_join(points: DataFrame, images: DataFrame, p: Params, frames: int, start: int = 1) -> DataFrame:
    """Every point in each of the ``images`` of the last ``frames`` sweeps: k from ``start``, and its projection; negative numbers look ahead."""
    steps = F.sequence(F.lit(start), F.lit(frames)) if frames >= start else F.array().cast("array<int>")
    pairs = points.withColumn("k", F.explode(steps)).withColumn("di", F.col("sweep_idx") - F.col("k")).where("di >= 0")
    return project(pairs, images, p)


def occlusion_coarse(gpoints: DataFrame, sweeps: DataFrame, p: Params, dilated: DataFrame | None = None) -> DataFrame:
    """Per point of a ready sweep and past image: k and the label against the dilated image."""
    if dilated is None:
        dilated = depth_image_dilated(depth_image(own_projection(gpoints, sweeps, p)), p)
    return coarse_labels(history_join(ready_sweeps(gpoints, p), ready_images(gpoints, sweeps), p, p.frames), dilated, p)


def occlusion_margins(gpoints: DataFrame, sweeps: DataFrame, p: Params, dilated: DataFrame) -> DataFrame:
    """Per point of a ready sweep and past image: by how much it is in front of the dilated image (null where it has no surface to be in front of)."""
    pairs = history_join(ready_sweeps(gpoints, p), ready_images(gpoints, sweeps), p, p.frames)
    seen = pairs.join(dilated.select("scene_id", "di", "v", "h", "min_depth"), ["scene_id", "di", "v", "h"], "left")
    return seen.select(*POINT, "k", F.when(F.col("in_fov"), F.col("min_depth") - F.col("depth")).alias("margin"))


def coarse_labels(pairs: DataFrame, dilated: DataFrame, p: Params, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labels of projected pairs (with the columns ``keep``): empty window, in front of it, or behind (as is a point that doesn't project)."""
    seen = pairs.join(dilated.select("scene_id", "di", "v", "h", "min_depth"), ["scene_id", "di", "v", "h"], "left")
    label = F.when(~F.col("in_fov"), OCCLUDED_BY).when(F.col("min_depth").isNull(), EMPTY).when(F.col("depth") < F.col("min_depth") - p.epsilon, DYNAMIC).otherwise(OCCLUDED_BY)
    return seen.select(*POINT, "k", label.cast("byte").alias("label"), *keep)


def occlusion_vote(coarse: DataFrame, gpoints: DataFrame, p: Params) -> DataFrame:
    """One label per point of a ready sweep: dynamic with enough votes, else that of the sweep before, else undetermined."""
    votes = coarse.groupBy(*POINT).agg(*_votes())
    return ready_sweeps(gpoints, p).select(*POINT).join(votes, POINT, "left").select(*POINT, _voted(p))


def _votes() -> list[Column]:
    return [F.max(F.when(F.col("k") == 1, F.col("label"))).alias("previous"), F.count_if((F.col("label") == DYNAMIC) & (F.col("k") != 0)).alias("votes")]


def _voted(p: Params) -> Column:
    return F.when(F.col("votes") >= p.vote, DYNAMIC).otherwise(F.coalesce("previous", F.lit(UNDETERMINED))).cast("byte").alias("label")


def located_vote(coarse: DataFrame, p: Params, keep: tuple[str, ...]) -> DataFrame:
    """The same of pairs that have each point's own image too (k = 0, which doesn't vote) and its columns ``keep``: no point needs to be joined again."""
    return coarse.groupBy(*POINT).agg(*[F.first(c).alias(c) for c in keep], *_votes()).select(*POINT, *keep, _voted(p))


def vote_in_place(points: DataFrame, images: DataFrame, dilated: DataFrame, p: Params, keep: tuple[str, ...]) -> DataFrame:
    """``occlusion_vote`` of points (of ready sweeps) with their columns ``keep``.

    Where ``dilated`` is broadcast, a point's images are counted where the point is read, so that one row a point is shuffled.
    """
    return located_vote(coarse_labels(history_join(points, images, p, p.frames, start=0), dilated, p, keep), p, keep)
