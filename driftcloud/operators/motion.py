"""Map consistency and the two motion tests."""

from __future__ import annotations

from itertools import combinations, islice

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import adaptive_epsilon
from ..params import Params
from .images import POINT, project, ready_images, spread

_PIXEL = ["scene_id", "di", "v", "h"]


def static_points(own: DataFrame, members: DataFrame | None, p: Params) -> DataFrame:
    """Static points as anchors in their own images: the projected points of ready sweeps that ``members`` names (all, if None)."""
    seen = own.where("in_fov")
    if members is not None:
        seen = seen.join(members.select(*POINT), POINT, "left_semi")
    return seen.where(F.col("sweep_idx") >= p.init_sweeps - 1).select("scene_id", "di", F.col("point_idx").alias("static_idx"), F.col("phi").alias("s_phi"), F.col("theta").alias("s_theta"), F.col("depth").alias("s_depth"), F.col("v").alias("s_v"), F.col("h").alias("s_h"))


def _cell(angle: Column, width: float) -> Column:
    return F.floor(angle / width).cast("int")


def near_static(seen: DataFrame, static: DataFrame, p: Params) -> DataFrame:
    """Pairs of projected candidates and static points within both angles: a range join over 3 by 3 cells."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = seen.withColumn("s", F.explode(steps)).withColumns({"cp": _cell(F.col("phi"), p.mcc_h) + F.col("s.i"), "ct": _cell(F.col("theta"), p.mcc_v) + F.col("s.j")}).drop("s")
    anchors = static.withColumns({"cp": _cell(F.col("s_phi"), p.mcc_h), "ct": _cell(F.col("s_theta"), p.mcc_v)})
    return cells.join(anchors, ["scene_id", "di", "cp", "ct"]).where((F.abs(F.col("phi") - F.col("s_phi")) <= p.mcc_h) & (F.abs(F.col("theta") - F.col("s_theta")) <= p.mcc_v))


def _fits(depth: Column, surface: Column, anchor: Column, p: Params) -> Column:
    back, ahead = adaptive_epsilon(anchor, p.mcc_backward, p.mcc_backward_adaptive), adaptive_epsilon(anchor, p.mcc_forward, p.mcc_forward_adaptive)
    return (depth >= surface - back) & (depth <= surface + ahead)


def mcc_interpolate(seen: DataFrame, static: DataFrame, p: Params) -> DataFrame:
    """Surface depth at each candidate from the first triplet of near static points that encloses it: point, di, surface."""
    order = Window.partitionBy(*POINT, "di").orderBy(F.abs(F.col("phi") - F.col("s_phi")) + F.abs(F.col("theta") - F.col("s_theta")), "static_idx")
    near = near_static(seen, static, p).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.mcc_neighbours)
    lists = near.groupBy(*POINT, "di").agg(F.first("phi").alias("phi"), F.first("theta").alias("theta"), F.array_sort(F.collect_list(F.struct("rank", "s_phi", "s_theta", "s_depth"))).alias("s")).where("size(s) >= 3")
    ranks = list(islice(combinations(range(p.mcc_neighbours), 3), 1_000_000))
    by_size = F.create_map(*[x for n in range(3, p.mcc_neighbours + 1) for x in (F.lit(n), F.array(*[F.struct(*[F.lit(i).alias(c) for c, i in zip("ijk", t)]) for t in islice((r for r in ranks if r[2] < n), p.mcc_triplets)]))])
    tried = lists.select(*POINT, "di", "phi", "theta", "s", F.posexplode(by_size[F.size("s")]).alias("trial", "t"))
    a, b, c = (F.col("s")[F.col(f"t.{x}")] for x in "ijk")
    det = (b.s_phi - a.s_phi) * (c.s_theta - a.s_theta) - (c.s_phi - a.s_phi) * (b.s_theta - a.s_theta)
    wb = ((F.col("phi") - a.s_phi) * (c.s_theta - a.s_theta) - (c.s_phi - a.s_phi) * (F.col("theta") - a.s_theta)) / F.nullif(det, F.lit(0.0))
    wc = ((b.s_phi - a.s_phi) * (F.col("theta") - a.s_theta) - (F.col("phi") - a.s_phi) * (b.s_theta - a.s_theta)) / F.nullif(det, F.lit(0.0))
    weighted = tried.select(*POINT, "di", "trial", wb.alias("wb"), wc.alias("wc"), a.s_depth.alias("da"), b.s_depth.alias("db"), c.s_depth.alias("dc"))
    inside = weighted.where("wb >= -1e-9 and wc >= -1e-9 and 1 - wb - wc >= -1e-9")
    return inside.groupBy(*POINT, "di").agg(F.min_by(F.expr("(1 - wb - wc) * da + wb * db + wc * dc"), "trial").alias("surface"))


def mcc_frames(candidates: DataFrame, gpoints: DataFrame, sweeps: DataFrame, image: DataFrame, static: DataFrame, p: Params) -> DataFrame:
    """Per candidate (with its anchor depth ``rng``) and checked image: matched."""
    first = 0 if p.mcc_include_current else 1
    images = gpoints.select("scene_id", "sweep_idx", "gx", "gy", "gz", "point_idx")
    steps = candidates.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(first + p.mcc_sweeps - 1)))).withColumn("di", F.col("sweep_idx") - F.col("k")).where("di >= 0")
    seen = project(steps, ready_images(images, sweeps), p).where("in_fov").join(static.select("scene_id", "di").distinct(), ["scene_id", "di"], "left_semi")
    seen = seen.join(image.select(*_PIXEL, F.lit(True).alias("full")), _PIXEL, "left").withColumn("full", F.coalesce("full", F.lit(False)))
    hit = near_static(seen.where("full"), static, p).where(_fits(F.col("depth"), F.col("s_depth"), F.col("rng"), p)).select(*POINT, "di").distinct()
    if p.mcc_interpolate:
        gaps = seen.where(~F.col("full"))
        surfaces = mcc_interpolate(gaps, static, p).join(gaps.select(*POINT, "di", "depth", "rng"), [*POINT, "di"])
        hit = hit.unionByName(surfaces.where(_fits(F.col("depth"), F.col("surface"), F.col("rng"), p)).select(*POINT, "di"))
    return seen.select(*POINT, "di").join(hit.withColumn("matched", F.lit(True)), [*POINT, "di"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def mcc_score(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """checked, matched and score (0 where nothing was checked) of every candidate."""
    per = frames.groupBy(*POINT).agg(F.count("*").alias("checked"), F.count_if("matched").alias("matched"))
    zero = F.lit(0).cast("long")
    out = candidates.select(*POINT).join(per, POINT, "left").withColumns({"checked": F.coalesce("checked", zero), "matched": F.coalesce("matched", zero)})
    return out.withColumn("score", F.when(F.col("checked") > 0, F.col("matched") / F.col("checked")).otherwise(0.0))


def occlusion_detailed(kind: str, phi: Column, theta: Column, depth: Column, h_phi: Column, h_theta: Column, h_depth: Column, anchor: Column, p: Params) -> Column:
    """Whether an evaluated point occludes, or is occluded by, a historical one."""
    if kind not in ("OCCLUDING", "OCCLUDED_BY"):
        raise ValueError(f"unknown occlusion {kind!r}")
    eps = adaptive_epsilon(anchor, p.detail_epsilon, p.detail_adaptive)
    near = (F.abs(phi - h_phi) <= p.detail_h) & (F.abs(theta - h_theta) <= p.detail_v)
    if kind == "OCCLUDING":
        return near & (depth < h_depth - eps)
    return near & (depth > h_depth + eps)


def nearest_pixel(image: DataFrame, p: Params) -> DataFrame:
    """For every pixel the occupied pixel of its window with the smallest least depth (ties: the first place): pv, ph, p_max."""
    best = F.min_by(F.struct("pv", "ph", "max_depth"), F.struct("min_depth", "place")).alias("b")
    return spread(image, p).groupBy(*_PIXEL).agg(best).select(*_PIXEL, F.col("b.pv").alias("pv"), F.col("b.ph").alias("ph"), F.col("b.max_depth").alias("p_max"))


def event_parallel_away(candidates: DataFrame, sweeps: DataFrame, gpoints: DataFrame, image: DataFrame, p: Params) -> DataFrame:
    """Candidates behind a nearer surface in each of the last sweeps; without any past sweep, none."""
    asked = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(p.parallel_sweeps)))).withColumn("di", F.col("sweep_idx") - F.col("k")).where("di >= 0")
    seen = project(asked, ready_images(gpoints, sweeps), p).where("in_fov").join(nearest_pixel(image, p), _PIXEL)
    g = p.grid
    h_phi, h_theta = g.phi_min + (F.col("ph") + 0.5) * g.h_res, g.theta_min + (F.col("pv") + 0.5) * g.v_res
    ok = occlusion_detailed("OCCLUDED_BY", F.col("phi"), F.col("theta"), F.col("depth"), h_phi, h_theta, F.col("p_max"), F.col("rng"), p)
    # a point is asked in as many sweeps as there are before it; an image that isn't ready has no row here
    return seen.where(ok).groupBy(*POINT).agg(F.count("*").alias("n")).where(F.col("n") == F.least(F.lit(p.parallel_sweeps), F.col("sweep_idx"))).select(*POINT)


def event_perpendicular(candidates: DataFrame, sweeps: DataFrame, gpoints: DataFrame, static: DataFrame, p: Params) -> DataFrame:
    """Candidates that occlude a static point of their window in any of the last sweeps."""
    if p.candidate_cap is not None:
        n = F.count("*").over(Window.partitionBy("scene_id", "sweep_idx"))
        candidates = candidates.withColumn("_n", n).where(F.col("_n") <= p.candidate_cap).drop("_n")
    asked = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(p.perpendicular_sweeps)))).withColumn("di", F.col("sweep_idx") - F.col("k")).where("di >= 0")
    seen = project(asked, ready_images(gpoints, sweeps), p).where("in_fov")
    window = F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(dh).alias("dh")) for dv in range(-p.window_v, p.window_v + 1) for dh in range(-p.window_h, p.window_h + 1)])
    cells = seen.withColumn("o", F.explode(window)).withColumns({"s_v": F.col("v") + F.col("o.dv"), "s_h": F.col("h") + F.col("o.dh")}).drop("o", "v", "h")
    pairs = cells.join(static, ["scene_id", "di", "s_v", "s_h"])
    hit = occlusion_detailed("OCCLUDING", F.col("phi"), F.col("theta"), F.col("depth"), F.col("s_phi"), F.col("s_theta"), F.col("s_depth"), F.col("rng"), p)
    return pairs.where(hit).select(*POINT).distinct()
