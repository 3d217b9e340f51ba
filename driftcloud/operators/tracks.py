"""Box tracks: velocities, a box per instance and sweep, and the points inside moving boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import fenced, rotation, with_slerp
from ..params import Params
from ..session import saved

BOX = ["tx", "ty", "tz", "w", "l", "h", "qw", "qx", "qy", "qz", "category"]


def scene_instances(annotations: DataFrame, least: int) -> DataFrame:
    """Instances of each scene with at least ``least`` annotations."""
    return annotations.groupBy("scene_id", "instance_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("scene_id", "instance_id")


def track_velocity(annotations: DataFrame, max_gap_us: int | None = 1_500_000) -> DataFrame:
    """Adds vx, vy, vz: centred over both neighbours if their gap is at most ``max_gap_us`` (doubled for two), else backward, else forward, else 0.

    Differences over 1 ms or less don't count; without ``max_gap_us`` there is no centred rule.
    """
    w = Window.partitionBy("scene_id", "instance_id").orderBy("ts_us")
    here = F.struct("ts_us", "tx", "ty", "tz")
    out = annotations.withColumns({"_p": F.lag(here).over(w), "_n": F.lead(here).over(w)})

    def rate(a: str, b: str, c: str) -> Column:
        get = lambda s, f: F.col(f"{s}.{f}") if s else F.col(f)
        dt = (get(b, "ts_us") - get(a, "ts_us")) / 1e6
        return F.when(dt > 0.001, (get(b, c) - get(a, c)) / dt)

    for c, v in (("tx", "vx"), ("ty", "vy"), ("tz", "vz")):
        rules = [rate("_p", "", c), rate("", "_n", c)]
        if max_gap_us is not None:
            rules.insert(0, F.when(F.col("_n.ts_us") - F.col("_p.ts_us") <= 2 * max_gap_us, rate("_p", "_n", c)))
        out = out.withColumn(v, F.coalesce(*rules, F.lit(0.0)))
    return out.drop("_p", "_n")


def boxes_asof(annotations: DataFrame, sweeps: DataFrame, p: Params) -> DataFrame:
    """A box per instance and sweep: of the key frame's sample, of the exact time, between two annotations, or beyond an end by at most ``extrapolate_us``."""
    tracks = track_velocity(annotations)
    fields = ["ts_us", *BOX, "vx", "vy", "vz"]
    key = F.struct(*fields)
    pairs = sweeps.select("scene_id", "sweep_idx", F.col("ts_us").alias("t"), "is_key_frame", "sample_id").join(scene_instances(annotations, p.least_annotations), "scene_id")
    by_sample = tracks.select("scene_id", "instance_id", "sample_id", key.alias("b_sample"))
    pairs = pairs.join(by_sample, ["scene_id", "instance_id", "sample_id"], "left").withColumn("b_sample", F.when(F.col("is_key_frame"), F.col("b_sample")))
    asked = pairs.select("scene_id", "instance_id", F.col("t").alias("ts"), F.struct("sweep_idx", "b_sample").alias("q"), F.lit(None).cast(tracks.select(key.alias("k")).schema["k"].dataType).alias("a"))
    known = tracks.select("scene_id", "instance_id", F.col("ts_us").alias("ts"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"), key.alias("a"))
    w = Window.partitionBy("scene_id", "instance_id").orderBy("ts")
    past, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    both = asked.unionByName(known).select("*", F.last("a", ignorenulls=True).over(past).alias("p"), F.first("a", ignorenulls=True).over(ahead).alias("n")).where("q is not null")
    t, prev, nxt = F.col("ts"), F.col("p"), F.col("n")
    both = fenced(both, {"exact": F.coalesce(F.col("q.b_sample"), F.when(prev.ts_us == t, prev)), "end": F.coalesce(prev, nxt)})
    exact, end = F.col("exact"), F.col("end")
    both = fenced(both, {"between": exact.isNull() & prev.isNotNull() & nxt.isNotNull(), "beyond": exact.isNull() & (F.abs(t - end.ts_us) <= p.extrapolate_us)})
    both = with_slerp(both, "p", "n", F.try_divide(t - prev.ts_us, nxt.ts_us - prev.ts_us))
    between, share = F.col("between"), (t - prev.ts_us) / (nxt.ts_us - prev.ts_us)
    span = (nxt.ts_us - prev.ts_us) / 1e6
    method = F.when(exact.isNotNull(), "exact").when(between, "interpolated").when(F.col("beyond"), "extrapolated")
    out: dict[str, Column] = {}
    for c, v in (("tx", "vx"), ("ty", "vy"), ("tz", "vz")):
        out[c] = F.when(exact.isNotNull(), exact[c]).when(between, prev[c] + (nxt[c] - prev[c]) * share).otherwise(end[c] + end[v] * (t - end.ts_us) / 1e6)
        out[v] = F.when(exact.isNotNull(), exact[v]).when(between, F.when(span > 0.001, (nxt[c] - prev[c]) / span).otherwise(0.0)).otherwise(end[v])
    for c in ("w", "l", "h", "category"):
        out[c] = F.when(exact.isNotNull(), exact[c]).when(between, prev[c]).otherwise(end[c])
    for c in ("qw", "qx", "qy", "qz"):
        out[c] = F.when(exact.isNotNull(), exact[c]).when(between, F.col(f"s_{c}")).otherwise(end[c])
    return both.select("scene_id", F.col("q.sweep_idx").alias("sweep_idx"), "instance_id", method.alias("method"), *[c.alias(n) for n, c in out.items()]).where("method is not null")


def moving_boxes(boxes: DataFrame, p: Params) -> DataFrame:
    return boxes.where(F.hypot("vx", "vy") >= p.speed_threshold)


def points_in_boxes(gpoints: DataFrame, boxes: DataFrame, cell: float = 8.0) -> DataFrame:
    """Points inside or on any box of their sweep: grid cells of the boxes' bounds, then the turned box."""
    r = rotation(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    turned = boxes.select("scene_id", "sweep_idx", *[F.col(c).alias(f"b_{c}") for c in ("tx", "ty", "tz")], (F.col("l") / 2).alias("hl"), (F.col("w") / 2).alias("hw"), (F.col("h") / 2).alias("hh"), *[c.alias(n) for n, c in r.items()])
    reach = {a: F.abs(F.col(f"r{i}0")) * F.col("hl") + F.abs(F.col(f"r{i}1")) * F.col("hw") + F.abs(F.col(f"r{i}2")) * F.col("hh") for i, a in enumerate("xyz")}
    cells = turned.withColumns({f"e_{a}": c for a, c in reach.items()})
    for a in "xy":
        lo, hi = F.floor((F.col(f"b_t{a}") - F.col(f"e_{a}")) / cell), F.floor((F.col(f"b_t{a}") + F.col(f"e_{a}")) / cell)
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    keyed = gpoints.withColumns({f"c{a}": F.floor(F.col(f"g{a}") / cell) for a in "xy"})
    d = [F.col(f"g{a}") - F.col(f"b_t{a}") for a in "xyz"]
    inside = [F.abs(sum((F.col(f"r{i}{j}") * d[i] for i in (1, 2)), F.col(f"r0{j}") * d[0])) <= F.col(half) for j, half in enumerate(("hl", "hw", "hh"))]
    hit = keyed.join(cells, ["scene_id", "sweep_idx", "cx", "cy"]).where(inside[0] & inside[1] & inside[2])
    return hit.select("scene_id", "sweep_idx", "point_idx").distinct()


def generate_gt(gpoints: DataFrame, annotations: DataFrame, sweeps: DataFrame, p: Params) -> DataFrame:
    """Dynamic points: those in boxes that move."""
    return points_in_boxes(gpoints, saved(moving_boxes(boxes_asof(annotations, sweeps, p), p)))


def gt_offsets(gt: DataFrame, sweeps: DataFrame) -> DataFrame:
    """Running total of dynamic points over each scene's sweeps."""
    counts = sweeps.select("scene_id", "sweep_idx").join(gt.groupBy("scene_id", "sweep_idx").agg(F.count("*").alias("n")), ["scene_id", "sweep_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("scene_id").orderBy("sweep_idx").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("scene_id", "sweep_idx", "n", F.sum("n").over(w).alias("until"))
