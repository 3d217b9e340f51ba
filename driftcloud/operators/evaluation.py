"""Labels against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import DYNAMIC, GROUND
from ..session import unsent
from .images import POINT


def match_gt(labels: DataFrame, gt: DataFrame) -> DataFrame:
    """Labels with is_gt."""
    return labels.join(unsent(gt.select(*POINT, F.lit(True).alias("is_gt"))), POINT, "left").withColumn("is_gt", F.coalesce("is_gt", F.lit(False)))


def error_class(matched: DataFrame) -> DataFrame:
    """TP, FP, FN or TN of each point."""
    dynamic = F.col("label") == DYNAMIC
    kind = F.when(dynamic & F.col("is_gt"), "TP").when(dynamic, "FP").when(F.col("is_gt"), "FN").otherwise("TN")
    return matched.select(*POINT, kind.alias("error_class"))


def label_class(labels: DataFrame) -> DataFrame:
    kind = F.when(F.col("label") == DYNAMIC, "dynamic").when(F.col("label") == GROUND, "ground").otherwise("static")
    return labels.select(*POINT, kind.alias("label_class"))


def gt_class(points: DataFrame, kept: DataFrame, gt: DataFrame) -> DataFrame:
    """Of every raw point: dynamic, static or filtered_out."""
    marked = match_gt(points.select(*POINT).join(kept.select(*POINT, F.lit(True).alias("kept")), POINT, "left"), gt)
    return marked.select(*POINT, F.when(F.col("kept").isNull(), "filtered_out").when(F.col("is_gt"), "dynamic").otherwise("static").alias("gt_class"))


def confusion(matched: DataFrame, keys: tuple[str, ...] = ("scene_id", "sweep_idx")) -> DataFrame:
    dynamic = F.col("label") == DYNAMIC
    return matched.groupBy(*keys).agg(F.count_if(dynamic & F.col("is_gt")).alias("tp"), F.count_if(dynamic & ~F.col("is_gt")).alias("fp"), F.count_if(~dynamic & F.col("is_gt")).alias("fn"), F.count_if(~dynamic & ~F.col("is_gt")).alias("tn"))


def with_iou(counts: DataFrame) -> DataFrame:
    """Adds iou: tp / (tp + fp + fn), 0 where that is nothing."""
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("iou", F.when(union > 0, F.col("tp") / union).otherwise(0.0))


def report(matched: DataFrame) -> DataFrame:
    """Per sweep, per scene and in all (nulls), micro-averaged."""
    per = confusion(matched)
    return with_iou(per.rollup("scene_id", "sweep_idx").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))
