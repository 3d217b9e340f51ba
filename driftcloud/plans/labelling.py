"""The geometric labelling of all sweeps as one set of joins."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import norm
from ..operators import ground, images, motion, refinement
from ..operators.images import POINT
from ..params import DYNAMIC, GROUND, OCCLUDED_BY, UNDETERMINED, Params
from ..session import lookup, saved, scratch_path, scratch_scope

#: Where a point is: its global place and its range.
LOCATION = ("gx", "gy", "gz", "rng")
PreLabeller = Callable[[DataFrame, Params], DataFrame]


def ground_prelabeller(points: DataFrame, p: Params) -> DataFrame:
    return ground.prelabel_ground(points, ground.ransac_planes(points, p), p)


class Scene:
    """Tables that several stages share, each written once: kept points, their projections, images and static points."""

    def __init__(self, points: DataFrame, sweeps: DataFrame, p: Params, prelabellers: list[PreLabeller] | None = None):
        self.p, self.sweeps = p, lookup(saved(sweeps))
        kept = saved(images.filter_range(points, p))
        self.gpoints = images.to_global(kept, self.sweeps).withColumn("rng", norm(F.col("x"), F.col("y"), F.col("z")))  # computed where it is read
        self.bare = self.gpoints.select(*POINT, *LOCATION)
        if prelabellers is None:  # a plane a sweep says which points are ground
            self.marked = ground.mark_ground(self.gpoints, saved(ground.ransac_planes(self.gpoints, p)), p).select(*POINT, *LOCATION, "is_ground")
        else:
            found = self.gpoints.select(*POINT).limit(0)
            for label in prelabellers:
                found = found.unionByName(label(self.gpoints, p))
            found = found.distinct().withColumn("is_ground", F.lit(True))
            self.marked = saved(self.bare.join(found, POINT, "left").withColumn("is_ground", F.coalesce("is_ground", F.lit(False))))
        self.ground = self.marked.where("is_ground").select(*POINT)
        self.own = images.own_projection(self.marked, self.sweeps, p).drop(*LOCATION)
        self.image = lookup(saved(images.depth_image(self.own)))
        self.dilated = lookup(saved(images.depth_image_dilated(self.image, p)))

    @cached_property
    def static(self) -> DataFrame:
        """Ground points as anchors; not every stage asks for them."""
        return saved(motion.static_points(self.own.where("is_ground"), None, self.p))

    def first_pass(self) -> DataFrame:
        """Labels of ready sweeps after the vote, ground points marked, with the points' places."""
        ready = images.ready_sweeps(self.marked, self.p)
        # images come from all points, so readiness is asked of all; only active points are looked up
        voted = images.vote_in_place(ready.where("not is_ground").drop("is_ground"), images.ready_images(self.bare, self.sweeps), self.dilated, self.p, LOCATION)
        return voted.unionByName(ready.where("is_ground").drop("is_ground").withColumn("label", F.lit(GROUND).cast("byte")))

    def candidates(self, label: int) -> DataFrame:
        """Points of one label of the first pass, without writing the others; undetermined are only those of sweeps that have no image just before."""
        if label != UNDETERMINED or self.p.frames < 1:
            return self.with_points(self.first_pass(), label)
        after = images.ready_images(self.bare, self.sweeps).select("scene_id", (F.col("di") + 1).alias("sweep_idx"))
        part = copy(self)
        part.marked = self.marked.join(lookup(saved(after)), ["scene_id", "sweep_idx"], "left_anti")
        return part.with_points(part.first_pass(), label)

    def with_points(self, labels: DataFrame, label: int) -> DataFrame:
        """Points of one label; labels that have the places need no join."""
        of = labels.where(F.col("label") == label)
        if set(LOCATION) <= set(labels.columns):
            return of.select(*POINT, *LOCATION)
        return self.bare.join(of.select(*POINT), POINT, "left_semi")

    def relabelled(self, labels: DataFrame, hits: DataFrame, old: int, label: int) -> DataFrame:
        """Hits, which are points of label ``old``, get another; later stages take precedence.  Other points don't move."""
        new = hits.select(*POINT, F.lit(label).cast("byte").alias("_new"))
        asked = labels.where(F.col("label") == old).join(new, POINT, "left").withColumn("label", F.coalesce("_new", "label")).select(labels.columns)
        return labels.where(F.col("label") != old).unionByName(asked)

    def scores(self, candidates: DataFrame) -> DataFrame:
        frames = motion.mcc_frames(candidates, self.bare, self.sweeps, self.image, self.static, self.p)
        return motion.mcc_score(frames, candidates)

    def apply_mcc(self, labels: DataFrame) -> DataFrame:
        """Dynamic points that fit the static map become occluded ones."""
        if not self.p.mcc_enabled:
            return labels
        static = self.scores(self.with_points(labels, DYNAMIC)).where(F.col("score") >= self.p.mcc_threshold)
        return self.relabelled(labels, static, DYNAMIC, OCCLUDED_BY)

    def parallel(self, labels: DataFrame) -> DataFrame:
        hits = motion.event_parallel_away(self.with_points(labels, OCCLUDED_BY), self.sweeps, self.bare, self.image, self.p)
        return self.relabelled(labels, hits, OCCLUDED_BY, DYNAMIC)

    def perpendicular(self, labels: DataFrame) -> DataFrame:
        hits = motion.event_perpendicular(self.with_points(labels, UNDETERMINED), self.sweeps, self.bare, self.static, self.p)
        return self.relabelled(labels, hits, UNDETERMINED, DYNAMIC)

    def event_with_mcc(self, labels: DataFrame, test: Callable[[DataFrame], DataFrame], veto: bool) -> DataFrame:
        """A motion test; points that it turns dynamic go back if the static map speaks against it."""
        tested = test(labels)
        if not veto or not self.p.mcc_enabled:
            return tested
        old = labels.select(*POINT, F.col("label").alias("old"))
        turned = tested.join(old, POINT).where((F.col("label") == DYNAMIC) & (F.col("old") != DYNAMIC)).select(*POINT, "old")
        against = self.scores(self.bare.join(turned, POINT, "left_semi")).where(F.col("score") >= self.p.mcc_threshold).join(turned, POINT).select(*POINT, "old")
        return tested.join(against, POINT, "left").select(*POINT, F.coalesce("old", "label").alias("label"))

    def label_geometric(self, veto: bool = False) -> DataFrame:
        """Ground, vote, map consistency, then both motion tests."""
        return self.placed_labels(veto).select(*POINT, "label")

    def placed_labels(self, veto: bool = False) -> DataFrame:
        """The same with the points' places (without ``veto``, which drops them)."""
        return self.after_first_pass(saved(self.first_pass()), veto)

    def after_first_pass(self, first: DataFrame, veto: bool = False) -> DataFrame:
        labels = saved(self.apply_mcc(first))
        labels = saved(self.event_with_mcc(labels, self.parallel, veto))
        return self.event_with_mcc(labels, self.perpendicular, veto)

    def label_points(self, veto: bool = False) -> DataFrame:
        """The geometric labels, refined as ``p.refine`` says; counts are those of ``label_histogram``."""
        if self.p.static_source == "labels":
            return self.label_wave(veto)
        return refinement.refine(saved(self.placed_labels(veto)), self.bare, self.p)

    def label_wave(self, veto: bool = False) -> DataFrame:
        """Refined labels where a point of an earlier sweep is static if it was labelled so: occluded, or ground (of a sweep itself, ground).

        The first pass needs no labels and is one job for all.  Then a wave runs over the sweeps, all scenes side by side: a step
        reads the final labels of the few sweeps before it and writes its own, in a folder by sweep.  Tables are stored by sweep, so
        that a step reads only the sweeps it looks back at, and its plan is the same for the first sweep and the last.
        """
        spark, p = self.bare.sparkSession, self.p
        first, bare, own, ground_by = (saved(df, ("sweep_idx",)) for df in (self.first_pass().select(*POINT, "label"), self.bare, self.own, self.ground))
        image = saved(self.image, ("di",))
        path, schema = scratch_path(spark), first.schema
        low, high = first.agg(F.min("sweep_idx"), F.max("sweep_idx")).first()
        for i in range(low, high + 1) if low is not None else ():
            window = F.col("sweep_idx").between(i - p.look_back, i)
            with scratch_scope(spark):
                members = ground_by.where(F.col("sweep_idx") == i)
                if i > low:
                    past = spark.read.schema(schema).parquet(path).where(F.col("sweep_idx").between(i - p.look_back, i - 1) & F.col("label").isin(OCCLUDED_BY, GROUND))
                    members = members.unionByName(past.select(*POINT))
                step = copy(self)
                step.bare, step.image = bare.where(window), image.where(F.col("di").between(i - p.look_back, i))
                step.static = saved(motion.static_points(own.where(window), members, p))
                labels = step.after_first_pass(saved(first.where(F.col("sweep_idx") == i)), veto).select(*POINT, "label")
                final = refinement.refine(saved(labels), bare.where(F.col("sweep_idx") == i), p)
                final.write.mode("append").partitionBy("sweep_idx").parquet(path)
        if low is None:
            return first
        return spark.read.schema(schema).parquet(path).select(*POINT, "label")


def label_histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("scene_id", "sweep_idx", "label").agg(F.count("*").alias("n"))
