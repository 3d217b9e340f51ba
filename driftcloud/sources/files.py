"""Sources and sinks: metadata records, binary sweep files, ground-truth labels, point labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import composed, rotation
from ..operators.tracks import gt_offsets

#: Columns of each metadata table that the operators read.
SCHEMAS = {
    "scene": "token string, name string, first_sample_token string",
    "sample": "token string, timestamp long, scene_token string",
    "sample_data": "token string, filename string, timestamp long, is_key_frame boolean, sample_token string, calibrated_sensor_token string, ego_pose_token string, channel string",
    "calibrated_sensor": "token string, rotation array<double>, translation array<double>",
    "ego_pose": "token string, rotation array<double>, translation array<double>",
    "instance": "token string",
    "sample_annotation": "token string, sample_token string, instance_token string, translation array<double>, size array<double>, rotation array<double>, category_name string",
}


def read_metadata(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).json(f"{folder}/{table}.json", multiLine=True)


def list_sweeps(sample_data: DataFrame, sample: DataFrame, channel: str = "LIDAR_TOP") -> DataFrame:
    """Sweeps of one sensor in time order per scene: adds scene_token and sweep_idx."""
    scenes = sample.select(F.col("token").alias("sample_token"), "scene_token")
    order = Window.partitionBy("scene_token").orderBy("timestamp", "token")
    return sample_data.where(F.col("channel") == channel).join(scenes, "sample_token").withColumn("sweep_idx", (F.row_number().over(order) - 1).cast("int"))


def slice_sweeps(df: DataFrame, skip: int = 0, most: int | None = None) -> DataFrame:
    out = df.where(F.col("sweep_idx") >= skip)
    return out if most is None else out.where(F.col("sweep_idx") < skip + most)


def select_scenes(df: DataFrame, scenes: str | list[int]) -> DataFrame:
    return df if scenes == "all" else df.where(F.col("scene_id").isin(list(scenes)))


def _pose(prefix: str) -> dict:
    q = [F.col(f"{prefix}_rotation")[i] for i in range(4)]
    return rotation(*q) | {t: F.col(f"{prefix}_translation")[i] for i, t in enumerate(("tx", "ty", "tz"))}


def assemble_sweeps(listed: DataFrame, calibrated: DataFrame, ego: DataFrame) -> DataFrame:
    """Sweeps with their pose: global from ego, ego from sensor."""
    def named(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(F.col("token").alias(key), F.col("rotation").alias(f"{prefix}_rotation"), F.col("translation").alias(f"{prefix}_translation"))

    both = listed.join(named(calibrated, "calibrated_sensor_token", "c"), "calibrated_sensor_token").join(named(ego, "ego_pose_token", "e"), "ego_pose_token")
    pose = composed(_pose("e"), _pose("c"))
    return both.select(F.xxhash64("scene_token").alias("scene_id"), "sweep_idx", F.col("timestamp").alias("ts_us"), "is_key_frame", F.col("sample_token").alias("sample_id"), "filename", *[c.alias(n) for n, c in pose.items()])


def assemble_annotations(annotation: DataFrame, sample: DataFrame) -> DataFrame:
    """Annotations with their sample's time, in the engine's columns."""
    times = sample.select(F.col("token").alias("sample_token"), F.col("timestamp").alias("ts_us"), "scene_token")
    t, s, q = F.col("translation"), F.col("size"), F.col("rotation")
    return annotation.join(times, "sample_token").select(
        F.xxhash64("scene_token").alias("scene_id"), F.xxhash64("instance_token").alias("instance_id"), F.col("sample_token").alias("sample_id"), "ts_us",
        *[t[i].alias(n) for i, n in enumerate(("tx", "ty", "tz"))], *[s[i].alias(n) for i, n in enumerate("wlh")], *[q[i].alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))], F.col("category_name").alias("category"),
    )


def _open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def read_sweep_files(sweeps: DataFrame, folder: str, values: int = 5, rows_at_once: int = 65_536) -> DataFrame:
    """Points of the sweeps' files (float32 rows whose first three values are x, y, z); a missing file gives no points.

    ``filename`` is relative to the folder, which all executors reach (a shared mount, or a store that pyarrow knows).  The
    list of sweeps is what is dealt to the tasks, and each task opens the files of its own sweeps and no others: nothing is
    listed, and no content is shuffled.  A file is read in slices of ``rows_at_once`` rows; an incomplete last row is left out.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_folder(folder)
        row = 4 * values
        for batch in batches:
            for scene_id, sweep_idx, filename in zip(*(c.to_pylist() for c in batch.columns)):
                path, first = f"{base.rstrip('/')}/{filename}", 0
                if store.get_file_info(path).type != pafs.FileType.File:
                    continue
                with store.open_input_stream(path) as file:
                    while n := len(raw := file.read(row * rows_at_once)) // row:
                        xyz = np.frombuffer(raw, np.float32, n * values).reshape(-1, values)[:, :3].astype(float)
                        idx = np.arange(first, first + n, dtype=np.int32)
                        columns = [np.full(n, scene_id, np.int64), np.full(n, sweep_idx, np.int32), idx, *(np.ascontiguousarray(xyz[:, k]) for k in range(3))]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["scene_id", "sweep_idx", "point_idx", "x", "y", "z"])
                        first += n

    asked = sweeps.where("filename is not null").select(F.col("scene_id").cast("long"), F.col("sweep_idx").cast("int"), "filename").repartition("scene_id", "sweep_idx")
    return asked.mapInArrow(points, "scene_id long, sweep_idx int, point_idx int, x double, y double, z double")


def write_gt_labels(gt: DataFrame, path: str, speed_threshold: float, clean: bool = False, sweeps: DataFrame | None = None) -> None:
    """Partitions by threshold and scene; those written are replaced, or with ``clean`` the whole table.

    With ``sweeps`` (all that ground truth was made for) their boundaries are stored beside the labels: how many dynamic
    points each sweep has, none included, and the running total.
    """
    def write(df: DataFrame, to: str) -> None:
        out = df.withColumn("vel_thr", F.lit(speed_threshold)).write.mode("overwrite").partitionBy("vel_thr", "scene_id")
        out.option("partitionOverwriteMode", "static" if clean else "dynamic").parquet(to)

    write(gt, path)
    if sweeps is not None:
        write(gt_offsets(gt, sweeps), boundaries_path(path))


def boundaries_path(path: str) -> str:
    return f"{path.rstrip('/')}_boundaries"


def read_gt_labels(spark: SparkSession, path: str, speed_threshold: float) -> DataFrame:
    return spark.read.parquet(path).where(F.col("vel_thr") == speed_threshold).select(F.col("scene_id").cast("long"), "sweep_idx", "point_idx")


def read_gt_boundaries(spark: SparkSession, path: str, speed_threshold: float) -> DataFrame:
    """The sweeps that the stored ground truth covers: scene_id, sweep_idx, n (dynamic points), until."""
    return spark.read.parquet(boundaries_path(path)).where(F.col("vel_thr") == speed_threshold).select(F.col("scene_id").cast("long"), "sweep_idx", "n", "until")


def covered(labels: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Labels of the sweeps within the ground truth's boundaries.

    A covered sweep without any dynamic point counts: what is called dynamic there is wrong.  Others can't be scored, since
    nothing is known of them.
    """
    return labels.join(boundaries.select("scene_id", "sweep_idx").distinct(), ["scene_id", "sweep_idx"], "left_semi")


def sweep_counts(labels: DataFrame) -> DataFrame:
    """How many sweeps and points each scene of a label table has."""
    return labels.groupBy("scene_id").agg(F.count_distinct("sweep_idx").alias("n_sweeps"), F.count("*").alias("n_points"))


def write_point_labels(labels: DataFrame, gpoints: DataFrame, path: str) -> None:
    """Labels with their global points, by scene: also the table that later parameter sweeps reuse."""
    key = ["scene_id", "sweep_idx", "point_idx"]
    labels.join(gpoints.select(*key, "gx", "gy", "gz"), key).write.mode("overwrite").partitionBy("scene_id").parquet(path)


#: What bucketed tables of one bake are joined on.
BAKED_BY = ("scene_id", "sweep_idx", "point_idx")


def bake_labels(labels: DataFrame, gpoints: DataFrame, gt: DataFrame, sweeps: DataFrame, name: str, folder: str, buckets: int = 64) -> None:
    """Labels before refinement with their global points, ground truth and its boundaries, as tables ``name``_labels, _gt and _sweeps below ``folder``.

    Labels and ground truth are bucketed and sorted by point alike, so that each later trial joins them without a shuffle, and
    sorted by scene first, so that a filter on scenes skips row groups.
    """
    def write(df: DataFrame, part: str) -> None:
        df.write.mode("overwrite").option("path", f"{folder.rstrip('/')}/{part}").bucketBy(buckets, *BAKED_BY).sortBy(*BAKED_BY).saveAsTable(f"{name}_{part}")

    write(covered(labels, sweeps).join(gpoints.select(*BAKED_BY, "gx", "gy", "gz"), list(BAKED_BY)).select(*BAKED_BY, "label", "gx", "gy", "gz"), "labels")
    write(gt.select(*BAKED_BY).distinct(), "gt")
    gt_offsets(gt, sweeps).write.mode("overwrite").option("path", f"{folder.rstrip('/')}/sweeps").saveAsTable(f"{name}_sweeps")


def read_baked(spark: SparkSession, name: str, scenes: str | list[int] = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels with points, ground truth and covered sweeps of a bake, of all scenes or of those named."""
    return tuple(select_scenes(spark.table(f"{name}_{part}"), scenes) for part in ("labels", "gt", "sweeps"))
