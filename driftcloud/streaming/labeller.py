"""Structured Streaming by micro-batches alone: new sweeps meet the stored last sweeps of their scenes.

For streams whose batches hold whole sweeps in order; ``buffer`` puts them in order first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..params import Params
from ..plans.labelling import Scene
from ..session import delete_path, scratch_scope
from .buffer import look_back

#: Sweeps of a scene that share a folder of the history.
BLOCK = 16


class StreamLabeller:
    """Labels new sweeps with the batch operators over new and stored points.

    The history lies in folders by scene and block of sweeps.  A batch reads the blocks of its scenes that its sweeps look
    back at (they are named, so others are not even listed as input) and deletes older ones, so that what is stored and read stays
    bounded whatever the stream's age.  Results go to ``out_path``; a batch that is repeated overwrites its own.
    """

    def __init__(self, sweeps: DataFrame, p: Params, history_path: str, out_path: str):
        self.sweeps, self.p, self.history_path, self.out_path = sweeps, p, history_path.rstrip("/"), out_path

    def remember(self, batch: DataFrame) -> DataFrame:
        """Stores a batch and returns it with the stored points that its sweeps look back at."""
        spark, back = batch.sparkSession, look_back(self.p)
        spans = batch.groupBy("scene_id").agg(F.min("sweep_idx").alias("first"), F.max("sweep_idx").alias("last")).collect()  # a row for each scene of the batch
        block = F.floor(F.col("sweep_idx") / BLOCK).cast("int")
        batch.withColumn("block", block).write.mode("append").partitionBy("scene_id", "block").parquet(self.history_path)
        wanted: dict[tuple[int, int], list[int]] = {}
        for scene, first, last in spans:
            wanted.setdefault(((first - back) // BLOCK, last // BLOCK), []).append(scene)
        stored: Column = F.lit(False)
        for (low, high), scenes in wanted.items():
            stored = stored | (F.col("scene_id").isin(scenes) & F.col("block").between(low, high))
        schema = StructType([*batch.schema.fields, StructField("block", IntegerType())])
        firsts = spark.createDataFrame([(scene, first - back) for scene, first, _ in spans], "scene_id long, first int")
        near = spark.read.schema(schema).parquet(self.history_path).where(stored).drop("block").join(firsts, "scene_id").where("sweep_idx >= first").drop("first")
        for scene, first, _ in spans:
            self._forget(spark, scene, (first - back) // BLOCK)
        # a batch that is repeated stores its points again
        return near.dropDuplicates(["scene_id", "sweep_idx", "point_idx"]).select(*batch.columns)

    def _forget(self, spark, scene: int, first: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.history_path}/scene_id={scene}")
        for status in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at):
            name = status.getPath().getName()
            if name.startswith("block=") and int(name.removeprefix("block=")) < first:
                delete_path(spark, status.getPath().toString())

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with scratch_scope(batch.sparkSession):
            new = batch.select("scene_id", "sweep_idx").distinct()
            labels = Scene(self.remember(batch), self.sweeps, self.p).label_geometric()
            labels.join(new, ["scene_id", "sweep_idx"], "left_semi").write.mode("overwrite").parquet(f"{self.out_path}/batch={batch_id}")


def stream_label(points: DataFrame, sweeps: DataFrame, p: Params, history_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """``points`` is a streaming DataFrame; a batch that is repeated overwrites its own output."""
    return points.writeStream.foreachBatch(StreamLabeller(sweeps, p, history_path, out_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
