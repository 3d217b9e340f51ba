"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters outside this class.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows that Spark hands to Python at a time: texts are of very different lengths, so batches stay small.
TEXT_BATCH = 512

_own_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-llm-"))
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` returned, once nothing will read it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = TEXT_BATCH) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows.

    Arrow keeps freed memory for later; a worker that has ended its task waits beside those of other stages and gives it back.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(part for batch in batches for at in range(0, batch.num_rows, rows) if (part := batch.slice(at, rows)).num_rows)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(sliced, schema)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
