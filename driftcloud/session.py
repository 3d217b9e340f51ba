"""Session helpers: a local session for tests and benches, the package's way to executors, and tables written between stages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a table is broadcast by ``lookup``.
LOOKUP_ROWS = 1_000_000
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors once per application, for its pandas and Arrow stages."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="driftcloud-"), "driftcloud_src")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(here), os.path.basename(here)))
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftcloud")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_scratch: dict[str, str] = {}
#: The folder that tables are written to inside ``scratch_scope``.
_scope: ContextVar[str | None] = ContextVar("scratch", default=None)


def _shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="driftcloud-scratch-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without it gets one of its own."""
    return f"{_scope.get() or _shared_folder(spark)}/saved-{uuid.uuid4().hex}"


def saved(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as Parquet below spark.checkpoint.dir and read back, in folders by the values of the columns ``by``."""
    path = scratch_path(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
    out._saved_at = path
    return out


def lookup(df: DataFrame) -> DataFrame:
    """A table that ``saved`` returned, broadcast where it is joined if it has few rows: images are bounded by their pixels, however
    many points fell into them.  A larger one is joined as Spark sees fit.
    """
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df


def unsent(df: DataFrame) -> DataFrame:
    """A table that is joined by sort and merge, never broadcast.

    Spark judges by the size of files, which for a point's numbers is a few bytes a row, and doesn't count what an explode multiplies; a
    table that looks small then passes the driver whole.
    """
    return df.hint("merge")


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any store that Spark reaches; it may be missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``saved`` returned, once nothing will read it any more."""
    delete_path(df.sparkSession, df._saved_at)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is ``saved`` inside is deleted at the end: for jobs whose result is written out before."""
    folder = f"{_shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        delete_path(spark, folder)
