"""Engine tables derived from the driver's lineitem table by plain arithmetic (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCENES, SWEEPS = 2, 20
#: A sweep's points are numbered in ranges of l_orderkey that hold about so many of them.
RANGE_ROWS = 1 << 16
SWEEPS_SQL = f"""
select scene_id, cast(sweep_idx as int) as sweep_idx, 1700000000000000 + scene_id * 1000000000 + sweep_idx * 50000 as ts_us,
       sweep_idx % 5 = 0 as is_key_frame, concat('s', cast(scene_id as string), '_', cast(sweep_idx - sweep_idx % 5 as string)) as sample_id,
       cos(0.01D * sweep_idx) as r00, -sin(0.01D * sweep_idx) as r01, 0D as r02, sin(0.01D * sweep_idx) as r10, cos(0.01D * sweep_idx) as r11, 0D as r12,
       0D as r20, 0D as r21, 1D as r22, 0.5D * sweep_idx as tx, 0D as ty, 0D as tz
from (select id div {SWEEPS} as scene_id, id % {SWEEPS} as sweep_idx from range({SCENES * SWEEPS}))
"""
_GLOBAL = {
    "gx": "case when kind < 6 then rw * ca when kind < 8 then rg * ca when kind = 8 then 10D * cm + 2D * (u - 0.5D) else 0.5D * sweep_idx + 1.5D * u * ca end",
    "gy": "case when kind < 6 then rw * sa when kind < 8 then rg * sa when kind = 8 then 10D * sm + 2D * (w - 0.5D) else 1.5D * u * sa end",
    "gz": "case when kind < 6 then -1.5D + 4.5D * w when kind < 8 then -1.8D + 0.02D * w when kind = 8 then -1.5D + 1.5D * u else 0.1D * w end",
}
_POINTS_SQL = """
with k as (
  select l_suppkey % 2 as scene_id, cast(l_orderkey % 20 as int) as sweep_idx,
    cast(row_number() over (partition by l_suppkey % 2, l_orderkey % 20 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as point_idx,
    (l_partkey * 7 + l_linenumber * 3 + l_orderkey) % 10 as kind,
    -3.14159265D + 6.2831853D * ((l_partkey * 2654435 + l_orderkey * 40503 + l_linenumber * 997) % 100003) / 100003.0D as az,
    ((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 10007) / 10007.0D as u,
    ((l_orderkey * 6101 + l_partkey * 15485 + l_linenumber * 577) % 9973) / 9973.0D as w
  from lineitem_fixture),
t as (select *, cos(az) as ca, sin(az) as sa, cos(0.08D * sweep_idx) as cm, sin(0.08D * sweep_idx) as sm, 20D + 3D * cos(3D * az) as rw, 4D + 14D * u as rg,
        cos(0.01D * sweep_idx) as cy, sin(0.01D * sweep_idx) as sy from k),
g as (select * from t GLOBAL)
select scene_id, sweep_idx, point_idx, cy * (gx - 0.5D * sweep_idx) + sy * gy as x, cy * gy - sy * (gx - 0.5D * sweep_idx) as y, gz as z from g
"""
#: The window in it, over a whole sweep.
_NUMBER = "row_number() over (partition by l_suppkey % 2, l_orderkey % 20 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_ANNOTATIONS_SQL = f"""
with s as (select scene_id, sweep_idx, ts_us, sample_id, is_key_frame from sweeps_fixture)
select scene_id, 1L as instance_id, sample_id, ts_us, 10D * cos(0.08D * sweep_idx) as tx, 10D * sin(0.08D * sweep_idx) as ty, -0.75D as tz, 2D as w, 2D as l, 1.5D as h,
       cos(0.04D * sweep_idx) as qw, 0D as qx, 0D as qy, sin(0.04D * sweep_idx) as qz, 'vehicle' as category from s where is_key_frame
union all select scene_id, 2L, sample_id, ts_us, 12D, 0D, -1D, 2D, 4D, 1.6D, cos(0.15D), 0D, 0D, sin(0.15D), 'vehicle' from s where is_key_frame
union all select scene_id, 3L, sample_id, ts_us, -15D, 6D, -1D, 2D, 4D, 1.6D, 1D, 0D, 0D, 0D, 'vehicle' from s where sweep_idx = 10
union all select scene_id, 4L, concat('extra_', cast(scene_id as string), '_', cast(sweep_idx as string)), ts_us, 5D + 0.5D * sweep_idx, -8D, -1D, 2D, 4D, 1.6D, 1D, 0D, 0D, 0D, 'vehicle' from s where sweep_idx < 2
"""


def duck(sql: str) -> str:
    """The same text for DuckDB: plain double literals and its names for types and functions."""
    import re

    sql = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)D\b", r"(\1::double)", sql)
    sql = re.sub(r"(?<![\w.])(\d+)L\b", r"\1::bigint", sql).replace(" div ", " // ").replace("as string", "as varchar")
    return re.sub(r"from range\((\d+)\)", r"from (select range as id from range(\1))", sql)


SWEEPS_DUCK, ANNOTATIONS_DUCK = duck(SWEEPS_SQL), duck(_ANNOTATIONS_SQL).replace("sweeps_fixture", "sweeps")
#: The layer of global points: a lateral list of one in Spark, which computes it once a row; a plain one in DuckDB.
_FENCED = f"lateral view inline(array(named_struct({', '.join(f"'{n}', {e}" for n, e in _GLOBAL.items())}))) as {', '.join(_GLOBAL)}"
_PLAIN = f", lateral (select {', '.join(f'{e} as {n}' for n, e in _GLOBAL.items())})"
POINTS_DUCK = duck(_POINTS_SQL.replace("GLOBAL", _PLAIN)).replace("lineitem_fixture", "lineitem")


def sweeps(spark: SparkSession) -> DataFrame:
    return spark.sql(SWEEPS_SQL)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per lineitem row."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return spark.sql(_POINTS_SQL.replace(_NUMBER, "_number").replace("GLOBAL", _FENCED).replace("lineitem_fixture", "{lineitem}"), lineitem=_numbered(lineitem))


def _numbered(lineitem: DataFrame) -> DataFrame:
    """The rows with ``_number``, which is ``_NUMBER``: the numbers of a sweep's ranges of l_orderkey follow each other, so no task sorts a whole sweep.

    Only the plain columns are shuffled; what a point is made of is computed from them afterwards.
    """
    low, high, n = lineitem.agg(F.min("l_orderkey"), F.max("l_orderkey"), F.count("*")).first()
    width = (high - low) // max(1, n // (SCENES * SWEEPS * RANGE_ROWS)) + 1 if low is not None else 1
    group = ["_scene", "_sweep", "_range"]
    parts = lineitem.withColumns({"_scene": F.expr("l_suppkey % 2"), "_sweep": F.expr("l_orderkey % 20"), "_range": F.floor((F.col("l_orderkey") - F.lit(low or 0)) / width)})
    earlier = Window.partitionBy("_scene", "_sweep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*group).count().select(*[F.col(c).alias(f"{c}_") for c in group], F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy(*group).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ranked = parts.withColumn("_rank", F.row_number().over(order))
    both = ranked.join(F.broadcast(before), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group])
    return both.select(*lineitem.columns, (F.col("_rank") + F.col("_before")).alias("_number"))


def annotations(spark: SparkSession) -> DataFrame:
    return spark.sql(_ANNOTATIONS_SQL.replace("sweeps_fixture", "{s}"), s=sweeps(spark))
