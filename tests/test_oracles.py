"""Registered queries against their DuckDB statements on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from driftcloud.oracles import ORACLE_SQL
from driftcloud.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = ["filter_range", "to_global", "project_spherical", "depth_image", "depth_image_dilated", "unproject_pixel", "adaptive_epsilon", "occlusion_vote", "ransac_ground", "track_velocity", "boxes_asof", "cluster_density", "successive_halving", "hyperband", "event_perpendicular", "label_points"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for table in ("lineitem", "events"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = db.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (want, got))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-9)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
