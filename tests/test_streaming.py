"""Streams: order, lateness, readiness, bounded state and history, restarts; labels equal those of the batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftcloud import fixtures
from driftcloud.params import COARSE, Params
from driftcloud.plans.labelling import Scene
from driftcloud.streaming import buffer
from driftcloud.streaming.labeller import BLOCK, StreamLabeller

SF = "/root/testdata/sf0.001"
P = Params(grid=COARSE, init_sweeps=3, mcc_sweeps=3)
POINTS = "scene_id long, sweep_idx int, point_idx int, ts_us long, x double, y double, z double"
KEY = ["scene_id", "sweep_idx", "point_idx", "label"]


def sweep(scene, idx, n=3, first=0, ts=None):
    return [(scene, idx, first + k, 1000 * idx if ts is None else ts, float(idx), float(k), 0.5) for k in range(n)]


class Source:
    """One file of rows is one batch; ``run`` takes what is new through ``in_order`` and returns what left."""

    def __init__(self, spark, folder, **params):
        self.spark, self.folder, self.params, self.n, self.batches = spark, str(folder), params, 0, []
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", buffer._ROCKS)

    def add(self, rows):
        self.spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.n += 1
        time.sleep(0.02)  # files are taken by their time

    def stream(self):
        return self.spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def run(self, stop_after=None, wait=0, until="expired"):
        def take(batch, batch_id):
            self.batches.append(batch.collect())
            if stop_after is not None and len(self.batches) >= stop_after:
                raise RuntimeError("stopped on purpose")

        writer = buffer.in_order(self.stream(), P, **self.params).writeStream.foreachBatch(take).option("checkpointLocation", f"{self.folder}/cp")
        query = (writer.trigger(processingTime="200 milliseconds") if wait else writer.trigger(availableNow=True)).start()
        if wait:
            end = time.time() + wait
            while time.time() < end and not any(r.kind == f"report {until}" for b in self.batches for r in b):
                time.sleep(0.3)
            query.stop()
        elif stop_after is None:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="stopped on purpose"):
                query.awaitTermination()
        return query


def reports(batches):
    return [(r.kind[7:], r.scene_id, r.sweep_idx, r.n) for b in batches for r in b if r.kind.startswith("report")]


def left(batch, kind="labelled"):
    return sorted((r.scene_id, r.sweep_idx, r.point_idx) for r in batch if r.kind == kind)


def test_sweeps_leave_in_order_with_what_they_look_back_at(spark, tmp_path):
    s = Source(spark, tmp_path, delay_us=2000)
    for rows in (sweep(0, 1) + sweep(7, 0), sweep(0, 0), sweep(0, 3) + sweep(7, 1), sweep(0, 2, n=1), sweep(0, 2, n=2, first=1), sweep(0, 5), sweep(0, 4), sweep(0, 1, n=2), [(0, 99, None, 9000, None, None, None)]):
        s.add(rows)
    s.run()
    assert reports(s.batches) == [("not_ready", 0, 0, 3), ("not_ready", 0, 1, 3), ("labelled", 0, 2, 3), ("labelled", 0, 3, 3), ("late", 0, 1, 2), ("labelled", 0, 4, 3), ("labelled", 0, 5, 3)]
    with_points = [b for b in s.batches if left(b)]
    assert [sorted({i for _, i, _ in left(b)}) for b in with_points] == [[2, 3], [4, 5]]  # a sweep that came in two parts leaves once, whole
    assert [sorted({i for _, i, _ in left(b, "context")}) for b in with_points] == [[0, 1], [1, 2, 3]]
    assert left(with_points[0])[:3] == [(0, 2, 0), (0, 2, 1), (0, 2, 2)]
    (reason,) = {r.reason for b in s.batches for r in b if r.kind == "report not_ready" and r.sweep_idx == 1}
    assert reason == "sweep 1 has 1 sweeps before it, 2 are needed"


def test_state_is_bounded_and_survives_a_restart(spark, tmp_path):
    s = Source(spark, tmp_path)
    for i in range(12):
        s.add(sweep(0, i) + sweep(1, i, n=2))
    s.run(stop_after=5)
    done = s.batches[:4]  # the fifth failed
    s.batches = []
    query = s.run()
    rows = [x.numRowsTotal for p in query.recentProgress for x in p.stateOperators]
    assert max(rows) <= 2 * (buffer.look_back(P) + 1) + 2  # sweeps, and a clock for each scene
    kinds = reports(done + s.batches)
    assert sorted(kinds) == sorted([("not_ready" if i < 2 else "labelled", c, i, n) for c, n in ((0, 3), (1, 2)) for i in range(12)])
    assert sorted({i for _, i, _ in left(s.batches[-1], "context")}) == [8, 9, 10]


def test_idle_scenes_leave_and_are_forgotten(spark, tmp_path):
    s = Source(spark, tmp_path, delay_us=10_000, idle_ms=1500)
    s.add(sweep(0, 0) + sweep(0, 1) + sweep(0, 2))
    s.run(wait=60)
    assert reports(s.batches) == [("not_ready", 0, 0, 3), ("not_ready", 0, 1, 3), ("labelled", 0, 2, 3), ("expired", 0, 2, 3)]
    s.add(sweep(0, 1))
    s.batches = []
    s.run(wait=60, until="late")
    assert reports(s.batches)[0] == ("late", 0, 1, 3)


def test_out_of_order_stream_equals_batch(spark, tmp_path):
    """Files in any order, a sweep in two files, a late part: the labels are those of the whole."""
    points, sweeps = fixtures.points(spark, SF).where("sweep_idx < 5"), fixtures.sweeps(spark)
    rows = points.join(sweeps.select("scene_id", "sweep_idx", "ts_us"), ["scene_id", "sweep_idx"])
    rows = rows.select(*[c.split()[0] for c in POINTS.split(", ")]).collect()
    parts = {i: [tuple(r) for r in rows if r.sweep_idx == i] for i in range(5)}
    s = Source(spark, tmp_path)
    ends = [(c, None, None, 1_700_000_000_000_000 + c * 1_000_000_000 + 10_000_000, None, None, None) for c in (0, 1)]
    for some in (parts[1], parts[0] + parts[2][:40], parts[3], parts[2][40:] + parts[4], ends, parts[0][:5]):
        random.Random(1).shuffle(some)
        s.add(some)
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    buffer.stream_label_in_order(stream, sweeps, P, f"{tmp_path}/out", f"{tmp_path}/cp", delay_us=200_000).awaitTermination()
    batch = Scene(points, sweeps, P).label_geometric().select(*KEY)
    streamed = spark.read.parquet(f"{tmp_path}/out/labels").select(*KEY)
    assert batch.count() == streamed.count() > 0 and batch.exceptAll(streamed).isEmpty()
    kinds = spark.read.parquet(f"{tmp_path}/out/reports").groupBy("kind").agg(F.count("*").alias("sweeps"), F.sum("n").alias("n")).collect()
    assert {r.kind: r.sweeps for r in kinds} == {"not_ready": 4, "labelled": 6, "late": len({(r[0], r[1]) for r in parts[0][:5]})}
    assert {r.kind: r.n for r in kinds}["late"] == 5


def test_history_stays_bounded(spark, tmp_path):
    """Each batch reads the same few blocks, and older ones are gone."""
    labeller = StreamLabeller(fixtures.sweeps(spark), P, str(tmp_path / "history"), str(tmp_path / "out"))
    schema = "scene_id long, sweep_idx int, point_idx int, x double, y double, z double"
    back = buffer.look_back(P)
    for i in range(3 * BLOCK + 4):
        batch = spark.createDataFrame([(c, i, k, 0.0, 0.0, 0.0) for c in (0, 1) for k in range(2)], schema).coalesce(1)
        near = labeller.remember(batch)
        if i % BLOCK == 3:
            assert sorted({r.sweep_idx for r in near.collect()}) == list(range(max(0, i - back), i + 1))
            files = [f for f in (tmp_path / "history").rglob("*.parquet")]
            assert len(files) <= 2 * (BLOCK + back + 1)
            blocks = {f.parent.name for f in files}
            assert len(blocks) <= 2
    assert near.count() == 2 * 2 * (back + 1)
    labeller.remember(batch)  # repeated
    assert labeller.remember(batch).count() == 2 * 2 * (back + 1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan.split("PartitionFilters")[1][:200]
