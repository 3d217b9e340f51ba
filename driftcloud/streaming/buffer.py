"""Keyed streaming: each scene keeps its last sweeps as state, puts new ones in order and says what it can't label.

State of a scene is one map from sweep to its points: the sweeps that later ones look back at, and those that still wait for
their turn.  A scene has a clock of its own, the latest time it has seen (scenes are recorded at different times, so one
clock for all would call whole scenes late).  A sweep is complete once the clock is ``delay_us`` past its time; complete
sweeps leave in order of time, each with what it looks back at.  Rows of a sweep whose turn is over are late: they are
dropped and counted.  A scene that gets no rows for ``idle_ms`` is complete as it is, and its state goes.

What leaves goes to ``foreachBatch``, where the batch's operators label it: joins of the new sweeps with the few before
them.  A batch so reads nothing but its own rows, whatever the stream's age.  All rows of a scene pass through one task;
scenes are many and a scene's rows come at the pace of its sensor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..params import Params
from ..plans.labelling import Scene
from ..session import scratch_scope

#: What leaves the state: points (of a sweep to be labelled, or of one before it) and reports.
OUT = "kind string, scene_id long, sweep_idx int, ts_us long, point_idx int, x double, y double, z double, n long, reason string"
REPORT = ["scene_id", "sweep_idx", "ts_us", "kind", "n", "reason"]
LABELLED, CONTEXT, NOT_READY, LATE, EXPIRED = "labelled", "context", "not_ready", "late", "expired"
_POINT = np.dtype([("point_idx", "<i4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")])
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def look_back(p: Params) -> int:
    """How many sweeps of a scene are kept for those that follow."""
    return p.look_back


class SceneBuffer(StatefulProcessor):
    def __init__(self, p: Params, delay_us: int, idle_ms: int | None):
        self.keep, self.first_ready, self.delay_us, self.idle_ms = look_back(p), p.init_sweeps - 1, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sweeps = handle.getMapState("sweeps", "sweep_idx int", "ts_us long, points binary")
        # the clock, and the last sweep whose turn is over
        self.progress = handle.getValueState("progress", "clock long, last_idx int, last_ts long")

    def _get(self) -> tuple[int, int, int]:
        return tuple(self.progress.get()) if self.progress.exists() else (-(1 << 62), -1, -(1 << 62))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (scene_id,) = key
        clock, last_idx, last_ts = self._get()
        late: dict[tuple[int, int], int] = {}
        parts: dict[tuple[int, int], list[bytes]] = {}
        for some in rows:
            clock = max(clock, int(some["ts_us"].max()))
            real = some[some["point_idx"].notna()]
            for (sweep_idx, ts_us), of in real.groupby(["sweep_idx", "ts_us"]):
                at = (int(ts_us), int(sweep_idx))
                if at <= (last_ts, last_idx):
                    late[at] = late.get(at, 0) + len(of)
                    continue
                packed = np.empty(len(of), _POINT)
                for c in _POINT.names:
                    packed[c] = of[c].to_numpy()
                parts.setdefault(at, []).append(packed.tobytes())
        for (ts_us, sweep_idx), new in parts.items():
            old = self.sweeps.getValue((sweep_idx,))[1] if self.sweeps.containsKey((sweep_idx,)) else b""
            self.sweeps.updateValue((sweep_idx,), (ts_us, bytes(old) + b"".join(new)))
        for (ts_us, sweep_idx), n in late.items():
            yield self._report(LATE, scene_id, sweep_idx, ts_us, n, "its turn was over")
        yield from self._leave(scene_id, clock, clock - self.delay_us, last_idx, last_ts)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No rows for long: what waits is labelled, and of the state only the clock stays, so that late rows are still known."""
        (scene_id,) = key
        clock, last_idx, last_ts = self._get()
        yield from self._leave(scene_id, clock, clock, last_idx, last_ts)
        held = [k[0] for k in self.sweeps.keys()]
        self.sweeps.clear()
        _, last_idx, last_ts = self._get()
        yield self._report(EXPIRED, scene_id, last_idx, last_ts, len(held), "no rows for too long")

    def _leave(self, scene_id: int, clock: int, until: int, last_idx: int, last_ts: int) -> Iterator[pd.DataFrame]:
        """Sends off the complete sweeps in order, with those before them, and drops what no later sweep looks back at."""
        held = {k[0]: (v[0], v[1]) for k, v in self.sweeps.iterator()}
        ready = sorted((ts, idx) for idx, (ts, _) in held.items() if (last_ts, last_idx) < (ts, idx) and ts <= until)
        asked = [idx for _, idx in ready if idx >= self.first_ready]
        for ts, idx in ready:
            n = len(held[idx][1]) // _POINT.itemsize
            if idx in asked:
                yield self._report(LABELLED, scene_id, idx, ts, n, None)
                yield self._points(LABELLED, scene_id, idx, *held[idx])
            else:
                yield self._report(NOT_READY, scene_id, idx, ts, n, f"sweep {idx} has {idx} sweeps before it, {self.first_ready} are needed")
        if asked:
            for idx in range(min(asked) - self.keep, max(asked)):
                if idx in held and idx not in asked:
                    yield self._points(CONTEXT, scene_id, idx, *held[idx])
        if ready:
            last_ts, last_idx = ready[-1]
            for idx, (ts, _) in held.items():
                if (ts, idx) <= ready[-1] and idx <= last_idx - self.keep:
                    self.sweeps.removeKey((idx,))
        self.progress.update((clock, last_idx, last_ts))

    @staticmethod
    def _report(kind: str, scene_id: int, sweep_idx: int, ts_us: int, n: int, reason: str | None) -> pd.DataFrame:
        return pd.DataFrame({"kind": [f"report {kind}"], "scene_id": [scene_id], "sweep_idx": [sweep_idx], "ts_us": [ts_us], "point_idx": pd.array([None], "Int32"), "x": [None], "y": [None], "z": [None], "n": [n], "reason": [reason]}).astype({c: "float64" for c in "xyz"})

    @staticmethod
    def _points(kind: str, scene_id: int, sweep_idx: int, ts_us: int, points: bytes) -> pd.DataFrame:
        p = np.frombuffer(points, _POINT)
        return pd.DataFrame({"kind": kind, "scene_id": scene_id, "sweep_idx": np.int32(sweep_idx), "ts_us": ts_us, "point_idx": p["point_idx"], "x": p["x"], "y": p["y"], "z": p["z"], "n": pd.array([None] * len(p), "Int64"), "reason": None})

    def close(self) -> None:
        pass


def in_order(points: DataFrame, p: Params, delay_us: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Streaming points (scene_id, sweep_idx, point_idx, ts_us, x, y, z) as complete sweeps with those before them, and reports.

    A row without point_idx only moves its scene's clock, as a sweep without points does.  Needs the RocksDB state store.
    """
    rows = points.where("scene_id is not null and ts_us is not null").select("scene_id", "sweep_idx", "point_idx", "ts_us", "x", "y", "z")
    keyed = rows.groupBy("scene_id")
    return keyed.transformWithStateInPandas(statefulProcessor=SceneBuffer(p, delay_us, idle_ms), outputStructType=OUT, outputMode="append", timeMode="none" if idle_ms is None else "processingTime")


class OrderedLabeller:
    """Labels the sweeps of a batch that ``in_order`` sent; a batch that is repeated overwrites its own output."""

    def __init__(self, sweeps: DataFrame, p: Params, out_path: str):
        self.sweeps, self.p, self.out_path = sweeps, p, out_path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            report = batch.where("kind like 'report %'").withColumn("kind", F.substring("kind", 8, 20)).select(*REPORT)
            report.write.mode("overwrite").parquet(f"{self.out_path}/reports/batch={batch_id}")
            points = batch.where("kind not like 'report %'")
            if points.isEmpty():
                return
            with scratch_scope(batch.sparkSession):
                asked = points.where(F.col("kind") == LABELLED).select("scene_id", "sweep_idx").distinct()
                labels = Scene(points.select("scene_id", "sweep_idx", "point_idx", "x", "y", "z"), self.sweeps, self.p).label_geometric()
                labels.join(asked, ["scene_id", "sweep_idx"], "left_semi").write.mode("overwrite").parquet(f"{self.out_path}/labels/batch={batch_id}")
        finally:
            batch.unpersist()


def stream_label_in_order(points: DataFrame, sweeps: DataFrame, p: Params, out_path: str, checkpoint: str, delay_us: int = 0, idle_ms: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Labels a stream of points below ``out_path``/labels, with a report row for each sweep (and each late part of one) below /reports.

    ``trigger``: arguments of ``DataStreamWriter.trigger``; all that is there, once, if not given.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    writer = in_order(points, p, delay_us, idle_ms).writeStream.foreachBatch(OrderedLabeller(sweeps, p, out_path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
