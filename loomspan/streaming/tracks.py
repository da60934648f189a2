"""Tracks over a stream: the identity of hands from frame to frame, with state that is bounded and ends by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspan.operators.joins import Tracks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACKS = "track array<long>, x array<double>, y array<double>"


class Tracker(StatefulProcessor):
    """State of a recording: the number of the next track, the open frame, and the tracks of two frames at most."""

    def __init__(self, reach: float, stale: float):
        self.reach, self.stale = reach, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "fresh long, pos long, at double")
        self.free = handle.getValueState("free", TRACKS)
        self.now = handle.getValueState("now", TRACKS)

    def held(self) -> Tracks:
        if not self.open.exists():
            return Tracks()
        lists = [list(zip(*s.get(), strict=True)) if s.exists() else [] for s in (self.free, self.now)]
        return Tracks(*self.open.get(), *lists)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held, frame = self.held(), pd.concat(list(rows)).sort_values(["pos", "k"])
        out = [(key[0], p, k, held.take(p, t, x, y, self.reach, self.stale)) for p, k, t, x, y in frame[["pos", "k", "at", "x", "y"]].itertuples(index=False) if p >= held.pos]
        self.open.update((held.fresh, int(held.pos), float(held.at)))
        for state, tracks in ((self.free, held.free), (self.now, held.now)):
            state.update(tuple(list(c) for c in zip(*tracks, strict=True)) if tracks else ([], [], []))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((held.at + self.stale) * 1000) + 1)
        yield pd.DataFrame(out, columns=["id", "pos", "k", "track"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """No point came for so long that every track has ended: only the number of the next one stays."""
        self.free.clear()
        self.now.clear()
        yield pd.DataFrame({"id": [], "pos": [], "k": [], "track": []}).astype("int64")

    def close(self) -> None:
        pass


def rocks(spark: SparkSession) -> None:
    """Processors with several states and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def tracked(points: DataFrame, reach: float, stale: float, late: str = "0 seconds") -> DataFrame:
    """(id, pos, k, track) of a stream of points (id, pos, k, x, y, ts), as joins.track gives them with the same reach and stale.

    Frames of a recording must come in order over the micro-batches; in one they are sorted, and a frame may be split between
    two. A point of a frame before the open one is left out, as is one later than the watermark. A recording's state is
    two frames' tracks, and is cut down to one number `stale` seconds after its last point.
    """
    rocks(points.sparkSession)
    rows = points.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("id").transformWithStateInPandas(Tracker(reach, stale), "id long, pos long, k long, track long", "append", "EventTime")
