"""Streams that run: tracks with state, rows that come late, runs that fail."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.streaming import streams, tracks

SCHEMA = "id long, pos long, k long, x double, y double, ts timestamp"


def slow(points, reach, stale):
    """The rule read plainly, recording by recording."""
    out, ids = {}, sorted({p[0] for p in points})
    for i in ids:
        free, now, frame, seen, fresh = {}, {}, None, None, 0
        for _, pos, k, x, y, ts in sorted((p for p in points if p[0] == i), key=lambda p: (p[1], p[2])):
            if seen and stale and (ts - seen).total_seconds() > stale:
                free, now = {}, {}
            if pos != frame:
                free, now, frame = now, {}, pos
            near = sorted(((x - a) ** 2 + (y - b) ** 2, t) for t, (a, b) in free.items())
            if near and near[0][0] <= reach**2:
                t = near[0][1]
                del free[t]
            else:
                t, fresh = fresh, fresh + 1
            now[t], seen = (x, y), ts
            out[i, pos, k] = t
    return out


@pytest.fixture(scope="module")
def points():
    rng, at = random.Random(3), datetime(2024, 1, 1)
    out = []
    for i in range(4):
        t = at + timedelta(seconds=i)
        for pos in range(30):
            for k in range(rng.randint(0, 3)):
                t += timedelta(seconds=rng.choice([1, 2, 3, 50 if i else 2]))
                out.append((i, pos, k, rng.uniform(0, 6), rng.uniform(0, 6), t))
    return out


@pytest.mark.parametrize("stale", [None, 20.0])
def test_tracks_of_a_table(spark, points, stale):
    df = spark.createDataFrame(points, SCHEMA).withColumn("at", F.unix_micros("ts") / 1e6)
    assert {(r.id, r.pos, r.k): r.track for r in J.track(df, 2.5, stale).collect()} == slow(points, 2.5, stale)


def test_tracks_of_a_stream(spark, points, tmp_path):
    """Arrivals cut recordings at any row, frames included; what comes after a timer has cleared the state goes on as in the table."""
    order = sorted(points, key=lambda p: p[5])
    cuts = [0, 37, 61, 62, 100, len(order)]
    parts = [spark.createDataFrame(order[a:b], SCHEMA) for a, b in zip(cuts, cuts[1:])]
    out = streams.replayed(parts, lambda p: tracks.tracked(p, 2.5, 20.0, "5 seconds"), str(tmp_path))
    assert {(r.id, r.pos, r.k): r.track for r in out.collect()} == slow(points, 2.5, 20.0)
    state = spark.read.format("statestore").option("stateVarName", "now").load(str(tmp_path / "checkpoint"))
    # the timers have emptied the state of every recording that fell silent before the others ended
    assert state.count() <= 4


def test_late_rows_are_dropped_and_a_failed_batch_is_not_doubled(spark, tmp_path):
    at = datetime(2024, 1, 1)
    e = lambda *minutes: spark.createDataFrame([(m, "x", 1.0, at + timedelta(minutes=m)) for m in minutes], "event_id long, event_type string, value double, ts timestamp")
    arrivals = [e(5, 10), e(200, 20), e(50, 55, 70, 400), e(130, 250, 900)]
    out = streams.replayed(arrivals, streams.windowed, str(tmp_path / "a"))
    # after 200 the mark is 190: 50, 55 and 70 are late and 130 is later than 390; the window of 900 stays open
    assert sorted((r.start, r.n) for r in out.collect()) == [(at, 3), (at + timedelta(hours=3), 1), (at + timedelta(hours=6), 1)]
    out = streams.replayed(arrivals, lambda x: x, str(tmp_path / "b"), lambda n: n in (1, 2))
    assert sorted(r.event_id for r in out.collect()) == sorted([5, 10, 200, 20, 50, 55, 70, 400, 130, 250, 900])
