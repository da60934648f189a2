"""Joins that Spark has no plain word for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_indicator(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join plus _merge: "both" or "left_only"."""
    out = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    return out.withColumn("_merge", F.when(F.col("_there").isNull(), "left_only").otherwise("both")).drop("_there")


def interval_join(samples: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """Samples (id, t, ...) with every segment (id, s, e, ...) that holds them, both ends inclusive.

    Time is cut into bins of `width`, which become a second equality key, so the join is never a nested loop. A
    segment has a row for each bin it touches; width should be about the length of a segment.
    """
    bins = segments.where("e >= s").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    return samples.withColumn("_bin", F.floor(F.col("t") / width)).join(bins, ["id", "_bin"]).where("t >= s AND t <= e").drop("_bin")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left plus the value of the last right row of the key at or before its time (null if none): one sort, no pairs."""
    both = left.select(key, time, *(c for c in left.columns if c not in (key, time)), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(key, time, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(f"{value}_asof", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def nearest_value(df: DataFrame, targets: DataFrame, value: str, order: str) -> DataFrame:
    """For each target, the row whose value is nearest, ties by order. targets are few (a parameter table)."""
    pairs = df.crossJoin(F.broadcast(targets))
    return pairs.groupBy("target").agg(F.min(F.struct(F.abs(F.col(value) - F.col("target")).alias("d"), F.col(order).alias(order), F.col(value).alias(value))).alias("b")).select("target", f"b.{order}", f"b.{value}")


def pairs(df: DataFrame, key: str, equal: bool = False) -> DataFrame:
    """All unordered pairs of rows of a small table, columns suffixed _a and _b."""
    a, b = (df.toDF(*(f"{c}_{s}" for c in df.columns)) for s in "ab")
    return a.join(b, F.col(f"{key}_a") <= F.col(f"{key}_b") if equal else F.col(f"{key}_a") < F.col(f"{key}_b"))


#: Prototypes of a codebook that is broadcast; a larger one is dealt in as many parts.
MOST_BOOK = 4096


def codebook(prototypes: DataFrame) -> DataFrame:
    """One broadcast row, book array<struct<proto, c>>, of a codebook of MOST_BOOK prototypes at most (checked)."""
    n = prototypes.count()
    if n > MOST_BOOK:
        raise ValueError(f"{n} prototypes are more than {MOST_BOOK}")
    return F.broadcast(prototypes.agg(F.array_sort(F.collect_list(F.struct("proto", "c"))).alias("book")))


def nearest_centroid(vectors: DataFrame, prototypes: DataFrame, cosine: bool = False) -> DataFrame:
    """(pos, proto, dist) of the nearest prototype (proto, c), ties by number.

    Each vector looks through the codebook in place: no shuffle. A codebook of more than MOST_BOOK is cut into parts, one
    row each, and the least of the parts is taken, which is one shuffle.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if cosine:
        dist = lambda c: 1 - dot(F.col("v"), c) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(c, c))
    else:
        dist = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    parts = -(-prototypes.count() // MOST_BOOK) or 1
    entry = F.struct("proto", "c")
    books = prototypes.groupBy(F.pmod(F.xxhash64("proto"), F.lit(parts))).agg(F.array_sort(F.collect_list(entry)).alias("book")).select("book")
    both = vectors.crossJoin(F.broadcast(books) if parts == 1 else books)
    best = both.select("pos", F.array_min(F.transform("book", lambda p: F.struct(dist(p["c"]).alias("dist"), p["proto"].alias("proto")))).alias("b"))
    if parts > 1:
        best = best.groupBy("pos").agg(F.min("b").alias("b"))
    return best.select("pos", "b.proto", "b.dist")


class Tracks:
    """The tracks of one recording while its points go by, in order of frame and k: those of the frame before that are still free, and those of the open frame."""

    def __init__(self, fresh: int = 0, pos: int = -1, at: float = 0.0, free: list | None = None, now: list | None = None):
        self.fresh, self.pos, self.at, self.free, self.now = fresh, pos, at, free or [], now or []

    def take(self, pos: int, at: float, x: float, y: float, reach: float, stale: float | None) -> int:
        """The nearest free track within reach (the least number of equals), or a new one. All tracks end when no point came for longer than `stale`, be it in a frame."""
        if stale is not None and at - self.at > stale:
            self.free, self.now = [], []
        if pos != self.pos:
            self.pos, self.free, self.now = pos, self.now, []
        self.at = at
        far, best = min((((u - x) ** 2 + (v - y) ** 2, t) for t, u, v in self.free), default=(float("inf"), -1))
        if far > reach * reach:
            best, self.fresh = self.fresh, self.fresh + 1
        self.free = [f for f in self.free if f[0] != best]
        self.now.append((best, x, y))
        return best


def track(df: DataFrame, reach: float, stale: float | None = None) -> DataFrame:
    """Points (id, pos, k, x, y) joined to tracks: each point takes the nearest free track of the frame before within reach, or a new one.

    stale: seconds after which tracks end, by a column at. The order of frames matters, so a recording is one group; its
    points stream through, and only two frames are held. streaming.tracks.tracked does the same for a stream.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held, pdf = Tracks(), pdf.sort_values(["pos", "k"])
        at = pdf["at"] if stale is not None else [0.0] * len(pdf)
        pdf["track"] = [held.take(p, t, x, y, reach, stale) for p, t, x, y in zip(pdf["pos"], at, pdf["x"], pdf["y"], strict=True)]
        return pdf[["id", "pos", "k", "track"]]

    return df.groupBy("id").applyInPandas(one, "id long, pos long, k long, track long")
