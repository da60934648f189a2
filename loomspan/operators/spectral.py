"""Spectral clusters by power iteration on sparse similarities."""

from __future__ import annotations

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.trees import neighbours
from loomspan.sources.stored import dropped, stored


def affinities(rows: DataFrame, k: int = 10, scale: float | None = None) -> DataFrame:
    """(src, dst, weight): Gaussian similarities of each point (pos, v) and its k nearest, each pair once.

    scale: the kernel's width; the median distance of neighbours if None. A weight is 1e-12 at least, so no pair is lost.
    Neighbours and similarities are written once: they are read for the width, and more than once by who iterates over them.
    """
    near = stored(neighbours(rows, k), "near")
    pairs = near.select(F.least("pos", "other").alias("src"), F.greatest("pos", "other").alias("dst"), "d").groupBy("src", "dst").agg(F.min("d").alias("d"))
    width = scale or near.agg(F.percentile_approx("d", 0.5)).first()[0] or 1.0
    out = stored(pairs.select("src", "dst", F.greatest(F.exp(-F.col("d") * F.col("d") / (2 * width * width)), F.lit(1e-12)).alias("weight")), "similarities")
    dropped(near)
    return out


def spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(pos, cluster) of every vertex that has an edge (src, dst, weight above 0, each pair once).

    Powers of the normalised similarities are taken of one vector, which starts from the degrees, so the work of a round is
    that of the edges; its values are then clustered.
    """
    fitted = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", weightCol="weight").assignClusters(edges)
    return fitted.select(F.col("id").alias("pos"), F.col("cluster").cast("long").alias("cluster"))
