"""Kernel statistics of segments by random Fourier features: sums and neighbours instead of a table of all pairs.

For x and y the Gaussian kernel exp(-|x - y|^2 / (2 sigma^2)) is the mean of 2 cos(w x + b) cos(w y + b) over random w and b. With M
features a kernel value has a standard error of 1 / sqrt(M) or less (0.06 for 256), and so has every mean of kernel values
over segments.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import vectors as V

FEATURES = 256
#: 32 bits of a digest as a number between 0 and 1.
PARTS = float(1 << 32)


def uniform(name: str, at: int) -> float:
    return (int(hashlib.md5(name.encode()).hexdigest()[8 * at : 8 * at + 8], 16) + 0.5) / PARTS


def frequencies(dims: int, sigma: float, features: int = FEATURES) -> list[tuple[list[float], float]]:
    """(w, b) of each feature; a component of w is a normal number made of the digest of its names, so everyone draws the same ones."""
    normal = lambda name: math.sqrt(-2 * math.log(uniform(name, 0))) * math.cos(2 * math.pi * uniform(name, 1))
    return [([normal(f"{k}|{j}") / sigma for j in range(dims)], 2 * math.pi * uniform(str(k), 2)) for k in range(features)]


def features(spark: SparkSession, rows: DataFrame, dims: int, sigma: float, n: int = FEATURES) -> DataFrame:
    """rows with z, the features of v. The frequencies are one broadcast row of `n` times `dims` numbers."""
    book = spark.createDataFrame([(frequencies(dims, sigma, n),)], "book array<struct<w: array<double>, b: double>>")
    z = F.transform("book", lambda f: F.cos(V.dot(f["w"], F.col("v")) + f["b"]) * math.sqrt(2 / n))
    return rows.crossJoin(F.broadcast(book)).withColumn("z", z).drop("book")


def segment_means(rows: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """(keys, n, own, mean): a segment's rows, the mean kernel of a row with itself, and the mean of the features; partial sums in each task."""
    mean = Summarizer.mean(array_to_vector(z))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(V.dot(z, z)).alias("own"), mean.alias("mean")).withColumn("mean", vector_to_array("mean"))


def against_neighbours(means: DataFrame, id_col: str = "id", seg: str = "seg") -> DataFrame:
    """means plus mmd and cost_ratio of a segment against the one before and the one after.

    mmd: squared distances of mean features to the neighbours', added up; 0 without neighbours. cost_ratio: the scatter about
    the own mean over that about the neighbours' means, added up; null without neighbours. All kernel values are those of the
    features, that of a row with itself too, so no scatter is below zero.
    """
    w = W.partitionBy(id_col).orderBy(seg)
    near = means.withColumn("before", F.lag("mean").over(w)).withColumn("after", F.lead("mean").over(w))
    own, far = V.dot("mean", "mean"), lambda m: F.col("own") - 2 * V.dot("mean", m) + V.dot(m, m)
    apart = lambda m: F.when(F.col(m).isNull(), 0.0).otherwise(own - 2 * V.dot("mean", m) + V.dot(m, m))
    from_ = lambda m: F.when(F.col(m).isNull(), 0.0).otherwise(far(m))
    near = near.withColumn("mmd", apart("before") + apart("after")).withColumn("about", from_("before") + from_("after"))
    ratio = F.when(F.coalesce("before", "after").isNotNull(), (F.col("own") - own) / (F.col("about") + 1e-12))
    return near.withColumn("cost_ratio", ratio).drop("before", "after", "about")
