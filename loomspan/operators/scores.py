"""Scores that compare all with all, on bounded samples or inside cells of a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sample, samples, and rows of a block of one.
SAMPLE, REPEATS, BLOCK = 20_000, 5, 1024


def sampled(rows: DataFrame, most: int = SAMPLE, repeats: int = REPEATS, id_col: str = "pos") -> DataFrame:
    """rows plus sample: each sample holds about `most` of all rows, and of every part of them as many as its share: those whose hashed id falls below the share."""
    share = most / max(rows.count(), 1)
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(k)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = F.filter(F.array(*(F.when(draw(k) < share, k) for k in range(repeats))), lambda x: x.isNotNull())
    return rows.withColumn("sample", F.explode(drawn))


def silhouettes(rows: DataFrame, most: int = SAMPLE, repeats: int = REPEATS, id_col: str = "pos", block: int = BLOCK) -> DataFrame:
    """(sample, n, silhouette): mean silhouettes of samples of all rows (id, label, v).

    A sample is cut into blocks, which are joined block to block; a task adds up the distances of a block's rows to the other's
    by label. So the work is the square of the sample, whatever the rows, and no task holds more than two blocks. A row
    alone in its cluster counts 0, as does a sample of one cluster.
    """
    held = sampled(rows.where("v IS NOT NULL").select(F.col(id_col).alias("pos"), "label", "v"), most, repeats, "pos")
    parts = max(1, -(-min(most, SAMPLE) // block))
    block_of = F.pmod(F.xxhash64("pos"), F.lit(parts)).cast("int")
    blocks = held.groupBy("sample", block_of.alias("block")).agg(F.collect_list(F.struct("pos", "label", "v")).alias("rows"))
    others = blocks.select("sample", F.col("block").alias("other"), F.col("rows").alias("with"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition("sample", "block", "other").join(others, ["sample", "other"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample, own, other in zip(frame["sample"], frame["rows"], frame["with"], strict=True):
                a, b = (np.array([r["v"] for r in x], np.float64) for x in (own, other))
                d = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))
                ids, theirs = np.array([r["pos"] for r in own]), np.array([r["pos"] for r in other])
                d[ids[:, None] == theirs] = 0
                labels, at = np.unique(np.array([r["label"] for r in other]), return_inverse=True)
                sums = d @ np.eye(len(labels))[at]
                own_labels = np.repeat([r["label"] for r in own], len(labels))
                yield pd.DataFrame({"sample": sample, "pos": np.repeat(ids, len(labels)), "label": own_labels, "of": np.tile(labels, len(ids)), "total": sums.reshape(-1), "n": np.tile(np.bincount(at), len(ids))})

    schema = "sample int, pos long, label long, of long, total double, n long"
    sums = pairs.select("sample", "rows", "with").mapInPandas(add, schema).groupBy("sample", "pos", "label", "of").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("of")
    each = sums.groupBy("sample", "pos").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return each.groupBy("sample").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def sample_entropy(rows: DataFrame, m: int = 4, share: float = 0.2, id_col: str = "id", pos: str = "pos", value: str = "value", grid: int = 3) -> DataFrame:
    """(id, near, nearer, entropy): pairs of windows of m values within r of each other in every place, those whose next values are too, and -ln of their share.

    r is `share` of the recording's deviation; windows are those with a next value; entropy is null where a count is 0. Windows
    lie in cells of width r by their first `grid` values and are joined to neighbouring cells only. Equal windows are one
    row with a count, so a sequence of few symbols has as many rows as it has different windows.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(id_col).orderBy(pos)
    x = rows.select(F.col(id_col).alias("id"), *(F.lead(value, k).over(w).cast("double").alias(f"x{k}") for k in range(m + 1)))
    r = rows.groupBy(F.col(id_col).alias("id")).agg((F.stddev_pop(value) * share).alias("r"))
    names = [f"x{k}" for k in range(m + 1)]
    distinct = x.where(F.col(f"x{m}").isNotNull()).groupBy("id", *names).agg(F.count("*").alias("n")).join(r, "id")
    # without deviation all values are equal: one cell
    cell = [F.coalesce(F.floor(F.try_divide(F.col(f"x{k}"), F.col("r"))), F.lit(0)) for k in range(grid)]
    a = distinct.select("id", "r", "n", F.struct(*names).alias("x"), *(c.alias(f"c{k}") for k, c in enumerate(cell)))
    near = a.select("id", F.col("n").alias("k"), F.col("x").alias("y"), *(f"c{k}" for k in range(grid)))
    for k in range(grid):
        near = near.withColumn(f"c{k}", F.explode(F.array(*(F.col(f"c{k}") + d for d in (-1, 0, 1)))))
    within = lambda k: F.abs(F.col(f"x.x{k}") - F.col(f"y.x{k}")) <= F.col("r")
    met = a.join(near, ["id", *(f"c{k}" for k in range(grid))])
    for k in range(m):
        met = met.where(within(k))
    # each unordered pair of different windows once, and the pairs inside a group of equal ones
    times = F.when(F.col("x") < F.col("y"), F.col("n") * F.col("k")).when(F.col("x") == F.col("y"), F.col("n") * (F.col("n") - 1) / 2).otherwise(0).cast("long")
    counts = met.groupBy("id").agg(F.sum(times).alias("near"), F.sum(F.when(within(m), times).otherwise(0)).alias("nearer"))
    out = r.select("id").join(counts, "id", "left").select("id", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("nearer", F.lit(0)).alias("nearer"))
    return out.withColumn("entropy", F.when((F.col("near") > 0) & (F.col("nearer") > 0), -F.log(F.col("nearer") / F.col("near"))))
