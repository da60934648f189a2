"""Ordered-sequence operators over rows (id, pos, label, ...). None needs a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by() -> WindowSpec:
    """Positions of a recording in order."""
    return W.partitionBy("id").orderBy("pos")


def runs(df: DataFrame, value: str = "label", id_col: str = "id", pos: str = "pos") -> DataFrame:
    """(id, seg, s, e, label): runs of equal values, seg from 1, e exclusive."""
    w = W.partitionBy(id_col).orderBy(pos)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    seg = df.select(F.col(id_col).alias("id"), F.col(pos).alias("pos"), F.col(value).alias("label"), new.alias("new")).withColumn("seg", F.sum("new").over(by()))
    return seg.groupBy("id", "seg").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.first("label").alias("label"))


def merge_equal(segments: DataFrame) -> DataFrame:
    """(id, seg, s, e, label, merged): adjacent segments of one label joined; merged counts those taken in."""
    w = W.partitionBy("id").orderBy("s")
    new = F.when(F.col("label").eqNullSafe(F.lag("label").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = segments.withColumn("new", new).withColumn("seg", F.sum("new").over(w))
    return out.groupBy("id", "seg").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("label").alias("label"), (F.count("*") - 1).alias("merged"))


def smooth(segments: DataFrame, min_length: int) -> DataFrame:
    """Drops segments of min_length or less between equal neighbours (as they were), then merges; interruptions go to the segment before."""
    w = W.partitionBy("id").orderBy("s")
    short = (F.col("e") - F.col("s") <= min_length) & (F.lag("label").over(w) == F.lead("label").over(w))
    marked = segments.withColumn("short", F.coalesce(short, F.lit(False)))
    kept = marked.withColumn("seg", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(w)).groupBy("id", "seg").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("label", "s").alias("label"), F.sum(F.col("short").cast("long")).alias("interruptions")
    )
    new = F.when(F.col("label") == F.lag("label").over(w), 0).otherwise(1)
    out = kept.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    return out.groupBy("id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("label").alias("label"), F.sum("interruptions").alias("interruptions"))


def join_and_discard(segments: DataFrame, join_len: int, discard_len: int, strict: bool = False) -> DataFrame:
    """(id, s, e): intervals joined over gaps of join_len or less (less than it if strict), then those of discard_len or less dropped (less than it if strict)."""
    w = W.partitionBy("id").orderBy("s")
    gap = F.col("s") - F.lag("e").over(w)
    near = gap < join_len if strict else gap <= join_len
    out = segments.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    out = out.groupBy("id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    size = F.col("e") - F.col("s")
    return out.where(size >= discard_len if strict else size > discard_len).select("id", "s", "e")


def eroded(flag: str, size: int) -> Column:
    """Binary erosion by a flat structure of `size`, zero outside the sequence; the origin is size // 2."""
    lo, hi = -(size // 2), size - 1 - size // 2
    w = by().rowsBetween(lo, hi)
    return F.when(F.count(flag).over(w) == size, F.min(flag).over(w)).otherwise(0)


def dilated(flag: str, size: int) -> Column:
    """Binary dilation by a flat structure of `size`: the mirror of the erosion's reach."""
    lo, hi = -(size - 1 - size // 2), size // 2
    return F.max(flag).over(by().rowsBetween(lo, hi))


def opened_closed(df: DataFrame, flag: str, opening: int, closing: int) -> DataFrame:
    """df plus `opened` and `closed`: opening, then closing of its result."""
    out = df.withColumn("_e", eroded(flag, opening)).withColumn("opened", dilated("_e", opening))
    return out.withColumn("_d", dilated("opened", closing)).withColumn("closed", eroded("_d", closing)).drop("_e", "_d")


def to_positions(segments: DataFrame) -> DataFrame:
    """(id, pos, label): one row for each position of [s, e)."""
    return segments.where("e > s").select("id", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"), "label")


def frame_votes(votes: DataFrame, span: int) -> DataFrame:
    """(id, frame, label, agreed): each row (id, pos, label) votes for frames [pos, pos + span); ties go to the least label."""
    cast = votes.select("id", F.explode(F.sequence("pos", F.col("pos") + span - 1)).alias("frame"), "label").groupBy("id", "frame", "label").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("label")).alias("l")))
    return cast.groupBy("id", "frame").agg(best.alias("b"), F.sum("n").alias("total")).select("id", "frame", (-F.col("b.l")).alias("label"), (F.col("b.n") == F.col("total")).alias("agreed"))


def majority(df: DataFrame, keys: list[str], label: str = "label", pos: str = "pos") -> DataFrame:
    """The commonest label of each group, the first seen of equals."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(pos).alias("p"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("p")).alias("p"), label)).alias("b")).select(*keys, F.col(f"b.{label}").alias(label), F.col("b.n").alias("votes"))


def transitions(df: DataFrame) -> DataFrame:
    """(i, j, n, p): counts of changes from i to j and their share of all changes from i."""
    pairs = df.select(F.col("label").alias("i"), F.lead("label").over(by()).alias("j")).where("i <> j")
    counts = pairs.groupBy("i", "j").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("i")))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def parted(df: DataFrame, column: str, parts: int = 64) -> Column:
    """A number that never falls as the column grows: its place among `parts` - 1 quantiles of it, found in one pass."""
    cuts = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.2 / parts)))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)


def running_totals(df: DataFrame, part: Column, order: list, columns: list[str]) -> DataFrame:
    """df plus before_<c> for each column: its sum over all rows that come before.

    part never falls as the order goes on and has few values: rows are summed inside their part, and parts are shifted by
    the sums of those before, which is a table of one row for each part. No window sees the rows of more than one part.
    """
    cut = df.withColumn("part_", part)
    sums = cut.groupBy("part_").agg(*(F.sum(c).alias(f"sum_{c}") for c in columns))
    earlier, inside = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.orderBy("part_"), W.partitionBy("part_").orderBy(*order)))
    shift = sums.select("part_", *(F.coalesce(F.sum(f"sum_{c}").over(earlier), F.lit(0)).alias(f"shift_{c}") for c in columns))
    out = cut.join(F.broadcast(shift), "part_")
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"shift_{c}")).alias(f"before_{c}") for c in columns))


def with_segments(df: DataFrame) -> DataFrame:
    """df plus seg, the number of its run of equal labels, from 1."""
    new = F.when(F.col("label") == F.lag("label").over(by()), 0).otherwise(1)
    return df.withColumn("new", new).withColumn("seg", F.sum("new").over(by())).drop("new")
