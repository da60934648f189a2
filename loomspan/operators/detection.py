"""Average precision of detected segments: matching in order of confidence with locked truths, and the area under the interpolated curve."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.sequences import parted
from loomspan.sources.stored import stored

#: Overlaps in hundredths at which a detection may count.
THRESHOLDS = tuple(range(50, 100, 5))


def overlap(s: str, e: str, gs: str, ge: str) -> Column:
    """Temporal intersection over union of two segments that meet."""
    s, e, gs, ge = map(F.col, (s, e, gs, ge))
    both = F.least(e, ge) - F.greatest(s, gs)
    return both / ((e - s) + (ge - gs) - both)


def candidates(pred: DataFrame, truth: DataFrame, keys: list[str], width: float, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(keys, seg, score, gi, iou, least): pairs of a detection and a truth of one key at each threshold that they reach.

    Time bins are part of the join's key, so it never compares all segments of a recording: width should be about a
    segment's length. A pair is met in the bin where its overlap begins.
    """
    bins = lambda df, s, e: df.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    p = bins(pred.where("e > s").select(*keys, "seg", "score", "s", "e"), "s", "e")
    t = bins(truth.where("e > s").select(*keys, F.col("seg").alias("gi"), F.col("s").alias("gs"), F.col("e").alias("ge")), "gs", "ge")
    met = p.join(t, [*keys, "bin_"]).where("s < ge AND gs < e").where(F.floor(F.greatest("s", "gs") / width) == F.col("bin_"))
    reach = F.filter(F.array(*map(F.lit, thresholds)), lambda x: F.col("iou") >= x / 100)
    return met.withColumn("iou", overlap("s", "e", "gs", "ge")).select(*keys, "seg", "score", "gi", "iou", F.explode(reach).alias("least"))


def greedy(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least, seg, gi): each detection, best score first (ties by seg), takes the truth it overlaps most (ties: the later) of those not taken.

    Pairs are sorted by key, threshold, order of the detections and wish, and settled in one pass over the sorted rows: of a
    key at one threshold a task holds the numbers of the truths taken, however long the chains of detections that wait for
    each other are, and whatever runs over the border of a batch.
    """
    one = [*keys, "least"]
    order = [*one, F.desc("score"), "seg", F.desc("iou"), F.desc("gi")]
    dealt = pairs.select(*one, "seg", "gi", "score", "iou").repartition(*one).sortWithinPartitions(*order).select(*one, "seg", "gi")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, taken = None, None, set()
        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in range(len(one))), strict=True)
            won = []
            for i, (key, seg, gi) in enumerate(zip(own, batch.column(len(one)).to_pylist(), batch.column(len(one) + 1).to_pylist(), strict=True)):
                if key != at:
                    at, last, taken = key, None, set()
                if seg != last and gi not in taken:
                    last = seg
                    taken.add(gi)
                    won.append(i)
            yield batch.take(pa.array(won, pa.int64()))

    return dealt.mapInArrow(settle, dealt.schema)


def average_precision(pred: DataFrame, truth: DataFrame, keys: list[str], width: float, by: list[str] | None = None, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(by, least, truths, detections, tp, ap) for every key of `by` that has a truth, at each threshold.

    pred: keys, seg, s, e, score; truth: keys, seg, s, e; seg is unique inside keys. Truths are taken inside keys (a recording
    and a label, say), curves go over `by` (the label alone; all of the keys if None): detections by score, ties by the
    keys and seg. A key with truths and no detection has 0. Curves are summed inside score classes that are then shifted,
    so no window sees all detections of a label.
    """
    by = by or keys
    held = stored(pred.where("e > s").select(*keys, "seg", "s", "e", "score"), "detections")
    won = greedy(candidates(held, truth, keys, width, thresholds), keys).select(*keys, "least", "seg", F.lit(1).alias("tp"))
    # held here: a label that many truths have is one row
    truths = truth.where("e > s").groupBy(*by).agg(F.count("*").alias("truths"))
    classes = held.select(*keys, "seg", "score").withColumn("part", -parted(held, "score"))
    every = classes.withColumn("least", F.explode(F.array(*map(F.lit, thresholds))))
    ranked = every.join(won, [*keys, "least", "seg"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    curve, order = [*by, "least"], [F.desc("score"), *keys, "seg"]
    inside = W.partitionBy(*curve, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # written once: sums, shifts, tops and areas all read these rows
    ranked = stored(ranked.withColumn("k", F.count("*").over(inside)).withColumn("hits", F.sum("tp").over(inside)), "ranked")
    before = W.partitionBy(*curve).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranked.groupBy(*curve, "part").agg(F.count("*").alias("n"), F.sum("tp").alias("t"))
    shift = sums.select(*curve, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"))
    curves = ranked.join(shift, [*curve, "part"]).withColumn("precision", (F.col("hits") + F.col("t")) / (F.col("k") + F.col("n")))
    # the best precision from here on: inside the class, or in a class that comes later
    later = W.partitionBy(*curve).orderBy("part").rowsBetween(1, W.unboundedFollowing)
    tops = curves.groupBy(*curve, "part").agg(F.max("precision").alias("top")).withColumn("top", F.max("top").over(later)).select(*curve, "part", "top")
    # the rows from here on are those before in the turned order, whose maximum runs along; a frame that ends last is scanned anew for each row
    onward = W.partitionBy(*curve, "part").orderBy("score", *(F.desc(c) for c in (*keys, "seg"))).rowsBetween(W.unboundedPreceding, 0)
    smooth = curves.join(tops, [*curve, "part"]).withColumn("best", F.greatest(F.max("precision").over(onward), "top"))
    area = smooth.groupBy(*curve).agg(F.count("*").alias("detections"), F.sum("tp").alias("tp"), F.sum(F.col("tp") * F.col("best")).alias("area"))
    out = truths.withColumn("least", F.explode(F.array(*map(F.lit, thresholds)))).join(area, curve, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*by, "least", "truths", zero("detections").alias("detections"), zero("tp").alias("tp"), (F.coalesce("area", F.lit(0.0)) / F.col("truths")).alias("ap"))
