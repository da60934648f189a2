"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks; a source of weight w gives its k-th block (from 0) the release time floor(k / w) and
the deadline ceil((k + 1) / w). Each slot goes to the released block with the earliest deadline, so in every prefix the
count of a source's blocks differs from its share by less than one block. Weights are exact rational numbers. Where they
are whole numbers of slots in a period that is shorter than the phase, the plan of a period repeats; else the plan runs
to the end of the phase and holds a number for each block, which the driver writes in one pass; there are MOST_BLOCKS
and one for each source, at most, whatever the rows.

When a source is used up the schedule goes on with the weights of those that are left: a new phase. Sources of weight
zero come when all others are used up, with equal weights.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.common import named, read

#: Documents of one source in a block, at least, and blocks of all rows, about, at most: beyond, blocks grow with the rows, so the plan does not.
BLOCK, MOST_BLOCKS = 16, 1 << 20
#: Slots of a plan that repeats, at least.
PERIOD = 240
#: Target weights go as the source's document count to this power where none are given.
TEMPERATURE = 0.7
#: Such weights are whole numbers of this part.
PRECISION = 1_000_000
#: Bound of the number of sources; the plan is made for so many at most (two million rows, if each ends a phase).
MOST_SOURCES = 1000
#: Slots of a source in one row of the plan.
CHUNK = 256
#: Rows of a plan that is broadcast; a longer one is joined as a table.
SMALL_PLAN = 100_000


def exact(w: float | Fraction) -> Fraction:
    """The simplest fraction that reads as this number, if its denominator is a billion at most; else its decimal form."""
    if isinstance(w, (int, Fraction)):
        return Fraction(w)
    simple = Fraction(float(w)).limit_denominator(10**9)
    return simple if float(simple) == float(w) else Fraction(repr(float(w)))


def targets(sizes: dict, weights: dict | None) -> dict:
    """The exact weight of each source: zero where none is named; from the sizes if weights is None."""
    if weights is None:
        return {s: Fraction(round(n**TEMPERATURE * PRECISION)) for s, n in sizes.items()}
    return {s: exact(weights.get(s, 0)) for s in sizes}


def shares(weights: dict) -> dict:
    """The weights as whole numbers without a common divisor; weights of which none is above zero count as equal."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if not any(exact.values()):
        exact = dict.fromkeys(weights, Fraction(1))
    over = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * over) for s, w in exact.items()}
    common = gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def schedule(left: dict, share: dict, most: int | None = None) -> dict:
    """The slots of each source, from 0, earliest deadline first among released blocks; ties by position.

    Ends after `most` slots, or before the first slot of a source that has no block left.
    """
    total, place = sum(share.values()), {s: i for i, s in enumerate(share)}
    slots = {s: array("i") for s in share}
    waiting: dict = {}  # by release time
    ready: list = []
    for s in share:
        if share[s]:
            waiting.setdefault(0, []).append((s, 0))
    slot = 0
    while most is None or slot < most:
        for s, k in waiting.pop(slot, ()):
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), place[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        if k == left[s]:
            break
        slots[s].append(slot)
        slot += 1
        # a late block's successor may be released already
        waiting.setdefault(max(slot, (k + 1) * total // share[s]), []).append((s, k + 1))
    return slots


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> list[tuple]:
    """Rows (phase, start, source, slots of the source, length, base, until): each phase's plan until all blocks are used.

    A phase ends with the last slot before some source has no block left. Its blocks of a source are those from base
    to until; start counts the slots of earlier phases. The plan's `length` slots repeat.
    """
    left, used, rows, start, phase = dict(blocks), dict.fromkeys(blocks, 0), [], 0, 0
    while left := {s: n for s, n in left.items() if n > 0}:
        share = shares({s: weights[s] for s in left})
        length = sum(share.values()) * -(-period // sum(share.values()))
        quota = {s: w * length // sum(share.values()) for s, w in share.items()}
        rounds = min(left[s] // q for s, q in quota.items() if q)
        if rounds:
            slots = schedule(quota, share, length)
            spare = {s: left[s] - rounds * quota[s] for s in left}
            # the slot of the first block that is not there; none is missing before it
            stop = min((slots[s][spare[s]] for s in left if quota[s] and spare[s] < quota[s]), default=length)
            took = {s: rounds * quota[s] + sum(i < stop for i in slots[s]) for s in left}
        else:
            slots = schedule(left, share)
            took = {s: len(x) for s, x in slots.items()}
            stop = length = sum(took.values())
        rows += [(phase, start, s, slots[s], length, used[s], used[s] + took[s]) for s in left if took[s]]
        start += rounds * length + stop if rounds else stop
        for s in left:
            used[s] += took[s]
            left[s] -= took[s]
        phase += 1
    return rows


def ranked(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(_row, src, at): each row of docs, its source, and its place in the source by md5 of the id.

    Places are counted in 4,096 slices of a source by the hash's first digits, so a source that holds a third of all
    rows is counted by as many tasks as any other; slices are then shifted by the sizes of those before.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    salted = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), own.alias("own"), F.md5(own.cast("binary")).alias("salt"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"))
    salted = salted.withColumn("slice", F.substring("salt", 1, 3))
    sizes = salted.groupBy("src", "slice").agg(F.count("*").alias("n"))
    # one row for each slice of a source: the window is bounded by 4,096 rows
    shift = sizes.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).select("src", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    own = salted.withColumn("rn", F.row_number().over(W.partitionBy("src", "slice").orderBy("salt", "own")))
    return own.join(shift, ["src", "slice"]).select("_row", "src", (F.col("before") + F.col("rn") - 1).alias("at"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int | None = None, period: int = PERIOD) -> DataFrame:
    """docs plus block, phase, slot and place (order inside the block): a total plan for every row, none dropped.

    weights: target shares by source, of any sum; a source that is not named has weight zero and comes when those that
    are named are used up. If None, each gets its document count to the power TEMPERATURE. block: documents in a block;
    if None, BLOCK, or as many as keep the blocks at MOST_BLOCKS. Columns of docs that have one of the new names, in any
    case, are replaced, others are passed through, whatever their names. Null and empty sources are one source. Rows with equal
    ids are ordered arbitrarily among themselves; rows of null ids count as of empty ones. Texts are not read. An empty
    table gives an empty table. Only one number for each source (MOST_SOURCES at most) reaches the driver; the plan it
    makes has four bytes for each block at most.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")).agg(F.count("*").alias("n")).orderBy("src").limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["src"]: r["n"] for r in counts}
    block = block or max(BLOCK, -(-sum(sizes.values()) // MOST_BLOCKS))
    target = targets(sizes, weights)
    table = phases({s: -(-n // block) for s, n in sizes.items()}, target, period)
    spark = docs.sparkSession
    # the plan is in chunks: a row of docs meets one row of it and takes one number from there
    pieces = [(phase, s, c, slots[c * CHUNK : (c + 1) * CHUNK]) for phase, _, s, slots, *_ in table for c in range(-(-len(slots) // CHUNK))]
    sent = F.broadcast if len(pieces) <= SMALL_PLAN else lambda df: df
    kinds = pa.schema([("phase", pa.int32()), ("src", pa.string()), ("chunk", pa.int32()), ("at_slots", pa.list_(pa.int32()))])
    chunks = spark.createDataFrame(pa.table([pa.array([p[i] for p in pieces], kinds.types[i]) for i in range(4)], schema=kinds), "phase int, src string, chunk int, at_slots array<int>")
    by_source: dict = {}
    for phase, start, s, slots, length, base, until in table:
        by_source.setdefault(s, []).append((until, base, phase, len(slots), length, start))
    spans = spark.createDataFrame(list(by_source.items()), "src string, spans array<struct<until: long, base: long, phase: int, quota: long, slots: long, start: long>>")
    placed = ranked(docs, id_col, source_col).withColumn("block", F.floor(F.col("at") / block)).withColumn("place", (F.col("at") % block).cast("int"))
    placed = placed.join(F.broadcast(spans), "src").withColumn("span", F.element_at(F.filter("spans", lambda x: x["until"] > F.col("block")), 1)).drop("spans")
    inside = F.col("block") - F.col("span.base")
    placed = placed.withColumn("phase", F.col("span.phase")).withColumn("k", (inside % F.col("span.quota")).cast("int")).withColumn("first", F.col("span.start") + F.floor(inside / F.col("span.quota")) * F.col("span.slots")).drop("span")
    out = placed.withColumn("chunk", F.floor(F.col("k") / CHUNK).cast("int")).join(sent(chunks), ["phase", "src", "chunk"])
    return out.withColumn("slot", F.col("first") + F.get("at_slots", F.col("k") % CHUNK)).select(*(F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("block", "phase", "slot", "place")), "block", "phase", "slot", "place")


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` by default weights; nulls, texts, ties, repeats, empty tables and other columns as in mix."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op7_pfair_mixing": op7_pfair_mixing}
# the schedule slot by slot; t and k count from the phase's start, b are the blocks that are left
ORACLE = {
    "op7_pfair_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS src, coalesce(doc_id::VARCHAR, '') AS own FROM documents),
n AS (SELECT src, count(*) AS n FROM d GROUP BY src),
o AS (SELECT list(src ORDER BY src) AS names, list(round(pow(n, 0.7) * 1000000)::HUGEINT ORDER BY src) AS w, list((n + 15) // 16 ORDER BY src) AS b FROM n),
r AS (
  SELECT 0::BIGINT AS slot, 0 AS phase, 0::HUGEINT AS t, w, list_transform(w, lambda x: 0::HUGEINT) AS k, b, NULL::BIGINT AS pick FROM o WHERE len(w) > 0
  UNION ALL
  SELECT CASE WHEN b[c] = 0 THEN slot ELSE slot + 1 END, CASE WHEN b[c] = 0 THEN phase + 1 ELSE phase END, CASE WHEN b[c] = 0 THEN 0 ELSE t + 1 END,
         CASE WHEN b[c] = 0 THEN list_transform(w, lambda x, i: CASE WHEN b[i] > 0 THEN x ELSE 0 END) ELSE w END,
         list_transform(k, lambda x, i: CASE WHEN b[c] = 0 THEN 0 WHEN i = c THEN x + 1 ELSE x END),
         list_transform(b, lambda x, i: CASE WHEN i = c AND x > 0 THEN x - 1 ELSE x END),
         CASE WHEN b[c] > 0 THEN c END
  FROM (SELECT *, list_sort(list_filter(list_transform(w, lambda x, i: CASE WHEN x > 0 AND k[i] * a // greatest(x, 1) <= t
                    THEN {'d': ((k[i] + 1) * a + x - 1) // greatest(x, 1), 'i': i} END), lambda y: y IS NOT NULL))[1].i AS c
        FROM (SELECT *, list_sum(w)::HUGEINT AS a FROM r WHERE list_sum(b) > 0))),
p AS (SELECT names[pick] AS src, phase, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM r, o WHERE pick IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5(own), own) - 1 AS at FROM d)
SELECT doc_id, source, q.at // 16 AS block, phase, slot, (q.at % 16)::INT AS place FROM q JOIN p ON p.src = q.src AND p.block = q.at // 16""",
}
