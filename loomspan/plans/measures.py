"""Distances of distributions, change-point statistics, scores, densities and tests, as the survey defines them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import vectors as V
from loomspan.operators import detection as D
from loomspan.operators import sequences as S
from loomspan.plans.inventory import folder
from loomspan.plans.registry import query
from loomspan.plans.relational import RUN, SEQ, rnd
from loomspan.plans.vector import EUCLID, KK, VEC, kk, prototypes
from loomspan.sources.tables import blocks, filesystem, sequences, table

#: Values are given in hundredths: whole numbers of them have exact sums.
CENTS = "round(value * 100)::BIGINT"


def cents(c: str = "value") -> Column:
    return F.round(F.col(c) * 100).cast("long")


def spread(n: Column, t: Column, q: Column) -> Column:
    """n times the sum of squares less the squared sum, exact."""
    whole = "decimal(38,0)"
    return (n.cast("decimal(18,0)") * q.cast("decimal(19,0)")).cast(whole) - (t.cast("decimal(19,0)") * t.cast("decimal(19,0)")).cast(whole)


# --- segments ---


@query(f"WITH {RUN}, g AS (SELECT r1.id, r1.seg, sym, {CENTS} AS c, count(*) OVER (PARTITION BY r1.id, r1.seg) AS len FROM r1) SELECT id, seg, sum((sym = 'click')::INT)::BIGINT AS n_click, round(sum(c) / (100e0 * count(*)), 4) AS mean, round(sqrt((count(*) * sum(c * c) - sum(c) * sum(c))::DOUBLE) / count(*) / 100, 4) AS std, round(sum((sym = 'click')::INT) / max(len) * 60, 4) AS freq FROM g GROUP BY GROUPING SETS ((id, seg), (id))")
def agg_gaze_event_features(spark, d):
    """Counts, mean, spread and rate for each segment and each recording, in one pass over whole hundredths."""
    g = S.with_segments(sequences(spark, d)).withColumn("c", cents()).withColumn("len", F.count("*").over(W.partitionBy("id", "seg")))
    n, t, q, clicks = F.count("*"), F.sum("c"), F.sum(F.col("c") * F.col("c")), F.count_if(F.col("sym") == "click")
    return g.groupingSets([["id", "seg"], ["id"]], "id", "seg").agg(clicks.alias("n_click"), rnd(t / (n * 100.0), 4).alias("mean"), rnd(F.sqrt(spread(n, t, q).cast("double")) / n / 100, 4).alias("std"), rnd(clicks / F.max("len") * 60, 4).alias("freq"))


@query(f"WITH {RUN}, g AS (SELECT id, seg, {CENTS} AS c FROM r1) SELECT id, seg, sum(c)::BIGINT AS total_cents, round((count(*) * sum(c * c) - sum(c) * sum(c))::DOUBLE / (count(*) * count(*)) / 10000, 8) AS variance FROM g GROUP BY ALL")
def agg_segment_cost_stats(spark, d):
    """Sum, in hundredths, and variance of the values of each run."""
    g = S.with_segments(sequences(spark, d)).withColumn("c", cents())
    n, t, q = F.count("*"), F.sum("c"), F.sum(F.col("c") * F.col("c"))
    return g.groupBy("id", "seg").agg(t.alias("total_cents"), rnd(spread(n, t, q).cast("double") / (n * n) / 10000, 8).alias("variance"))


@query(f"WITH {RUN}, g AS (SELECT r1.id, r1.seg, r1.pos, value, md5(r1.id::VARCHAR || '-' || r1.pos::VARCHAR || '-47') AS h FROM r1) SELECT g.id, g.seg, round(avg(value), 4) AS mean, max(CASE WHEN pos = r.s + (r.e - r.s) // 2 THEN value END) AS middle, arg_min(value, h) AS random FROM g JOIN r ON r.id = g.id AND r.seg = g.seg GROUP BY g.id, g.seg")
def agg_segment_features(spark, d):
    """Mean, middle and a seeded random element (least hash of its place) of each run."""
    g = S.with_segments(sequences(spark, d))
    h = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.col("pos").cast("string"), F.lit("47")).cast("binary"))
    mid = F.min("pos").over(W.partitionBy("id", "seg")) + F.expr("count(*) over (partition by id, seg) div 2")
    return g.withColumn("mid", mid).withColumn("h", h).groupBy("id", "seg").agg(rnd(F.avg("value"), 4).alias("mean"), F.max(F.when(F.col("pos") == F.col("mid"), F.col("value"))).alias("middle"), F.min_by("value", "h").alias("random"))


@query("WITH g AS (SELECT DISTINCT p_brand FROM part), l AS (SELECT DISTINCT p_type FROM part), n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT g.p_brand, l.p_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.p_brand), 6) AS density FROM g CROSS JOIN l LEFT JOIN n ON n.p_brand = g.p_brand AND n.p_type = l.p_type")
def agg_pooled_counts(spark, d):
    """Counts of each label in each group over the union of the groups' labels, zero where a group lacks one, and densities."""
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    labels = n.agg(F.collect_set("p_type").alias("l"))
    every = n.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"), F.sum("n").alias("total")).join(F.broadcast(labels))
    out = every.select("p_brand", "m", "total", F.explode("l").alias("p_type")).withColumn("n", F.coalesce(F.try_element_at("m", F.col("p_type")), F.lit(0)))
    return out.select("p_brand", "p_type", "n", rnd(F.col("n") / F.col("total")).alias("density"))


# --- order over all rows, without a window over all rows ---


@query(f"WITH {SEQ}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id) SELECT id, coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, sum(n) OVER (ORDER BY id)::BIGINT AS b FROM n")
def win_cumulative_slices(spark, d):
    """Offsets of recordings in the stacked cohort."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return S.running_totals(n, S.parted(n, "id"), ["id"], ["n"]).select("id", F.col("before_n").alias("a"), (F.col("before_n") + F.col("n")).alias("b"))


def stacked(spark, d):
    """(k, id, pos, label, value): the cohort end to end, by recording and place."""
    s = sequences(spark, d).select("id", "pos", "label", "value")
    n = s.groupBy("id").agg(F.count("*").alias("n"))
    first = S.running_totals(n, S.parted(n, "id"), ["id"], ["n"]).select("id", F.col("before_n").alias("first"))
    return s.join(first, "id").select((F.col("first") + F.col("pos")).alias("k"), "id", "pos", "label", "value")


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY id, pos) - 1 AS k, label, value FROM s")
def set_hstack(spark, d):
    """The array columns of all recordings, joined end to end."""
    return stacked(spark, d).select("k", "label", "value")


@query(f"WITH {SEQ}, k AS (SELECT id, pos, label, row_number() OVER (ORDER BY id, pos) - 1 AS k FROM s) SELECT id, string_agg((k % 7)::VARCHAR, '' ORDER BY pos) AS labels FROM k GROUP BY id")
def win_slice_global_labels(spark, d):
    """Labels of the stacked cohort (a rule on the stacked place stands for a model) cut back to one array for each recording."""
    out = stacked(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("k") % 7).cast("string").alias("l"))))["l"].alias("l"))
    return out.select("id", F.array_join("l", "").alias("labels"))


@query("WITH n AS (SELECT user_id, count(*) AS n, md5(user_id::VARCHAR || '47') AS h FROM events GROUP BY user_id), c AS (SELECT *, sum(n) OVER (ORDER BY h, user_id) / sum(n) OVER () AS f FROM n) SELECT user_id, CASE WHEN f <= 0.7 THEN 'train' WHEN f <= 0.85 THEN 'val' ELSE 'test' END AS split FROM c")
def split_by_subject(spark, d):
    """Subjects in hash order until the size is reached."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.col("user_id").cast("string"), F.lit("47")).cast("binary")))
    run = S.running_totals(n, F.conv(F.substring("h", 1, 2), 16, 10).cast("int"), ["h", "user_id"], ["n"]).join(F.broadcast(n.agg(F.sum("n").alias("total"))))
    f = (F.col("before_n") + F.col("n")) / F.col("total")
    return run.select("user_id", F.when(f <= 0.7, "train").when(f <= 0.85, "val").otherwise("test").alias("split"))


@query("WITH k AS (SELECT DISTINCT user_id FROM events) SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS n, (dense_rank() OVER (ORDER BY user_id) - 1) // 5 AS block FROM k")
def ops_snapshot_groups(spark, d):
    k = table(spark, d, "events").select("user_id").distinct().withColumn("one", F.lit(1).cast("long"))
    out = S.running_totals(k, S.parted(k, "user_id"), ["user_id"], ["one"]).select("user_id", F.col("before_one").alias("n"))
    return out.withColumn("block", F.expr("n div 5"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def reshape_unstack(spark, d):
    """A column for every label there is; the names are found first, one row for each."""
    e = table(spark, d, "events")
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    return e.groupBy("user_id").pivot("event_type", names).count().fillna(0)


@query(f"WITH {SEQ}, g AS (SELECT id, list(label ORDER BY pos) AS q FROM s GROUP BY id) SELECT id, i, CASE WHEN i < 128 THEN q[round_even(i * (len(q) - 1) / 127e0, 0)::BIGINT + 1] END AS label, (q || list_transform(range(200 - len(q)), lambda x: 0::BIGINT))[i + 1] AS padded FROM g, (SELECT unnest(range(200)) AS i)")
def reshape_upsample_pad(spark, d):
    """reshape.upsample_nearest and reshape.pad: to 128 places by rounding half to even; all of 200 places, filled with zeros."""
    g = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("q"))
    out = g.withColumn("p", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(200) - F.size("q"), F.lit(0))))).select("id", "q", "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("i"))
    at = F.rint(F.col("i") * (F.size("q") - 1) / F.lit(127.0)).cast("int")
    return out.select("id", "i", F.when(F.col("i") < 128, F.get("q", at)).alias("label"), F.get("p", F.col("i").cast("int")).alias("padded"))


# --- distances on the prototypes (a K x K table in long form) ---

FUSED = KK + ", t AS (SELECT i, j, d AS x, abs(i - j) / 9e0 + 0.01e0 * i AS y FROM k), n AS (SELECT max(x) AS mx, max(y) AS my FROM t)"
KINDS = {
    "additive": ("x / mx + 0.5e0 * y / my", lambda x, y, X, Y: X + 0.5 * Y),
    "multiplicative": ("x * y / (mx * my)", lambda x, y, X, Y: X * Y),
    "normalized_exp": ("1 - exp(-(x / mx + y / my) / 0.7e0)", lambda x, y, X, Y: 1 - F.exp(-(X + Y) / 0.7)),
    "unnormalized_exp": ("1 - exp(-(x + y))", lambda x, y, X, Y: 1 - F.exp(-(x + y))),
    "weighted": ("x / mx * (1 + y)", lambda x, y, X, Y: X * (1 + y)),
    "without": ("x / mx", lambda x, y, X, Y: X),
}


def fused(spark, d):
    t = kk(spark, d).select("i", "j", F.col("d").alias("x"), (F.abs(F.col("i") - F.col("j")) / 9.0 + F.col("i") * 0.01).alias("y"))
    return t.crossJoin(F.broadcast(t.agg(F.max("x").alias("mx"), F.max("y").alias("my"))))


@query(f"WITH {FUSED}, f AS (SELECT i, j, " + ", ".join(f"{e} AS {k}" for k, (e, _) in KINDS.items()) + " FROM t, n) SELECT a.i, a.j, " + ", ".join(f"round((a.{k} + b.{k}) / 2, 6) AS {k}" for k in KINDS) + " FROM f a JOIN f b ON a.i = b.j AND a.j = b.i")
def dist_multimodal_fusion(spark, d):
    """Latent and temporal distances fused in six ways, then made symmetric; the temporal one is not symmetric here."""
    x, y = F.col("x"), F.col("y")
    f = fused(spark, d).select("i", "j", *(e(x, y, x / F.col("mx"), y / F.col("my")).alias(k) for k, (_, e) in KINDS.items()))
    # each row with its mirror: both get the unordered pair as key, so one shuffle of K x K rows
    w = W.partitionBy(F.least("i", "j"), F.greatest("i", "j"))
    return f.select("i", "j", *(rnd(F.avg(k).over(w)).alias(k) for k in KINDS))


@query(f"WITH {FUSED}, g AS (SELECT tau, alpha FROM (SELECT unnest([0.5e0, 1e0, 2e0]) AS tau), (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS alpha)), f AS (SELECT tau, alpha, 1 - exp(-((1 - alpha) * x / mx + alpha * y / my) / tau) AS f FROM t, n, g) SELECT tau, alpha, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(quantile_cont(f, 0.75) - quantile_cont(f, 0.25), 6) AS iqr FROM f GROUP BY ALL")
def dist_sweep(spark, d):
    """Fusion over a grid of temperatures and weights of the temporal distance."""
    grid = spark.createDataFrame([(t, a) for t in (0.5, 1.0, 2.0) for a in (0.0, 0.25, 0.5, 0.75, 1.0)], "tau double, alpha double")
    a = F.col("alpha")
    f = fused(spark, d).crossJoin(F.broadcast(grid)).withColumn("f", 1 - F.exp(-((1 - a) * F.col("x") / F.col("mx") + a * F.col("y") / F.col("my")) / F.col("tau")))
    return f.groupBy("tau", "alpha").agg(rnd(F.avg("f")).alias("mean"), rnd(F.stddev_pop("f")).alias("std"), rnd(F.percentile("f", 0.75) - F.percentile("f", 0.25)).alias("iqr"))


@query(f"WITH {KK}, m AS (SELECT DISTINCT i AS k, i % 3 AS g, i % 4 // 2 AS o FROM k) SELECT 'K' AS level, i AS gi, j AS gj, round(d, 5) AS d FROM k UNION ALL SELECT 'G', a.g, b.g, round(avg(d), 5) FROM k JOIN m a ON a.k = i JOIN m b ON b.k = j GROUP BY a.g, b.g UNION ALL SELECT 'G_opt', a.o, b.o, round(avg(d), 5) FROM k JOIN m a ON a.k = i JOIN m b ON b.k = j GROUP BY a.o, b.o")
def agg_reduce_similarity_matrix(spark, d):
    """agg.reduce_similarity_matrix and dist.latent_space_levels: the distances of K prototypes, and their block means under two maps to groups."""
    k = kk(spark, d)
    m = k.select(F.col("i").alias("k")).distinct().select("k", (F.col("k") % 3).alias("G"), F.floor(F.col("k") % 4 / 2).alias("G_opt"))
    both = k.join(F.broadcast(m.toDF("i", "G_i", "O_i")), "i").join(F.broadcast(m.toDF("j", "G_j", "O_j")), "j")
    level = lambda name, a, b: both.groupBy(F.col(a).alias("gi"), F.col(b).alias("gj")).agg(rnd(F.avg("d"), 5).alias("d")).select(F.lit(name).alias("level"), "gi", "gj", "d")
    return k.select(F.lit("K").alias("level"), F.col("i").alias("gi"), F.col("j").alias("gj"), rnd("d", 5).alias("d")).unionByName(level("G", "G_i", "G_j")).unionByName(level("G_opt", "O_i", "O_j"))


@query(f"WITH {KK}, e AS (SELECT i + 1 AS i, j + 1 AS j, d FROM k), m AS (SELECT i, how, CASE how WHEN 'min' THEN min(d) WHEN 'mean' THEN avg(d) WHEN 'max' THEN max(d) ELSE 1e0 END AS d FROM e, (SELECT unnest(['min', 'mean', 'max', 'constant']) AS how) GROUP BY i, how), h AS (SELECT DISTINCT how FROM m) SELECT how, i, j, round(d, 5) AS d FROM e, h UNION ALL SELECT how, i, 0, round(d, 5) FROM m UNION ALL SELECT how, 0, i, round(d, 5) FROM m UNION ALL SELECT how, 0, 0, 0 FROM h")
def dist_fg_bg_augment(spark, d):
    """A background row and column by least, mean and greatest distance, or a constant."""
    e = kk(spark, d).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "d")
    zero, how = F.lit(0).cast("long"), spark.createDataFrame([("min",), ("mean",), ("max",), ("constant",)], "how string")
    facts = e.groupBy("i").agg(F.min("d").alias("min"), F.avg("d").alias("mean"), F.max("d").alias("max"), F.lit(1.0).alias("constant"))
    m = facts.unpivot(["i"], ["min", "mean", "max", "constant"], "how", "d")
    corner = how.select("how", zero.alias("i"), zero.alias("j"), F.lit(0.0).alias("d"))
    out = e.crossJoin(F.broadcast(how)).select("how", "i", "j", "d").unionByName(m.select("how", "i", zero.alias("j"), "d")).unionByName(m.select("how", zero.alias("i"), F.col("i").alias("j"), "d")).unionByName(corner)
    return out.select("how", "i", "j", rnd("d", 5).alias("d"))


# --- distributions of time ---

TIMES = SEQ + f", g AS (SELECT label, pos::DOUBLE AS t, sum({CENTS})::BIGINT AS w FROM s GROUP BY ALL), c AS (SELECT label, t, (sum(w) OVER (PARTITION BY label ORDER BY t) - w)::DOUBLE / sum(w) OVER (PARTITION BY label) AS lo, sum(w) OVER (PARTITION BY label ORDER BY t)::DOUBLE / sum(w) OVER (PARTITION BY label) AS hi FROM g)"
TRANSPORT = TIMES + ", o AS (SELECT a.label AS i, b.label AS j, sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * (a.t - b.t) * (a.t - b.t)) AS squared, sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * abs(a.t - b.t)) AS w1 FROM c a JOIN c b ON a.label < b.label AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL)"


def transport(spark, d):
    """(i, j, squared, w1): transport costs between the weighted times of all pairs of symbols.

    Both quantile functions are steps, so the cost is a sum over the joint breaks: one window a pair, over distinct times.
    """
    g = sequences(spark, d).withColumn("w", cents()).groupBy("label", F.col("pos").cast("double").alias("t")).agg(F.sum("w").alias("w"))
    w = W.partitionBy("label").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    c = g.select("label", "t", (F.sum("w").over(w).cast("double") / F.sum("w").over(W.partitionBy("label"))).alias("q"))
    names = c.select("label").distinct()
    pairs = names.toDF("i").crossJoin(F.broadcast(names.toDF("j"))).where("i < j")
    ends = c.join(F.broadcast(pairs), F.col("label") == F.col("i")).select("i", "j", "q", F.col("t").alias("a"), F.lit(None).cast("double").alias("b"))
    ends = ends.unionByName(c.join(F.broadcast(pairs), F.col("label") == F.col("j")).select("i", "j", "q", F.lit(None).cast("double").alias("a"), F.col("t").alias("b")))
    order = W.partitionBy("i", "j").orderBy("q")
    after = order.rowsBetween(0, W.unboundedFollowing)
    gap = F.first("a", ignorenulls=True).over(after) - F.first("b", ignorenulls=True).over(after)
    steps = ends.select("i", "j", (F.col("q") - F.coalesce(F.lag("q").over(order), F.lit(0.0))).alias("dq"), gap.alias("gap"))
    return steps.groupBy("i", "j").agg(F.sum(F.col("dq") * F.col("gap") * F.col("gap")).alias("squared"), F.sum(F.col("dq") * F.abs("gap")).alias("w1"))


@query(f"WITH {TRANSPORT} SELECT i, j, round(squared, 5) AS squared, round(sqrt(squared), 5) AS w2, round(w1, 5) AS w1 FROM o")
def dist_wasserstein_1d(spark, d):
    """Transport of the weighted times of each symbol to those of each other one, at squared and at plain distance."""
    return transport(spark, d).select("i", "j", rnd("squared", 5).alias("squared"), rnd(F.sqrt("squared"), 5).alias("w2"), rnd("w1", 5).alias("w1"))


#: Moments and the 101 quantiles of each symbol's weighted times; the linear map of one onto another, turned if their skews differ in sign.
LINEAR = TIMES + """, mo AS (SELECT *, v3 / n3 AS third FROM (SELECT label, sum(w) AS n3, sum(w * t)::DOUBLE / sum(w) AS mean, sum(w * t * t)::DOUBLE / sum(w) - power(sum(w * t)::DOUBLE / sum(w), 2) AS var, sum(w * t * t * t)::DOUBLE - 3 * sum(w * t)::DOUBLE / sum(w) * sum(w * t * t)::DOUBLE + 2 * sum(w) * power(sum(w * t)::DOUBLE / sum(w), 3) AS v3 FROM g GROUP BY label)),
cw AS (SELECT label, t, w, sum(w) OVER (PARTITION BY label ORDER BY t) AS hi, sum(w) OVER (PARTITION BY label) AS total FROM g),
qu AS (SELECT label, k, min(t) AS q FROM cw, range(101) r(k) WHERE hi * 100 >= k * total AND (hi - w) * 100 < k * total OR k = 0 GROUP BY ALL),
lg AS (SELECT a.label AS i, b.label AS j, CASE WHEN a.third * b.third < 0 THEN -1 ELSE 1 END * sqrt(b.var / a.var) AS slope, a.mean AS ma, b.mean AS mb FROM mo a JOIN mo b ON a.label < b.label),
le AS (SELECT i, j, any_value(slope) AS slope, any_value(mb - slope * ma) AS shift, sqrt(sqrt(sum(power(mb + slope * (x.q - ma) - y.q, 2)))) AS error FROM lg JOIN qu x ON x.label = i JOIN qu y ON y.label = j AND y.k = CASE WHEN slope < 0 THEN 100 - x.k ELSE x.k END GROUP BY i, j)"""


def weighted_times(spark, d):
    return sequences(spark, d).withColumn("w", cents()).groupBy("label", F.col("pos").cast("double").alias("t")).agg(F.sum("w").alias("w"))


def linear_gw(g: DataFrame, levels: int = 100) -> DataFrame:
    """(i, j, slope, shift, error) of each pair of weighted densities (label, t, w): the linear Gromov-Wasserstein map and what it leaves.

    In one dimension the map of two densities by their second moments is closed: slope is the ratio of the deviations, below zero if
    the skews differ in sign, and means go to means. error is the root of the distance between the mapped density's quantiles and
    the other's. Moments and quantiles are one pass over the densities; only they are paired. A density without spread has no map.
    """
    w, t = F.col("w"), F.col("t")
    n, a, b, c = (F.sum(x) for x in (w, w * t, w * t * t, w * t * t * t))
    moments = g.groupBy("label").agg((a / n).alias("mean"), (b / n - F.pow(a / n, 2)).alias("var"), (c - 3 * a / n * b + 2 * n * F.pow(a / n, 3)).alias("third"))
    order = W.partitionBy("label").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    run = g.withColumn("hi", F.sum("w").over(order)).withColumn("total", F.sum("w").over(W.partitionBy("label"))).where("w > 0")
    # the first time at which the share of the weight reaches k / levels
    first = F.when(F.col("hi") == w, 0).otherwise(F.expr(f"(hi - w) * {levels} div total") + 1)
    last = F.expr(f"hi * {levels} div total")
    quantiles = run.withColumn("first", first.cast("long")).withColumn("last", last).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    quantiles = quantiles.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "t")))["t"].alias("q"))
    both = moments.where("var > 0").join(quantiles, "label")
    x, y = (both.toDF(*(f"{c}_{s}" for c in both.columns)) for s in "ij")
    slope = F.when(F.col("third_i") * F.col("third_j") < 0, -1).otherwise(1) * F.sqrt(F.col("var_j") / F.col("var_i"))
    pairs = x.join(F.broadcast(y), F.col("label_i") < F.col("label_j")).withColumn("slope", slope)
    gap = F.zip_with(F.when(F.col("slope") < 0, F.reverse("q_i")).otherwise(F.col("q_i")), "q_j", lambda u, v: F.pow(F.col("mean_j") + F.col("slope") * (u - F.col("mean_i")) - v, F.lit(2)))
    error = F.sqrt(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, e: s + e)))
    return pairs.select(F.col("label_i").alias("i"), F.col("label_j").alias("j"), "slope", (F.col("mean_j") - F.col("slope") * F.col("mean_i")).alias("shift"), error.alias("error"))


@query(f"WITH {LINEAR} SELECT i, j, round(slope, 5) AS slope, round(shift, 4) AS shift, round(error, 5) AS error FROM le")
def dist_linear_gw(spark, d):
    """Linear Gromov-Wasserstein maps between the weighted times of all pairs of symbols."""
    return linear_gw(weighted_times(spark, d)).select("i", "j", rnd("slope", 5).alias("slope"), rnd("shift", 4).alias("shift"), rnd("error", 5).alias("error"))


def temporal(spark, d, kind: str, cache: str | None = None) -> DataFrame:
    """(i, j, d) between the time distributions of symbols, by name: `wasserstein`, `moments` or `linear_gw`.

    cache: a folder that keeps one table for each kind; a kind that is there is read, whatever the events.
    """
    path = f"{cache}/{kind}"
    if cache:
        store, at = filesystem(spark, path)
        if store.exists(at):
            return spark.read.parquet(path)
    if kind == "wasserstein":
        out = transport(spark, d).select("i", "j", F.col("squared").alias("d"))
    elif kind == "moments":
        m = sequences(spark, d).groupBy("label").agg(F.avg("pos").alias("m"), F.stddev_pop("pos").alias("s"))
        p = m.toDF("i", "mi", "si").join(F.broadcast(m.toDF("j", "mj", "sj")), F.col("i") < F.col("j"))
        out = p.select("i", "j", (F.pow(F.col("mi") - F.col("mj"), 2) + F.pow(F.col("si") - F.col("sj"), 2)).alias("d"))
    elif kind == "linear_gw":
        out = linear_gw(weighted_times(spark, d)).select("i", "j", F.col("error").alias("d"))
    else:
        raise ValueError(f"no distance {kind}")
    if not cache:
        return out
    out.write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {LINEAR}, o AS (SELECT a.label AS i, b.label AS j, sum((least(a.hi, b.hi) - greatest(a.lo, b.lo)) * (a.t - b.t) * (a.t - b.t)) AS squared FROM c a JOIN c b ON a.label < b.label AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL), x AS (SELECT 'wasserstein' AS kind, i, j, squared AS d FROM o UNION ALL SELECT 'linear_gw', i, j, error FROM le UNION ALL SELECT 'moments', a.label, b.label, (a.m - b.m) * (a.m - b.m) + (a.s - b.s) * (a.s - b.s) FROM (SELECT label, avg(pos) AS m, stddev_pop(pos) AS s FROM s GROUP BY label) a JOIN (SELECT label, avg(pos) AS m, stddev_pop(pos) AS s FROM s GROUP BY label) b ON a.label < b.label), m AS (SELECT kind, median(d) AS med FROM x GROUP BY kind) SELECT x.kind, i, j, round(sqrt(d), 5) AS root, round(exp(-d * d / (2 * med * med)), 6) AS rbf FROM x JOIN m ON m.kind = x.kind")
def dist_temporal_dispatch(spark, d):
    """Three distances of time distributions chosen by name, each computed once and read from the cache after, then made a kernel by root, and by the median off the diagonal."""
    cache, kinds = folder(spark, "temporal"), ("wasserstein", "moments", "linear_gw")
    for kind in kinds:
        temporal(spark, d, kind, cache)
    x = None
    for kind in kinds:
        one = temporal(spark, d, kind, cache).select(F.lit(kind).alias("kind"), "i", "j", "d")
        x = one if x is None else x.unionByName(one)
    m = x.groupBy("kind").agg(F.median("d").alias("med"))
    rbf = F.exp(-F.col("d") * F.col("d") / (2 * F.col("med") * F.col("med")))
    return x.join(F.broadcast(m), "kind").select("kind", "i", "j", rnd(F.sqrt("d"), 5).alias("root"), rnd(rbf).alias("rbf"))


DENSITY = SEQ + ", t AS (SELECT label, pos::DOUBLE / count(*) OVER (PARTITION BY id) AS t, value AS w FROM s), m AS (SELECT label, sum(w) AS sw, sum(w * w) AS sww, sum(w * t) / sum(w) AS mu, min(t) AS lo, max(t) AS hi FROM t GROUP BY label), b AS (SELECT m.label, any_value(sw) AS sw, sqrt(sum(w * (t - mu) * (t - mu)) / any_value(sw) / (1 - any_value(sww / (sw * sw)))) * power(0.75e0 * any_value(sw * sw / sww), -0.2) AS h, any_value(lo) AS lo, any_value(hi) AS hi FROM t JOIN m ON m.label = t.label GROUP BY m.label), x AS (SELECT label, sw, h, size, i, greatest(lo - 3 * h, -0.5e0) + i * (least(hi + 3 * h, 1.5e0) - greatest(lo - 3 * h, -0.5e0)) / (size - 1) AS x FROM b, (SELECT unnest([64, 128]) AS size) z, (SELECT unnest(range(128)) AS i) y WHERE i < size)"


@query(f"WITH {DENSITY} SELECT x.label, size, i, round(any_value(x), 6) AS x, round(sum(w * exp(-0.5e0 * power((x - t) / h, 2))) / any_value(sw * h * sqrt(2 * pi())), 5) AS density FROM x JOIN t ON t.label = x.label GROUP BY x.label, size, i")
def dens_kde(spark, d):
    """Weighted Gaussian density of the times of each symbol, Silverman's width, on grids of 64 and 128 places.

    The grid goes three widths beyond the times, inside (-0.5, 1.5). Rows of one symbol and time are one before they meet it.
    """
    t = sequences(spark, d).select("label", (F.col("pos") / F.count("*").over(W.partitionBy("id"))).alias("t"), F.col("value").alias("w"))
    g = t.groupBy("label", "t").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    m = g.groupBy("label").agg(F.sum("w").alias("sw"), F.sum("ww").alias("sww"), (F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("mu"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    v = g.join(F.broadcast(m), "label").groupBy("label").agg(*(F.first(c).alias(c) for c in ("sw", "sww", "lo", "hi")), F.sum(F.col("w") * (F.col("t") - F.col("mu")) * (F.col("t") - F.col("mu"))).alias("ss"))
    sw, sww = F.col("sw"), F.col("sww")
    b = v.withColumn("h", F.sqrt(F.col("ss") / sw / (1 - sww / (sw * sw))) * F.pow(0.75 * sw * sw / sww, F.lit(-0.2)))
    lo, hi = F.greatest(F.col("lo") - 3 * F.col("h"), F.lit(-0.5)), F.least(F.col("hi") + 3 * F.col("h"), F.lit(1.5))
    size = F.explode(F.array(F.lit(64), F.lit(128))).alias("size")
    x = b.select("label", "sw", "h", lo.alias("lo"), hi.alias("hi"), size).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    x = x.withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (F.col("size") - 1))
    z = (F.col("x") - F.col("t")) / F.col("h")
    out = g.join(F.broadcast(x), "label").groupBy("label", "size", "i").agg(F.first("x").alias("x"), F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"), F.first(F.col("sw") * F.col("h") * math.sqrt(2 * math.pi)).alias("norm"))
    return out.select("label", "size", "i", rnd("x").alias("x"), rnd(F.col("k") / F.col("norm"), 5).alias("density"))


RATE = 25.0
XCORR = SEQ + f", g AS (SELECT id, pos, 1 AS k, value AS x FROM s UNION ALL SELECT id, pos, 2, label FROM s UNION ALL SELECT id, pos, 3, event_id % 7 FROM s), n AS (SELECT id, k, sqrt(sum(x * x)) AS l FROM g GROUP BY ALL), c AS (SELECT a.id, a.k AS a, b.k AS b, a.pos - b.pos AS lag, sum(a.x * b.x) / any_value(p.l * q.l) AS c FROM g a JOIN g b ON a.id = b.id AND a.k < b.k JOIN n p ON p.id = a.id AND p.k = a.k JOIN n q ON q.id = b.id AND q.k = b.k WHERE p.l > 0 AND q.l > 0 GROUP BY a.id, a.k, b.k, a.pos - b.pos), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, a, b ORDER BY round(c, 9) DESC, lag) = 1)"


def lag_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(lag, score): where the normalised cross-correlation of two signals is greatest, over all lags; the first of equals. By Fourier transform."""
    size = np.linalg.norm(x) * np.linalg.norm(y)
    if not size:
        return np.nan, np.nan
    n = 1 << (len(x) + len(y) - 2).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(y, n)), n) / size if n > 1 else x * y / size
    c = np.round(np.concatenate([c[len(c) - len(y) + 1 :], c[: len(x)]]) if n > 1 else c, 9)
    k = int(c.argmax())
    return float(k - len(y) + 1), float(c[k])


@query(f"WITH {XCORR}, o AS (SELECT id, max(lag) FILTER (a = 1 AND b = 2) / 25e0 AS xy, max(lag) FILTER (a = 2 AND b = 3) / 25e0 AS yz, max(lag) FILTER (a = 1 AND b = 3) / 25e0 AS xz, max(c) FILTER (a = 1 AND b = 2) AS score FROM m GROUP BY id) SELECT i.id, xy, yz, xz, round(score, 6) AS score, round(coalesce(abs(xy + yz - xz), 0), 6) AS distortion, coalesce(round(abs(xy + yz - xz), 6) <= 1, true) AS consistent FROM (SELECT DISTINCT id FROM s) i LEFT JOIN o ON o.id = i.id")
def dist_xcorr_lag(spark, d):
    """Lags in seconds between three signals of a recording, and whether they add up to within a second.

    A lag is that of the greatest normalised cross-correlation over all lags, positive where the first signal is later.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, x, y, z in zip(f["id"], *(f[c].map(lambda v: np.asarray(v, float)) for c in "xyz"), strict=True):
                (xy, score), (yz, _), (xz, _) = lag_of(x, y), lag_of(y, z), lag_of(x, z)
                out.append((i, xy / RATE, yz / RATE, xz / RATE, score))
            yield pd.DataFrame(out, columns=["id", "xy", "yz", "xz", "score"])

    s = sequences(spark, d).select("id", "pos", F.col("value").alias("x"), F.col("label").cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    # a recording is a row of arrays, so a task takes many of them at a time
    whole = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("r")).select("id", "r.x", "r.y", "r.z")
    out = whole.mapInPandas(run, "id long, xy double, yz double, xz double, score double")
    out = out.select("id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("xy", "yz", "xz", "score")))
    off = rnd(F.abs(F.col("xy") + F.col("yz") - F.col("xz")))
    return out.select("id", "xy", "yz", "xz", rnd("score").alias("score"), F.coalesce(off, F.lit(0.0)).alias("distortion"), F.coalesce(off <= 1, F.lit(True)).alias("consistent"))


# --- change points ---

RISK = SEQ + f", n AS (SELECT id, count(*) AS n FROM s GROUP BY id), b AS (SELECT s.id, k, pos * k // n AS g, n, count(*) AS m, sum({CENTS}) AS t, sum({CENTS} * {CENTS}) AS q FROM s JOIN n ON n.id = s.id, (SELECT unnest(range(1, 21)) AS k) WHERE k <= n GROUP BY ALL), r AS (SELECT id, k, sum((m * q - t * t)::DOUBLE / m) / 10000 / n AS y FROM b GROUP BY id, k, n), z AS (SELECT id, k, y FROM r QUALIFY k >= 0.6e0 * max(k) OVER (PARTITION BY id))"


def risks(spark, d):
    """(id, k, y): mean squared error of a recording cut into k equal parts, for k from 0.6 of the most parts it can have, 20 at most."""
    s = sequences(spark, d).withColumn("c", cents()).withColumn("n", F.count("*").over(W.partitionBy("id")))
    cut = s.select("id", "pos", "c", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(20).cast("long"), "n"))).alias("k"))
    m, t, q = F.count("*"), F.sum("c"), F.sum(F.col("c") * F.col("c"))
    b = cut.groupBy("id", "k", "n", F.expr("pos * k div n").alias("g")).agg((spread(m, t, q).cast("double") / m).alias("e"))
    r = b.groupBy("id", "k", "n").agg((F.sum("e") / 10000 / F.col("n")).alias("y"))
    return r.withColumn("most", F.max("k").over(W.partitionBy("id"))).where("k >= 0.6D * most").select("id", "k", "y")


@query(f"WITH {RISK}, m AS (SELECT k - avg(k) OVER (PARTITION BY id) AS x, y - avg(y) OVER (PARTITION BY id) AS y FROM z) SELECT round(regr_slope(y, x), 5) AS slope, round(2 * regr_slope(y, x), 5) AS penalty FROM m")
def cpd_slope_heuristic(spark, d):
    """One slope of the risk on the number of segments, with an intercept for each recording; the penalty is twice that."""
    w = W.partitionBy("id")
    m = risks(spark, d).select((F.col("k") - F.avg("k").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    return m.agg(rnd(F.regr_slope("y", "x"), 5).alias("slope"), rnd(F.regr_slope("y", "x") * 2, 5).alias("penalty"))


@query(f"WITH {RISK} SELECT id, round(regr_slope(y, k), 5) AS slope, round(2 * regr_slope(y, k), 5) AS penalty FROM z GROUP BY id")
def cpd_slope_individual(spark, d):
    """cpd.slope_heuristic, a slope for each recording."""
    return risks(spark, d).groupBy("id").agg(rnd(F.regr_slope("y", "k"), 5).alias("slope"), rnd(F.regr_slope("y", "k") * 2, 5).alias("penalty"))


@query(f"WITH {RUN}, o AS (SELECT id, max(e) AS n, count(*) + 1 AS n_cpts, round(count(*) / max(e) * 60, 5) AS cpts_frequency, avg(e - s) AS mean_length FROM r GROUP BY id), b AS (SELECT id, CASE WHEN e - s <= 1 THEN 0 WHEN e - s <= 2 THEN 1 WHEN e - s <= 4 THEN 2 ELSE 3 END AS bin, count(*) AS k FROM r GROUP BY ALL) SELECT o.id, n, n_cpts, cpts_frequency, round(mean_length, 6) AS mean_length, " + ", ".join(f"coalesce(max(k) FILTER (bin = {i}), 0) AS bin_{i}" for i in range(4)) + " FROM o JOIN b ON b.id = o.id GROUP BY ALL")
def cpd_collect_results(spark, d):
    """Counts, frequency and durations of each recording's segments, and how many fall into each bin of durations (to 1, 2, 4 and beyond)."""
    size = F.col("e") - F.col("s")
    bin_ = F.when(size <= 1, 0).when(size <= 2, 1).when(size <= 4, 2).otherwise(3)
    return S.runs(sequences(spark, d)).groupBy("id").agg(F.max("e").alias("n"), (F.count("*") + 1).alias("n_cpts"), rnd(F.count("*") / F.max("e") * 60, 5).alias("cpts_frequency"), rnd(F.avg(size)).alias("mean_length"), *(F.count_if(bin_ == i).alias(f"bin_{i}") for i in range(4)))


# --- clusters ---


@query(f"WITH {VEC}, x AS (SELECT b.id, b.pos, b.label, {EUCLID} AS d FROM b JOIN p ON b.label = p.proto), c AS (SELECT id, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.25) AS first, avg(d) + stddev_pop(d) AS std_1, avg(d) + 2 * stddev_pop(d) AS std_2, 8e0 AS fixed FROM x GROUP BY id), m AS (SELECT label, quantile_cont(d, 0.25) AS mapped FROM x GROUP BY label) SELECT pos, x.label, round(d, 5) AS d, " + ", ".join(f"d <= {k} AS {k}" for k in ("median", "first", "std_1", "std_2", "fixed", "mapped")) + " FROM x JOIN c ON c.id = x.id JOIN m ON m.label = x.label")
def clu_training_residuals(spark, d):
    """Whether a block is within each of six thresholds: of its recording (median, quarter, mean plus one or two deviations), fixed, and of its cluster."""
    x = blocks(spark, d).join(F.broadcast(prototypes(spark, d)), F.col("label") == F.col("proto")).select("id", "pos", "label", V.euclid("v", "c").alias("d"))
    mean, std = F.avg("d"), F.stddev_pop("d")
    c = x.groupBy("id").agg(F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.25).alias("first"), (mean + std).alias("std_1"), (mean + 2 * std).alias("std_2"), F.lit(8.0).alias("fixed"))
    m = x.groupBy("label").agg(F.percentile("d", 0.25).alias("mapped"))
    return x.join(c, "id").join(F.broadcast(m), "label").select("pos", "label", rnd("d", 5).alias("d"), *((F.col("d") <= F.col(k)).alias(k) for k in ("median", "first", "std_1", "std_2", "fixed", "mapped")))


KEYS = ("experiment", "kind", "task", "space", "metric", "method", "normalised")
MODELS = "m AS (SELECT p_partkey, p_brand AS experiment, p_type AS kind, p_size % 2 AS task, p_size % 3 AS space, p_size % 5 AS metric, p_partkey % 2 AS method, p_partkey % 3 AS normalised, p_retailprice AS silhouette, p_size AS k FROM part)"


@query(f"WITH {MODELS}, f AS (SELECT * FROM m WHERE task = 0 AND method = 1 AND normalised <> 2), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY experiment, kind ORDER BY silhouette DESC, p_partkey) = 1) SELECT experiment, kind, p_partkey, k, coalesce(sum(k) OVER (PARTITION BY experiment ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM b")
def clu_select_best(spark, d):
    """Of the models that pass the filter on their seven keys the best of each kind by silhouette, and the offsets of their clusters in an experiment."""
    size, key = F.col("p_size"), F.col("p_partkey")
    m = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("experiment"), F.col("p_type").alias("kind"), (size % 2).alias("task"), (size % 3).alias("space"), (size % 5).alias("metric"), (key % 2).alias("method"), (key % 3).alias("normalised"), F.col("p_retailprice").alias("silhouette"), size.alias("k")
    )
    wanted = {"task": (0,), "method": (1,), "normalised": (0, 1)}  # a key that is not named is free
    for k in KEYS:
        m = m.where(F.col(k).isin(*wanted[k])) if k in wanted else m
    best = S.keep_first(m, ["experiment", "kind"], [F.desc("silhouette"), "p_partkey"])
    before = W.partitionBy("experiment").orderBy("kind").rowsBetween(W.unboundedPreceding, -1)
    return best.select("experiment", "kind", "p_partkey", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("shift"))


@query("WITH r AS (SELECT vec_id % 3 AS round, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT round, label, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM r), c AS (SELECT round, label, dim, avg(x) AS x FROM l GROUP BY ALL), q AS (SELECT round, label, row_number() OVER (ORDER BY round, label) - 1 AS proto FROM (SELECT DISTINCT round, label FROM r WHERE (label + round) % 2 = 0)) SELECT proto, c.round, c.label, dim, round(x, 6) AS x FROM c JOIN q ON q.round = c.round AND q.label = c.label")
def clu_prototype_model(spark, d):
    """The centroids of the clusters that a table of qualifications names, of all rounds, numbered in order.

    The number counts clusters: a window over one row for each.
    """
    r = blocks(spark, d).select((F.col("pos") % 3).alias("round"), "label", "v")
    chosen = r.select("round", "label").distinct().where("(label + round) % 2 = 0")
    q = chosen.withColumn("proto", (F.row_number().over(W.orderBy("round", "label")) - 1).cast("long"))
    c = V.long(r.join(F.broadcast(q), ["round", "label"])).groupBy("proto", "round", "label", "dim").agg(F.avg("x").alias("x"))
    return c.select("proto", "round", "label", F.col("dim").cast("long").alias("dim"), rnd("x").alias("x"))


@query(f"WITH {KK}, x AS (SELECT b.label AS i, avg({EUCLID}) AS s, sum(power({EUCLID}, 2)) AS w, count(*) AS n FROM b JOIN p ON b.label = p.proto GROUP BY b.label), r AS (SELECT k.i, max((a.s + c.s) / k.d) AS r FROM k JOIN x a ON a.i = k.i JOIN x c ON c.i = k.j WHERE k.i <> k.j GROUP BY k.i), g AS (SELECT dim, avg(x) AS m FROM l GROUP BY dim), e AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT sum(n * (e.m - g.m) * (e.m - g.m)) AS b FROM e JOIN g ON g.dim = e.dim) SELECT (SELECT round(avg(r), 5) FROM r) AS davies_bouldin, (SELECT round((any_value(t.b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) FROM x, t) AS calinski_harabasz")
def eval_davies_bouldin(spark, d):
    """eval.silhouette/db/ch: Davies-Bouldin and Calinski-Harabasz; the spread between clusters comes from their centroids and sizes."""
    p = prototypes(spark, d)
    both = blocks(spark, d).join(F.broadcast(p), F.col("label") == F.col("proto")).withColumn("e", V.euclid("v", "c"))
    x = both.groupBy(F.col("label").alias("i")).agg(F.avg("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("w"), F.count("*").alias("n"))
    r = kk(spark, d).where("i <> j").join(F.broadcast(x.select("i", "s")), "i").join(F.broadcast(x.select(F.col("i").alias("j"), F.col("s").alias("t"))), "j").groupBy("i").agg(F.max((F.col("s") + F.col("t")) / F.col("d")).alias("r"))
    of = V.long(p.join(F.broadcast(x.select(F.col("i").alias("proto"), "n")), "proto"), "c")
    n, m = F.col("n"), F.col("x")
    between = of.groupBy("dim").agg((F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("b")).agg(F.sum("b").alias("b"))
    within = x.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ch = between.crossJoin(within).select(rnd(F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    return r.agg(rnd(F.avg("r"), 5).alias("davies_bouldin")).crossJoin(ch)


GROUPED = KK + ", h AS (SELECT i, j, d, exp(-d * d / 2) AS w, i % 3 AS g, j % 3 AS o FROM k), u AS (SELECT g, o, avg(d) AS d, avg(w) AS w FROM h GROUP BY ALL), dg AS (SELECT i, g, sum(w) AS wi FROM h GROUP BY ALL), tt AS (SELECT sum(w) AS t FROM h)"


@query(f"WITH {GROUPED}, db AS (SELECT avg(r) AS x FROM (SELECT a.g, max((s.d + q.d) / a.d) AS r FROM u a JOIN (SELECT g, d FROM u WHERE g = o) s ON s.g = a.g JOIN (SELECT g, d FROM u WHERE g = o) q ON q.g = a.o WHERE a.g <> a.o GROUP BY a.g)), cs AS (SELECT (SELECT avg(d) FROM u WHERE g = o) / (SELECT avg(d) FROM (SELECT g, avg(d) AS d FROM h WHERE g <> o GROUP BY g)) AS x), mm AS (SELECT avg(a.w + b.w - 2 * c.w) AS x FROM u c JOIN (SELECT g, w FROM u WHERE g = o) a ON a.g = c.g JOIN (SELECT g, w FROM u WHERE g = o) b ON b.g = c.o WHERE c.g < c.o), mo AS (SELECT sum(h.w - a.wi * b.wi / t) / any_value(t) AS x FROM h JOIN dg a ON a.i = h.i JOIN dg b ON b.i = h.j, tt WHERE h.g = h.o) SELECT round(db.x, 6) AS kernel_db, round(cs.x, 6) AS cs, round(mm.x, 6) AS mmd, round(mo.x, 6) AS modularity FROM db, cs, mm, mo")
def eval_kernel_mmd_modularity(spark, d):
    """eval.kernel_db, cs, mmd, modularity of three groups of prototypes, all from block means of a distance and its kernel.

    Compactness over separation; mean discrepancy over pairs of groups; modularity of the kernel as a weighted graph.
    """
    h = kk(spark, d).select("i", "j", "d", F.exp(-F.col("d") * F.col("d") / 2).alias("w"), (F.col("i") % 3).alias("g"), (F.col("j") % 3).alias("o"))
    u = h.groupBy("g", "o").agg(F.avg("d").alias("d"), F.avg("w").alias("w"), F.sum("d").alias("sd"), F.count("*").alias("n"))
    own = u.where("g = o").select("g", F.col("d").alias("own_d"), F.col("w").alias("own_w"))
    other = own.toDF("o", "other_d", "other_w")
    pairs = u.where("g <> o").join(F.broadcast(own), "g").join(F.broadcast(other), "o")
    db = pairs.groupBy("g").agg(F.max((F.col("own_d") + F.col("other_d")) / F.col("d")).alias("r")).agg(F.avg("r").alias("db"))
    intra, inter = own.agg(F.avg("own_d").alias("a")), u.where("g <> o").groupBy("g").agg((F.sum("sd") / F.sum("n")).alias("b")).agg(F.avg("b").alias("b"))
    mmd = pairs.where("g < o").agg(F.avg(F.col("own_w") + F.col("other_w") - 2 * F.col("w")).alias("mmd"))
    deg = h.groupBy("i").agg(F.sum("w").alias("wi"))
    mo = h.where("g = o").join(F.broadcast(deg), "i").join(F.broadcast(deg.toDF("j", "wj")), "j").crossJoin(F.broadcast(h.agg(F.sum("w").alias("t"))))
    mo = mo.agg((F.sum(F.col("w") - F.col("wi") * F.col("wj") / F.col("t")) / F.first("t")).alias("mo"))
    all_ = db.crossJoin(intra).crossJoin(inter).crossJoin(mmd).crossJoin(mo)
    return all_.select(rnd("db").alias("kernel_db"), rnd(F.col("a") / F.col("b")).alias("cs"), rnd("mmd").alias("mmd"), rnd("mo").alias("modularity"))


# --- scores of segmentations ---

SHIFTED = RUN + ", f AS (SELECT id, pos, label AS g, lag(label) OVER (PARTITION BY id ORDER BY pos) AS p FROM s), gs AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS seg FROM (SELECT id, pos, g AS label, CASE WHEN g = lag(g) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM f WHERE p IS NOT NULL)), ps AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS seg FROM (SELECT id, pos, p AS label, CASE WHEN p = lag(p) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM f WHERE p IS NOT NULL)), gt AS (SELECT id, seg AS gi, min(pos) AS s, max(pos) + 1 AS e, min(label) AS label FROM gs GROUP BY id, seg), pr AS (SELECT id, seg AS pi, min(pos) AS s, max(pos) + 1 AS e, min(label) AS label FROM ps GROUP BY id, seg), x AS (SELECT pr.id, pi, gi, (least(pr.e, gt.e) - greatest(pr.s, gt.s))::DOUBLE / (greatest(pr.e, gt.e) - least(pr.s, gt.s)) AS iou FROM pr JOIN gt ON pr.id = gt.id AND pr.label = gt.label AND gt.s < pr.e AND pr.s < gt.e), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id, pi ORDER BY iou DESC, gi) = 1), o AS (SELECT unnest([0.1e0, 0.25e0, 0.5e0]) AS overlap), h AS (SELECT id, overlap, gi, pi FROM b, o WHERE iou >= overlap QUALIFY row_number() OVER (PARTITION BY id, overlap, gi ORDER BY pi) = 1), t AS (SELECT id, overlap, count(*) AS tp FROM h GROUP BY ALL), n AS (SELECT g.id, overlap, g.n AS ng, q.n AS np FROM (SELECT id, count(*) AS n FROM gt GROUP BY id) g JOIN (SELECT id, count(*) AS n FROM pr GROUP BY id) q ON q.id = g.id, o), sc AS (SELECT n.id, n.overlap, coalesce(tp, 0) AS tp, np, ng, coalesce(tp, 0)::DOUBLE / nullif(np - 1, 0) AS precision, coalesce(tp, 0)::DOUBLE / nullif(ng - 1, 0) AS recall FROM n LEFT JOIN t ON t.id = n.id AND t.overlap = n.overlap)"
OVERLAPS = (0.1, 0.25, 0.5)


def shifted(spark, d):
    """(truth, prediction): segments of the labels and of the labels one frame before, on the frames that have both."""
    f = sequences(spark, d).select("id", "pos", "label", F.lag("label").over(S.by()).alias("p")).where("p IS NOT NULL")
    gt = S.runs(f.select("id", "pos", "label")).select("id", F.col("seg").alias("gi"), F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gl"))
    return gt, S.runs(f.select("id", "pos", F.col("p").alias("label"))).withColumnRenamed("seg", "pi")


def segment_scores(gt, pr, overlaps=OVERLAPS):
    """(id, overlap, tp, np, ng, precision, recall): a prediction takes the truth of its label that it overlaps most; the first to take one counts.

    Precision and recall are by the number of segments less one; null where there is one segment.
    """
    both = pr.join(gt, "id").where("label = gl AND gs < e AND s < ge")
    x = both.withColumn("iou", (F.least("e", "ge") - F.greatest("s", "gs")) / (F.greatest("e", "ge") - F.least("s", "gs")))
    over = F.explode(F.array(*map(F.lit, overlaps))).alias("overlap")
    best = S.keep_first(x, ["id", "pi"], [F.desc("iou"), "gi"]).select("id", "pi", "gi", "iou", over).where("iou >= overlap")
    tp = S.keep_first(best, ["id", "overlap", "gi"], ["pi"]).groupBy("id", "overlap").agg(F.count("*").alias("tp"))
    n = gt.groupBy("id").agg(F.count("*").alias("ng")).join(pr.groupBy("id").agg(F.count("*").alias("np")), "id").select("id", "ng", "np", over)
    out = n.join(tp, ["id", "overlap"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select("id", "overlap", "tp", "np", "ng", F.try_divide(F.col("tp"), F.col("np") - 1).alias("precision"), F.try_divide(F.col("tp"), F.col("ng") - 1).alias("recall"))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


@query(f"WITH {SHIFTED} SELECT id, overlap, tp, np - tp AS fp, ng - tp AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM sc")
def eval_segment_f1(spark, d):
    """eval.segment_f1 and eval.tiou at three overlaps; the prediction is the labels one frame late."""
    p, r = F.col("precision"), F.col("recall")
    return segment_scores(*shifted(spark, d)).select("id", "overlap", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), rnd(p).alias("precision"), rnd(r).alias("recall"), rnd(f1(p, r)).alias("f1"))


@query(f"WITH {RUN}, n AS (SELECT id, max(e) AS n FROM r GROUP BY id), g AS (SELECT r.id, e AS t FROM r JOIN n ON n.id = r.id WHERE e < n), p AS (SELECT r.id, seg, e + 2 AS t FROM r JOIN n ON n.id = r.id WHERE e + 2 < n AND seg % 3 < 2), m AS (SELECT p.id, p.seg, min(g.t) AS t FROM p JOIN g ON g.id = p.id AND abs(g.t - p.t) < 3 GROUP BY ALL), k AS (SELECT n.id, coalesce(a.tp, 0) AS tp, coalesce(b.n, 0) AS np, coalesce(c.n, 0) AS ng FROM n LEFT JOIN (SELECT id, count(DISTINCT t) AS tp FROM m GROUP BY id) a ON a.id = n.id LEFT JOIN (SELECT id, count(*) AS n FROM p GROUP BY id) b ON b.id = n.id LEFT JOIN (SELECT id, count(*) AS n FROM g GROUP BY id) c ON c.id = n.id) SELECT id, tp, round(tp::DOUBLE / nullif(np, 0), 6) AS precision, round(tp::DOUBLE / nullif(ng, 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(np + ng, 0), 0), 6) AS f1 FROM k")
def eval_timestamp_f1(spark, d):
    """Change points matched within a margin of 3: a predicted one counts for the first true one it is near, and each true one once.

    The last index is no change point. Candidates are joined by the place itself, so the join is of equal keys.
    """
    r = S.runs(sequences(spark, d))
    r = r.withColumn("n", F.max("e").over(W.partitionBy("id")))
    g = r.where("e < n").select("id", F.col("e").alias("t"))
    p = r.where("e + 2 < n AND seg % 3 < 2").select("id", "seg", (F.col("e") + 2).alias("at"))
    near = p.select("id", "seg", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias("t")).join(g, ["id", "t"]).groupBy("id", "seg").agg(F.min("t").alias("t"))
    tp = near.groupBy("id").agg(F.count_distinct("t").alias("tp"))
    n = r.groupBy("id").agg(F.count_if(F.expr("e + 2 < n AND seg % 3 < 2")).alias("np"), F.count_if(F.expr("e < n")).alias("ng")).join(tp, "id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    tp, a, b = F.col("tp"), F.col("np"), F.col("ng")
    return n.select("id", "tp", rnd(F.try_divide(tp, a)).alias("precision"), rnd(F.try_divide(tp, b)).alias("recall"), rnd(F.coalesce(F.try_divide(tp * 2.0, a + b), F.lit(0.0))).alias("f1"))


def greedy_sql(pred: str, truth: str, by: str) -> str:
    """CTEs that match the detections of `pred` to the truths of `truth` one after another, and the curve of each key `by`."""
    return f"""th AS (SELECT 50 + 5 * x AS least FROM range(10) r(x)),
pp AS (SELECT p.id, p.label, p.seg, p.score, g.seg AS gi, (least(p.e, g.e) - greatest(p.s, g.s))::DOUBLE / ((p.e - p.s) + (g.e - g.s) - (least(p.e, g.e) - greatest(p.s, g.s))) AS iou FROM {pred} p JOIN {truth} g ON g.id = p.id AND g.label = p.label AND p.s < g.e AND g.s < p.e),
cc AS (SELECT id, label, least, seg, any_value(score) AS score, list(gi ORDER BY iou DESC, gi DESC) AS c FROM pp JOIN th ON iou >= least / 100e0 GROUP BY ALL),
cn AS (SELECT *, row_number() OVER (PARTITION BY id, label, least ORDER BY score DESC, seg) AS n FROM cc),
gr AS (SELECT DISTINCT id, label, least, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS seg, NULL::BIGINT AS got FROM cn
  UNION ALL SELECT id, label, least, n, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, seg, got FROM (SELECT cn.id, cn.label, cn.least, cn.n, gr.taken, cn.seg, list_filter(cn.c, lambda x: NOT list_contains(gr.taken, x))[1] AS got FROM gr JOIN cn ON cn.id = gr.id AND cn.label = gr.label AND cn.least = gr.least AND cn.n = gr.n + 1)),
ev AS (SELECT p.id, p.label, p.seg, p.score, th.least, (w.got IS NOT NULL)::INT AS tp FROM {pred} p CROSS JOIN th LEFT JOIN (SELECT * FROM gr WHERE got IS NOT NULL) w ON w.id = p.id AND w.label = p.label AND w.seg = p.seg AND w.least = th.least),
cu AS (SELECT *, (sum(tp) OVER w)::DOUBLE / count(*) OVER w AS prec FROM ev WINDOW w AS (PARTITION BY {by}, least ORDER BY score DESC, id, label, seg)),
sm AS (SELECT *, max(prec) OVER (PARTITION BY {by}, least ORDER BY score DESC, id, label, seg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM cu),
ar AS (SELECT {by}, least, count(*) AS detections, sum(tp)::BIGINT AS tp, sum(tp * best) AS area FROM sm GROUP BY ALL),
nt AS (SELECT {by}, count(*) AS truths FROM {truth} GROUP BY ALL),
ap AS (SELECT nt.*, th.least, coalesce(detections, 0) AS detections, coalesce(tp, 0) AS tp, coalesce(area, 0) / truths AS ap FROM nt CROSS JOIN th LEFT JOIN ar USING ({by}, least))"""


@query(f"WITH RECURSIVE {SHIFTED}, dp AS (SELECT id, label, pi AS seg, s, e, 1e0 AS score FROM pr WHERE label <> 0), dg AS (SELECT id, label, gi AS seg, s, e FROM gt WHERE label <> 0), {greedy_sql('dp', 'dg', 'id, label')}, k AS (SELECT g AS label, count(*) FILTER (g = p) AS tp, count(*) AS n FROM f WHERE p IS NOT NULL GROUP BY g), q AS (SELECT p AS label, count(*) AS m FROM f WHERE p IS NOT NULL GROUP BY p), ed AS (SELECT avg(100 * (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)))) AS x FROM (SELECT id, string_agg(label::VARCHAR, '' ORDER BY gi) AS a FROM gt GROUP BY id) u JOIN (SELECT id, string_agg(label::VARCHAR, '' ORDER BY pi) AS b FROM pr GROUP BY id) w ON w.id = u.id), ff AS (SELECT avg(2 * precision * recall / nullif(precision + recall, 0)) AS x FROM (SELECT overlap, sum(tp)::DOUBLE / sum(np) AS precision, sum(tp)::DOUBLE / sum(ng) AS recall FROM sc GROUP BY overlap)) SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(avg(2e0 * tp / (n + m)), 6) AS macro_f1, round(avg(tp::DOUBLE / (n + m - tp)), 6) AS jaccard, (SELECT round(x, 5) FROM ed) AS edit, (SELECT round(x, 6) FROM ff) AS f1_at_3, (SELECT round(avg(a), 6) FROM (SELECT avg(ap) AS a FROM ap GROUP BY id)) AS map FROM k JOIN q ON k.label = q.label")
def eval_frame_scores(spark, d):
    """Accuracy, macro F1 and Jaccard of frames, mean edit score of the segments' labels (one digit each), mean F1 at three overlaps, mean of the recordings' mAP at ten."""
    c = sequences(spark, d).select(F.col("label").alias("g"), F.lag("label").over(S.by()).alias("p")).where("p IS NOT NULL").groupBy("g", "p").agg(F.count("*").alias("c"))
    n = c.groupBy(F.col("g").alias("label")).agg(F.sum(F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"), F.sum("c").alias("n"))
    k = n.join(c.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("m")), "label")
    tp, n, m = F.col("tp"), F.col("n"), F.col("m")
    frames = k.agg(rnd(F.sum(tp) / F.sum(n)).alias("accuracy"), rnd(F.avg(tp * 2 / (n + m))).alias("macro_f1"), rnd(F.avg(tp / (n + m - tp))).alias("jaccard"))
    gt, pr = shifted(spark, d)
    text = lambda df, i, x, name: df.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(i, F.col(x).cast("string").alias("l"))))["l"], "").alias(name))
    names = text(gt, "gi", "gl", "a").join(text(pr, "pi", "label", "b"), "id")
    edit = names.agg(rnd(F.avg(100 * (1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")))), 5).alias("edit"))
    each = segment_scores(gt, pr).groupBy("overlap").agg((F.sum("tp") / F.sum("np")).alias("p"), (F.sum("tp") / F.sum("ng")).alias("r"))
    three = each.agg(rnd(F.avg(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))).alias("f1_at_3"))
    # every label but the background has one curve a recording and overlap; equal confidences, so order is that of time
    found = pr.where("label <> 0").select("id", "label", F.col("pi").alias("seg"), "s", "e", F.lit(1.0).alias("score"))
    true = gt.where("gl <> 0").select("id", F.col("gl").alias("label"), F.col("gi").alias("seg"), F.col("gs").alias("s"), F.col("ge").alias("e"))
    each = D.average_precision(found, true, ["id", "label"], 4).groupBy("id").agg(F.avg("ap").alias("ap"))
    return frames.crossJoin(edit).crossJoin(three).crossJoin(each.agg(rnd(F.avg("ap")).alias("map")))


# --- tests ---

#: The coefficients of the Chebyshev fit of the complementary error function (error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5e0 * ({x})))"
    poly = f"{ERFC[-1]}e0"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def erfc(x: Column) -> Column:
    """The complementary error function of a number that is not negative."""
    t, poly = 1 / (1 + 0.5 * x), F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


MWU = "t AS (SELECT event_type AS g, value FROM events), k AS (SELECT a.g AS a, b.g AS b, t.g, t.value FROM (SELECT DISTINCT g FROM t) a JOIN (SELECT DISTINCT g FROM t) b ON a.g < b.g JOIN t ON t.g = a.g OR t.g = b.g), r AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY value) + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2e0 AS rk FROM k), ties AS (SELECT a, b, sum(c * c * c - c) AS t FROM (SELECT a, b, value, count(*)::DOUBLE AS c FROM k GROUP BY ALL) GROUP BY a, b), u AS (SELECT a, b, sum(rk) FILTER (g = a) - (count(*) FILTER (g = a)) * (count(*) FILTER (g = a) + 1) / 2e0 AS u, (count(*) FILTER (g = a))::DOUBLE AS n, (count(*) FILTER (g = b))::DOUBLE AS m FROM r GROUP BY a, b), z AS (SELECT u.*, greatest(abs(u - n * m / 2) - 0.5, 0) / sqrt(n * m / 12 * (n + m + 1 - ties.t / ((n + m) * (n + m - 1)))) AS z FROM u JOIN ties ON ties.a = u.a AND ties.b = u.b)"


@query(f"WITH {MWU}, p AS (SELECT *, least(1, {erfc_sql('z / sqrt(2e0)')}) AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS tests FROM p) SELECT a, b, round(u, 1) AS u, round(1 - 2 * u / (n * m), 6) AS rank_biserial, round(z, 5) AS z, round(p, 5) AS p, round(least(min(p * tests / k) OVER (ORDER BY p, a, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 5) AS q FROM o")
def stat_mwu(spark, d):
    """Mann-Whitney U of every pair of groups: normal approximation with ties and continuity corrected, Benjamini-Hochberg over the pairs.

    U needs only how many values of the other group lie below each value. These counts are running totals over distinct
    values, in parts by quantile. Groups are few; the last window sees one row for each pair.
    """
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value")
    names = [r["g"] for r in e.select("g").distinct().orderBy("g").collect()]
    own = [f"c{i}" for i in range(len(names))]
    v = e.groupBy("value").agg(*(F.count_if(F.col("g") == g).alias(c) for g, c in zip(names, own, strict=True)))
    run = S.running_totals(v, S.parted(v, "value"), ["value"], own)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]

    def of(i: int, j: int) -> Column:
        a, b = F.col(own[i]), F.col(own[j])
        both = (a + b).cast("double")
        return F.struct(F.sum(a * (F.col(f"before_{own[j]}") + b / 2)).alias("u"), F.sum(a).cast("double").alias("n"), F.sum(b).cast("double").alias("m"), F.sum(both * both * both - both).alias("t"), F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"))

    out = run.agg(F.array(*(of(i, j) for i, j in pairs)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    n, m = F.col("n"), F.col("m")
    z = F.greatest(F.abs(F.col("u") - n * m / 2) - 0.5, F.lit(0.0)) / F.sqrt(n * m / 12 * (n + m + 1 - F.col("t") / ((n + m) * (n + m - 1))))
    out = out.withColumn("z", z).withColumn("p", F.least(F.lit(1.0), erfc(F.col("z") / F.sqrt(F.lit(2.0)))))
    w = W.orderBy("p", "a", "b")
    out = out.withColumn("k", F.row_number().over(w))
    q = F.least(F.min(F.col("p") * len(pairs) / F.col("k")).over(w.rowsBetween(0, W.unboundedFollowing)), F.lit(1.0))
    return out.select("a", "b", rnd("u", 1).alias("u"), rnd(1 - 2 * F.col("u") / (n * m)).alias("rank_biserial"), rnd("z", 5).alias("z"), rnd("p", 5).alias("p"), rnd(q, 5).alias("q"))
