"""Single operators of the inventory that other queries only hold as a part: files, keys, text, arrays and levels."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.operators import sequences as S
from loomspan.operators.alignment import band
from loomspan.plans.kernels import small
from loomspan.plans.registry import query
from loomspan.plans.relational import RUN, SEQ, rnd
from loomspan.plans.vector import EUCLID, VEC, prototypes
from loomspan.sources import tables as T
from loomspan.sources.tables import blocks, sequences, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the warehouse, which all executors share."""
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_csv(spark, d):
    """Customers written with semicolons and read back, two columns only."""
    at = folder(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(at, sep=";", header=True)
    return T.delimited(spark, at, "c_custkey long, c_name string, c_mktsegment string", ";", ["c_custkey", "c_mktsegment"])


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id")
def source_dataset_registry(spark, d):
    return T.dataset(spark, "sequences", d).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus || '_' || o_custkey || '_' || o_orderkey AS identifier FROM orders")
def project_key_concat(spark, d):
    parts = [F.col(c).cast("string") for c in ("o_orderstatus", "o_custkey", "o_orderkey")]
    return table(spark, d, "orders").select("o_orderkey", F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2]).alias("identifier"))


@query("SELECT c_custkey, CASE c_mktsegment[1] WHEN 'A' THEN '0' WHEN 'B' THEN '1' ELSE c_mktsegment[1] END AS g FROM customer")
def project_case_group(spark, d):
    first = F.substring("c_mktsegment", 1, 1)
    return table(spark, d, "customer").select("c_custkey", F.when(first == "A", "0").when(first == "B", "1").otherwise(first).alias("g"))


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars) AS filled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def project_coalesce_fill(spark, d):
    out = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", "n_chars").alias("filled"))


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(median(c_acctbal), 4) AS median FROM customer GROUP BY c_nationkey")
def agg_named_multi(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), rnd(F.avg(x), 4).alias("mean"), rnd(F.stddev_samp(x), 4).alias("std"), rnd(F.median(x), 4).alias("median"))


@query("SELECT event_type AS label, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS prevalence FROM events GROUP BY ALL")
def agg_prevalence(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.count_distinct("user_id").alias("total"))
    per = e.groupBy(F.col("event_type").alias("label")).agg(F.count_distinct("user_id").alias("n"))
    return per.join(F.broadcast(total)).select("label", rnd(F.col("n") / F.col("total")).alias("prevalence"))


@query(f"WITH {SEQ} SELECT id, pos, round(pos / count(*) OVER (PARTITION BY id), 6) AS t FROM s")
def win_normalized_time(spark, d):
    return sequences(spark, d).select("id", "pos", rnd(F.col("pos") / F.count("*").over(W.partitionBy("id"))).alias("t"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n, user_id LIMIT 10")
def topk_nsmallest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("n", "user_id").limit(10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def limit_head(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(20)


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def set_union_names(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


@query(f"WITH {SEQ}, g AS (SELECT id, list(label ORDER BY pos) AS q FROM s GROUP BY id), m AS (SELECT max(len(q)) AS n FROM g) SELECT id, array_to_string(list_concat(q, list_transform(range(n - len(q)), lambda x: -2)), ',') AS q FROM g, m")
def reshape_cohort_matrix(spark, d):
    """reshape.pad over the cohort: rows filled on the right to the length of the longest."""
    g = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("q"))
    longest = g.agg(F.max(F.size("q")).alias("n"))
    padded = F.concat("q", F.array_repeat(F.lit(-2).cast("long"), F.col("n") - F.size("q")))
    return g.join(F.broadcast(longest)).select("id", F.array_join(padded.cast("array<string>"), ",").alias("q"))


@query("SELECT c_custkey, coalesce(try_cast(substr(c_name, 2) AS BIGINT), -1) AS no_number, coalesce(try_cast(substr(c_name, 10) AS BIGINT), -1) AS task FROM customer")
def str_parse_task_number(spark, d):
    n = lambda k: F.coalesce(F.col("c_name").substr(F.lit(k), F.length("c_name")).try_cast("long"), F.lit(-1))
    return table(spark, d, "customer").select("c_custkey", n(2).alias("no_number"), n(10).alias("task"))


@query("SELECT p_partkey, trim(lower(p_name)) AS name FROM part WHERE regexp_matches(lower(p_type), '[a-z]+')")
def str_clean(spark, d):
    return table(spark, d, "part").where(F.lower("p_type").rlike("[a-z]+")).select("p_partkey", F.trim(F.lower("p_name")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey + o_orderkey) / 2 ELSE o_custkey::DOUBLE END AS x FROM orders")
def str_number_or_list(spark, d):
    """A number, or a list of numbers in brackets whose mean counts."""
    a, b = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))).otherwise(a)
    listed = F.from_json(F.when(F.startswith("t", F.lit("[")), F.col("t")).otherwise(F.concat(F.lit("["), "t", F.lit("]"))), "array<double>")
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", listed.alias("v")).select("o_orderkey", mean.alias("x"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 5) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def math_zscore(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return table(spark, d, "customer").join(g, "c_nationkey").select("c_custkey", rnd((F.col("c_acctbal") - F.col("m")) / F.col("s"), 5).alias("z"))


@query("SELECT event_id, least(greatest(value, 10), 50) AS x FROM events")
def math_clip(spark, d):
    return table(spark, d, "events").select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(50.0)).alias("x"))


@query("WITH b AS (SELECT event_id, value, unnest(range(11)) AS k FROM events), w AS (SELECT event_id, k, exp(-(10e0 * k - value) * (10e0 * k - value) / 200e0) AS g FROM b) SELECT event_id, k, round(g / nullif(sum(g) OVER (PARTITION BY event_id), 0), 6) AS p FROM w")
def math_gaussian_prob_vec(spark, d):
    """A Gaussian density of deviation 10 on eleven bins, normalised; null where no bin is near enough to have any weight. No shuffle."""
    g = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.exp(-(10.0 * k - F.col("value")) * (10.0 * k - F.col("value")) / 200.0))
    e = table(spark, d, "events").select("event_id", g.alias("g")).withColumn("total", F.aggregate("g", F.lit(0.0), lambda a, x: a + x))
    return e.select("event_id", "total", F.posexplode("g").alias("k", "x")).select("event_id", F.col("k").cast("long").alias("k"), rnd(F.try_divide("x", "total")).alias("p"))


@query(f"WITH {SEQ} SELECT id, string_agg(CASE WHEN label = 1 THEN '-1' WHEN label IN (0, 4) THEN 'G' || (label // 2) WHEN label = 2 THEN 'K2' ELSE 'R' || label END, ' ' ORDER BY pos) AS q FROM s GROUP BY id")
def arr_pyramid_labels(spark, d):
    """Labels prefixed by the level at which they are valid (G, K or R); noise stays."""
    g = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("q"))
    name = lambda x: F.when(x == 1, "-1").when(x.isin(0, 4), F.concat(F.lit("G"), F.floor(x / 2).cast("string"))).when(x == 2, "K2").otherwise(F.concat(F.lit("R"), x.cast("string")))
    return g.select("id", F.array_join(F.transform("q", name), " ").alias("q"))


@query("WITH b AS (SELECT unnest(range(12)) AS i), c AS (SELECT a.i, b.i AS j FROM b a, b) SELECT i, j FROM c WHERE abs(j - i) <= 3")
def dist_bounding(spark, d):
    """The cells of a Sakoe-Chiba band of a quarter of 12."""
    return spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(band(12, 12, "sakoe", 0.25))], "i long, j long")


@query()
def clu_hac(spark, d):
    """Complete linkage of the prototypes, cut to five clusters."""
    from loomspan.operators.segmentation import linkage_labels

    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(linkage_labels(small(spark, d), 5))], "proto int, cluster int")


PICKS = "f AS (SELECT pos, id, 'clustering' AS method, label FROM b WHERE id % 4 < 2 UNION ALL SELECT pos, id, 'projection', (label + pos) % 10 FROM b WHERE id % 4 BETWEEN 1 AND 2)"


@query(f"WITH {VEC}, {PICKS}, w AS (SELECT DISTINCT id, CASE WHEN id % 3 = 0 THEN 'projection' ELSE 'clustering' END AS method FROM b), d AS (SELECT pos, round(min({EUCLID}), 5) AS dist FROM b, p GROUP BY pos) SELECT b.id, b.pos, w.method, coalesce(f.label, -3) AS label, f.label IS NOT NULL AS attached, d.dist FROM b JOIN w ON w.id = b.id JOIN d ON d.pos = b.pos LEFT JOIN f ON f.pos = b.pos AND f.method = w.method")
def clu_label_attach(spark, d):
    """Labels of each recording's own method, and the least distance to any prototype; blocks without a label of that method are unmapped (-3).

    Two methods have labelled some of the recordings each, so some have both, some one and some none.
    """
    b = blocks(spark, d)
    own = b.select("id", "pos", "v", F.when(F.col("id") % 3 == 0, "projection").otherwise("clustering").alias("method"))
    clustering = b.where("id % 4 < 2").select("pos", F.lit("clustering").alias("method"), "label")
    projection = b.where("id % 4 BETWEEN 1 AND 2").select("pos", F.lit("projection").alias("method"), ((F.col("label") + F.col("pos")) % 10).alias("label"))
    dist = J.nearest_centroid(own.select("pos", "v"), prototypes(spark, d)).select("pos", "dist")
    out = own.drop("v").join(clustering.unionByName(projection), ["pos", "method"], "left").join(dist, "pos")
    return out.select("id", "pos", "method", F.coalesce("label", F.lit(-3)).alias("label"), F.col("label").isNotNull().alias("attached"), F.round("dist", 5).alias("dist"))


@query("SELECT event_id, value * 2 + 1 AS twice FROM events")
def udf_row_scalar(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") * 2 + 1).alias("twice"))


@query("SELECT l_orderkey, round(avg(l_quantity), 5) AS fps, bool_or(l_returnflag = 'R') AS computed, count(DISTINCT l_suppkey) AS machines FROM lineitem GROUP BY l_orderkey")
def ops_union_metadata(spark, d):
    """Snapshots of several machines: computed if any says so, mean rate."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(rnd(F.avg("l_quantity"), 5).alias("fps"), F.bool_or(F.col("l_returnflag") == "R").alias("computed"), F.count_distinct("l_suppkey").alias("machines"))


@query("SELECT o_orderkey, coalesce(l.l_returnflag, o.o_orderstatus) AS status FROM orders o LEFT JOIN (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40) l ON l.l_orderkey = o.o_orderkey")
def ops_manual_fixes(spark, d):
    """A table of corrections that replaces values where it has a row."""
    fixes = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return table(spark, d, "orders").join(fixes, "o_orderkey", "left").select("o_orderkey", F.coalesce("l_returnflag", "o_orderstatus").alias("status"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
def ops_annotation_filter(spark, d):
    """Items annotated with exactly one tool."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).where("n = 1").select("o_custkey")


@query("SELECT l_orderkey, count(*) AS parts, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def ops_collate_subset(spark, d):
    """Groups of several parts, and whether all are there."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.bool_and(F.col("l_linestatus") == "F").alias("complete")).where("parts > 1")
