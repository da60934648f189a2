"""Scans, projections, filters, joins and aggregations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.operators import sequences as S
from loomspan.plans.registry import query
from loomspan.sources.tables import sequences, table

#: The event sequences of sources.tables.sequences, in SQL.
SEQ = "s AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (list_position(['click','error','purchase','signup','view'], event_type) - 1)::BIGINT AS label, event_type AS sym, value, ts, event_id FROM events)"
#: Runs of equal labels.
RUN = SEQ + ", r0 AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM s), r1 AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS seg FROM r0), r AS (SELECT id, seg, min(pos) AS s, max(pos) + 1 AS e, min(label) AS label FROM r1 GROUP BY id, seg)"


def rnd(c, n: int = 6):
    return F.round(c, n)


@query(f"WITH {RUN}, a AS (SELECT label, count(DISTINCT id) AS n_subjects, count(*) AS n_segments, avg(e - s) AS len_mean, stddev_samp(e - s) AS len_std FROM r GROUP BY label), n AS (SELECT label, id, count(*) AS k FROM r GROUP BY label, id), b AS (SELECT label, avg(k) AS app_mean, stddev_samp(k) AS app_std, sum(k)::BIGINT AS app_sum FROM n GROUP BY label), d AS (SELECT label, count(*) AS n_items, avg(value) AS dist_mean, median(value) AS dist_median, stddev_samp(value) AS dist_std, sum(value * value) AS ssd FROM s GROUP BY label), t AS (SELECT count(DISTINCT id) AS subjects, count(*) AS items, sum(value * value) AS total FROM s) SELECT a.label, CASE WHEN a.label = -1 THEN 'Noise' WHEN a.label = -2 THEN 'Edge' ELSE 'cluster' END AS kind, n_subjects, round(n_subjects / subjects, 6) AS subject_prevalence, round(n_items / items, 6) AS prevalence, n_segments, round(app_mean, 6) AS app_mean, round(app_std, 6) AS app_std, app_sum, round(dist_mean, 4) AS dist_mean, round(dist_median, 4) AS dist_median, round(dist_std, 4) AS dist_std, round(len_mean, 6) AS len_mean, round(len_std, 6) AS len_std, round(ssd / total, 6) AS ssd_norm FROM a JOIN b ON a.label = b.label JOIN d ON a.label = d.label, t")
def symbol_cluster_stats(spark, d):
    """agg.cluster_statistics: one aggregate for each grain, joined on the label."""
    s = sequences(spark, d)
    r = S.runs(s)
    size = F.col("e") - F.col("s")
    a = r.groupBy("label").agg(F.count_distinct("id").alias("n_subjects"), F.count("*").alias("n_segments"), F.avg(size).alias("len_mean"), F.stddev_samp(size).alias("len_std"))
    b = r.groupBy("label", "id").agg(F.count("*").alias("k")).groupBy("label").agg(F.avg("k").alias("app_mean"), F.stddev_samp("k").alias("app_std"), F.sum("k").alias("app_sum"))
    sq = F.sum(F.col("value") * F.col("value"))
    c = s.groupBy("label").agg(F.count("*").alias("n_items"), F.avg("value").alias("dist_mean"), F.median("value").alias("dist_median"), F.stddev_samp("value").alias("dist_std"), sq.alias("ssd"))
    t = s.agg(F.count_distinct("id").alias("subjects"), F.count("*").alias("items"), sq.alias("total"))
    kind = F.when(F.col("label") == -1, "Noise").when(F.col("label") == -2, "Edge").otherwise("cluster")
    out = a.join(b, "label").join(c, "label").crossJoin(F.broadcast(t))
    return out.select("label", kind.alias("kind"), "n_subjects", rnd(F.col("n_subjects") / F.col("subjects")).alias("subject_prevalence"), rnd(F.col("n_items") / F.col("items")).alias("prevalence"), "n_segments", rnd("app_mean").alias("app_mean"), rnd("app_std").alias("app_std"), "app_sum", rnd("dist_mean", 4).alias("dist_mean"), rnd("dist_median", 4).alias("dist_median"), rnd("dist_std", 4).alias("dist_std"), rnd("len_mean").alias("len_mean"), rnd("len_std").alias("len_std"), rnd(F.col("ssd") / F.col("total")).alias("ssd_norm"))


# --- 2.2 projections, filters, scalars ---


@query("SELECT scenario, count(*) AS n FROM (SELECT unnest(list_filter(['all', CASE WHEN l.doc_id IS NOT NULL THEN 'present' END, CASE WHEN l.doc_id IS NULL THEN 'unprocessed' END, CASE WHEN l.quality = 1 THEN 'success' END, CASE WHEN l.quality IS NOT NULL AND l.toxic IS NOT NULL THEN 'complete' END], lambda x: x IS NOT NULL)) AS scenario FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY scenario")
def filter_cohort_scenario(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    rules = {"all": F.lit(True), "present": F.col("there").isNotNull(), "unprocessed": F.col("there").isNull(), "success": F.col("quality") == 1, "complete": F.col("quality").isNotNull() & F.col("toxic").isNotNull()}
    return rows.select(F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("scenario")).groupBy("scenario").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(DISTINCT o_orderpriority) AS n_priorities, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_f, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(DISTINCT o_orderpriority) > 1")
def filter_gold(spark, d):
    """Group flags joined back to rows, then the groups that pass."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy("c_mktsegment").agg(F.count_distinct("o_orderpriority").alias("n_priorities"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("any_f"), F.count("*").alias("n"))
    return out.where("n_priorities > 1")


@query("SELECT l_returnflag, sum(CASE WHEN l_quantity < lo OR l_quantity > hi THEN 1 ELSE 0 END)::BIGINT AS outliers, count(*) AS n FROM lineitem JOIN (VALUES ('A', 5e0, 40e0), ('N', 2e0, 45e0), ('R', 1e0, 30e0)) AS b(f, lo, hi) ON f = l_returnflag GROUP BY l_returnflag")
def filter_duration_bounds(spark, d):
    bounds = spark.createDataFrame([("A", 5.0, 40.0), ("N", 2.0, 45.0), ("R", 1.0, 30.0)], "f string, lo double, hi double")
    out = table(spark, d, "lineitem").select("l_returnflag", "l_quantity").join(F.broadcast(bounds), F.col("f") == F.col("l_returnflag"))
    flag = F.when((F.col("l_quantity") < F.col("lo")) | (F.col("l_quantity") > F.col("hi")), 1).otherwise(0)
    return out.groupBy("l_returnflag").agg(F.sum(flag).alias("outliers"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]') AND length(p_name) > 5 AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def filter_name_rules(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("[aeiou]") & (F.length("p_name") > 5) & ~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 - 2500 AND 100000 + 2500")
def filter_tolerance(spark, d):
    return table(spark, d, "orders").where(F.col("o_totalprice").between(100000.0 - 2500, 100000.0 + 2500)).select("o_orderkey", "o_totalprice")


@query(f"WITH {RUN} SELECT label, count(DISTINCT id) AS n_subjects, count(*) AS n_appearance FROM r GROUP BY label HAVING count(DISTINCT id) < 150 OR count(*) < 1650")
def filter_prevalence(spark, d):
    out = S.runs(sequences(spark, d)).groupBy("label").agg(F.count_distinct("id").alias("n_subjects"), F.count("*").alias("n_appearance"))
    return out.where("n_subjects < 150 OR n_appearance < 1650")


@query("SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def filter_nan_rows(spark, d):
    from loomspan.functions.vectors import finite

    return table(spark, d, "embeddings").where(finite("embedding")).select("vec_id", "label")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1")
def filter_failed_collection(spark, d):
    out = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return out.where(~F.col("toxic").eqNullSafe(F.lit(1))).select("doc_id")


@query("SELECT c_custkey, concat_ws('_', c_name, c_mktsegment, c_nationkey) AS identifier, CASE WHEN c_mktsegment LIKE 'A%' THEN '0' WHEN c_mktsegment LIKE 'B%' THEN '1' WHEN c_name IS NOT NULL THEN substr(c_mktsegment, 1, 1) END AS grp, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS filled FROM customer")
def project_keys_and_groups(spark, d):
    """project.key_concat, project.case_group, project.coalesce_fill."""
    seg = F.col("c_mktsegment")
    grp = F.when(seg.startswith("A"), "0").when(seg.startswith("B"), "1").when(F.col("c_name").isNotNull(), F.substring(seg, 1, 1))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("_", "c_name", "c_mktsegment", "c_nationkey").alias("identifier"), grp.alias("grp"), F.coalesce(F.nullif(seg, F.lit("BUILDING")), "c_name").alias("filled"))


@query("SELECT o_custkey, CASE WHEN list_contains(list(DISTINCT o_orderpriority), '1-URGENT') THEN '1-URGENT' WHEN list_contains(list(DISTINCT o_orderpriority), '2-HIGH') THEN '2-HIGH' ELSE 'other' END AS chosen FROM orders GROUP BY o_custkey")
def project_audio_modality(spark, d):
    have = F.collect_set("o_orderpriority")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.array_contains(have, "1-URGENT"), "1-URGENT").when(F.array_contains(have, "2-HIGH"), "2-HIGH").otherwise("other").alias("chosen"))


@query("SELECT d.doc_id, coalesce(quality, 16)::INTEGER AS quality, coalesce(toxic, 8)::INTEGER AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def project_constant_fill(spark, d):
    out = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return out.fillna({"quality": 16, "toxic": 8}).select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("SELECT n_nationkey AS n_nationkey_x, n_name AS n_name_x, n_regionkey AS n_regionkey_x FROM nation")
def project_add_suffix(spark, d):
    df = table(spark, d, "nation")
    return df.withColumnsRenamed({c: f"{c}_x" for c in df.columns})


@query("WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') WHEN 1 THEN '01:' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':30' WHEN 2 THEN 'bad' END AS hms FROM orders), p AS (SELECT *, string_split(hms, ':') AS q FROM t), u AS (SELECT o_orderkey, hms, CASE len(q) WHEN 2 THEN try_cast(q[1] AS DOUBLE) * 60 + try_cast(q[2] AS DOUBLE) WHEN 3 THEN try_cast(q[1] AS DOUBLE) * 3600 + try_cast(q[2] AS DOUBLE) * 60 + try_cast(q[3] AS DOUBLE) END AS secs FROM p) SELECT o_orderkey, hms, secs, ceil(secs / 0.64e0)::BIGINT AS start_pos, floor(secs / 0.64e0)::BIGINT AS end_pos FROM u")
def project_parse_hms_bounds(spark, d):
    """project.parse_hms and project.test_bounds with a stride of 0.64 s."""
    pad = lambda c: F.lpad((F.col(c) % 60).cast("string"), 2, "0")
    k = F.col("o_orderkey") % 4
    t = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, F.concat_ws(":", pad("o_orderkey"), pad("o_custkey"))).when(k == 1, F.concat_ws(":", F.lit("01"), pad("o_orderkey"), F.lit("30"))).when(k == 2, "bad").alias("hms"))
    q = F.split("hms", ":")
    n = lambda i: F.get(q, F.lit(i)).try_cast("double")
    secs = F.when(F.size(q) == 2, n(0) * 60 + n(1)).when(F.size(q) == 3, n(0) * 3600 + n(1) * 60 + n(2))
    return t.select("o_orderkey", "hms", secs.alias("secs")).select("*", F.ceil(F.col("secs") / 0.64).alias("start_pos"), F.floor(F.col("secs") / 0.64).alias("end_pos"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, (l_quantity * 4)::BIGINT AS n FROM lineitem) SELECT l_orderkey, l_linenumber, n, coalesce(len(range(0, n - 16 - 1, 8)), 0)::BIGINT AS windows, CASE WHEN n > 17 THEN list_last(range(0, n - 16 - 1, 8)) END AS last_start FROM t")
def project_window_index(spark, d):
    """Start indices range(0, n - 16 - 1, 8) of blocks."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 4).cast("long").alias("n"))
    starts = F.when(F.col("n") > 17, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n"), F.lit(18)) - 18, F.lit(8).cast("long"))).otherwise(F.array().cast("array<long>"))
    return t.select("*", F.size(starts).cast("long").alias("windows"), F.try_element_at(starts, F.lit(-1)).alias("last_start"))


@query("SELECT event_id, epoch(TIMESTAMP '2022-01-01' + to_seconds(floor(value)::BIGINT))::BIGINT AS wall FROM events")
def project_datetime_offset(spark, d):
    wall = F.expr("TIMESTAMP_NTZ'2022-01-01 00:00:00' + make_dt_interval(0, 0, 0, floor(value))")
    return table(spark, d, "events").select("event_id", F.unix_seconds(wall.cast("timestamp")).alias("wall"))


# --- 2.3 joins ---


@query("SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_indicator(spark, d):
    return J.with_indicator(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, p.p_brand FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 25")
def join_left_multikey_renamed(spark, d):
    line, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("p_size") > 25), "left").select("l_orderkey", "l_linenumber", "o_custkey", "p_brand")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_single(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name")
def join_inner_chain(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    out = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"))
    return out.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def join_left_two_key(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role")), ["conv_id", "turn"], "left")


@query("WITH f AS (SELECT l_orderkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey) SELECT l.l_orderkey, l_linenumber, round(l_extendedprice - m, 6) AS residual FROM lineitem l LEFT JOIN f ON l.l_orderkey = f.l_orderkey")
def join_fit_back(spark, d):
    m = F.avg("l_extendedprice").over(W.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(F.col("l_extendedprice") - m).alias("residual"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_missing_qc(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE NOT (lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def join_anti_excluded(spark, d):
    docs, bad = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("bad"))
    return docs.join(bad, (F.col("doc_id") == F.col("bad")) & (F.col("lang") == "en"), "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def join_semi_isin(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query(f"WITH {SEQ}, g AS (SELECT id, list(CASE label WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 4 THEN 40 ELSE -1 END ORDER BY pos) AS m FROM s GROUP BY id) SELECT id, array_to_string(m, ',') AS mapped FROM g")
def join_map_lookup(spark, d):
    m = F.create_map(*map(F.lit, (0, 10, 1, 20, 4, 40)))
    g = sequences(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: F.coalesce(F.try_element_at(m, x["label"].cast("int")), F.lit(-1))).alias("m"))
    return g.select("id", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("mapped"))


@query(f"WITH {RUN}, g AS (SELECT id, seg, s::DOUBLE AS s, e::DOUBLE AS e, label FROM r) SELECT g.id, g.seg, count(*) AS n, round(avg(x.value), 4) AS mean FROM g JOIN s x ON x.id = g.id AND x.pos BETWEEN g.s AND g.e GROUP BY g.id, g.seg")
def join_interval_samples_to_segments(spark, d):
    """Both ends inclusive: a sample on a boundary counts in two segments."""
    s = sequences(spark, d)
    seg = S.runs(s).select("id", "seg", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
    return J.interval_join(s.select("id", F.col("pos").cast("double").alias("t"), "value"), seg, 8.0).groupBy("id", "seg").agg(F.count("*").alias("n"), rnd(F.avg("value"), 4).alias("mean"))


@query(f"WITH {SEQ}, n AS (SELECT id, count(*) AS n FROM s GROUP BY id), a AS (SELECT s.id, n, pos AS o, label, (pos::DOUBLE / n * 40) AS p0, least(pos + 3, n)::DOUBLE / n * 40 AS p1 FROM s JOIN n ON s.id = n.id), p AS (SELECT id, unnest(range(floor(p0)::BIGINT, ceil(p1)::BIGINT)) AS slot, o, label FROM a), b AS (SELECT id, slot, max_by(label, o) AS label FROM p GROUP BY id, slot) SELECT n.id, k.slot, coalesce(b.label, -1) AS label FROM n CROSS JOIN (SELECT unnest(range(40)) AS slot) k LEFT JOIN b ON b.id = n.id AND b.slot = k.slot")
def join_interval_annotation_to_frames(spark, d):
    """Annotations painted on 40 slots, later ones on top; slots without one are -1."""
    s = sequences(spark, d)
    n = s.groupBy("id").agg(F.count("*").alias("n"))
    a = s.join(n, "id").select("id", F.col("pos").alias("o"), "label", F.floor(F.col("pos") / F.col("n") * 40).alias("a"), (F.ceil(F.least(F.col("pos") + 3, "n") / F.col("n") * 40) - 1).alias("b"))
    painted = a.where("b >= a").select("id", "o", "label", F.explode(F.sequence("a", "b")).alias("slot")).groupBy("id", "slot").agg(F.max_by("label", "o").alias("label"))
    slots = n.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("slot"))
    return slots.join(painted, ["id", "slot"], "left").select("id", "slot", F.coalesce("label", F.lit(-1)).alias("label"))


@query("WITH t AS (SELECT unnest([0e0, 25e0, 50e0, 75e0, 100e0]) AS target) SELECT target, event_id, value FROM (SELECT target, event_id, value, row_number() OVER (PARTITION BY target ORDER BY abs(value - target), event_id) AS k FROM events, t) WHERE k = 1")
def join_nearest_value(spark, d):
    return J.nearest_value(table(spark, d, "events"), spark.createDataFrame([(float(x),) for x in (0, 25, 50, 75, 100)], "target double"), "value", "event_id")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS dist FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def join_pairwise_self(spark, d):
    return J.pairs(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select(F.col("n_nationkey_a").alias("a"), F.col("n_nationkey_b").alias("b"), F.levenshtein("n_name_a", "n_name_b").alias("dist"))


@query("SELECT r_name, n_name FROM region, nation")
def join_many_to_many(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(table(spark, d, "nation").select("n_name")))


@query(f"WITH {SEQ} SELECT id, pos, label AS a, lead(label) OVER (PARTITION BY id ORDER BY pos) AS b FROM s QUALIFY lead(label) OVER (PARTITION BY id ORDER BY pos) IS NOT NULL")
def join_consecutive(spark, d):
    return sequences(spark, d).select("id", "pos", F.col("label").alias("a"), F.lead("label").over(S.by()).alias("b")).where("b IS NOT NULL")


@query("WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') SELECT p.event_id, (SELECT v.value FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS value_asof FROM p")
def join_asof(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return J.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "user_id", "ts", "value").select("event_id", "value_asof")


# --- 2.4 aggregations ---


@query("WITH s AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, count(*) AS labels, round(sum(v[1]), 4) AS firsts FROM s GROUP BY user_id")
def agg_collapse_per_label(spark, d):
    lists = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))["value"].alias("v"))
    maps = lists.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.size("m").cast("long").alias("labels"), rnd(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v[0]), 4).alias("firsts"))


@query("SELECT l_orderkey, (SELECT min(x) FROM (SELECT l_returnflag AS x, count(*) AS n FROM lineitem i WHERE i.l_orderkey = l.l_orderkey GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1)) AS mode_flag, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS lines, sum(l_quantity) AS qty, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS one_status FROM lineitem l GROUP BY l_orderkey")
def agg_metadata_consolidation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.mode("l_returnflag", True).alias("mode_flag"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"), F.sum("l_quantity").alias("qty"), F.when(F.count_distinct("l_linestatus") == 1, F.min("l_linestatus")).alias("one_status"))


@query("SELECT o_orderkey, (SELECT count(DISTINCT o_orderstatus) FROM orders i WHERE i.o_custkey = o.o_custkey) AS statuses, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, (o_orderpriority = '1-URGENT') OR bool_or(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS any_urgent FROM orders o")
def agg_group_transform(spark, d):
    w = W.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.size(F.collect_set("o_orderstatus").over(w)).cast("long").alias("statuses"), F.max("o_totalprice").over(w).alias("top"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").over(w).alias("any_urgent"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def agg_size_value_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY day")
def agg_distinct_count(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT c_mktsegment, n_regionkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(median(c_acctbal), 4) AS med FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def agg_named_multi_demographics(spark, d):
    out = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), rnd(F.avg("c_acctbal"), 4).alias("mean"), rnd(F.stddev_samp("c_acctbal"), 4).alias("std"), rnd(F.median("c_acctbal"), 4).alias("med"))


@query("WITH t AS (SELECT l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT 'quality' AS col, count(*) - count(quality) AS nulls, round(100e0 * (count(*) - count(quality)) / count(*), 6) AS pct FROM t UNION ALL SELECT 'toxic', count(*) - count(toxic), round(100e0 * (count(*) - count(toxic)) / count(*), 6) FROM t")
def agg_missing_report(spark, d):
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("quality", "toxic")
    long = t.unpivot([], ["quality", "toxic"], "col", "v")
    return long.groupBy("col").agg(F.count_if(F.col("v").isNull()).alias("nulls"), rnd(F.avg(F.col("v").isNull().cast("int")) * 100).alias("pct"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, p FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) = 1), a AS (SELECT o_custkey, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY o_custkey) SELECT a.o_custkey, p AS mode, mean FROM a JOIN m ON a.o_custkey = m.o_custkey")
def agg_mode_or_mean(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.mode("o_orderpriority", True).alias("mode"), rnd(F.avg("o_totalprice")).alias("mean"))


@query("SELECT event_type, round(avg(value) + 2 * stddev_pop(value), 4) AS bound FROM events GROUP BY event_type")
def agg_sigma_threshold(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(rnd(F.avg("value") + 2 * F.stddev_pop("value"), 4).alias("bound"))


@query("WITH b AS (SELECT event_type, min(value) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY event_type) SELECT event_id, round((value - lo) / (hi - lo + 1e-6), 5) AS norm FROM events e JOIN b ON e.event_type = b.event_type")
def agg_cluster_percentile_norm(spark, d):
    e = table(spark, d, "events")
    b = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.percentile("value", 0.98).alias("hi"))
    return e.join(b, "event_type").select("event_id", rnd((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 5).alias("norm"))


@query(f"WITH {SEQ}, c AS (SELECT *, count(*) OVER (PARTITION BY id, label)::DOUBLE AS n FROM s) SELECT id, pos, round(n / sum(n) OVER (PARTITION BY id), 8) AS p FROM c")
def agg_label_probability(spark, d):
    c = sequences(spark, d).withColumn("n", F.count("*").over(W.partitionBy("id", "label")))
    return c.select("id", "pos", rnd(F.col("n") / F.sum("n").over(W.partitionBy("id")), 8).alias("p"))


@query(f"WITH {SEQ}, t AS (SELECT id, CASE WHEN label = 1 THEN -1 WHEN label = 3 THEN -2 ELSE label END AS label FROM s) SELECT id, round(avg(CASE WHEN label = -1 THEN 1 ELSE 0 END), 6) AS noise, round(avg(CASE WHEN label = -2 THEN 1 ELSE 0 END), 6) AS edge, count(DISTINCT label) AS k FROM t GROUP BY id")
def agg_noise_share(spark, d):
    t = sequences(spark, d).select("id", F.when(F.col("label") == 1, -1).when(F.col("label") == 3, -2).otherwise(F.col("label")).alias("label"))
    share = lambda v: rnd(F.avg(F.when(F.col("label") == v, 1).otherwise(0)))
    return t.groupBy("id").agg(share(-1).alias("noise"), share(-2).alias("edge"), F.count_distinct("label").alias("k"))


@query("SELECT event_type, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS prevalence, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS density FROM events GROUP BY event_type")
def agg_prevalence_pooled(spark, d):
    """agg.prevalence and agg.pooled_counts."""
    e = table(spark, d, "events")
    t = e.agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("t"))
    out = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("k"), F.count("*").alias("n")).crossJoin(F.broadcast(t))
    return out.select("event_type", rnd(F.col("k") / F.col("u")).alias("prevalence"), "n", rnd(F.col("n") / F.col("t")).alias("density"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS path FROM events GROUP BY user_id")
def agg_list(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"], ">").alias("path"))


@query("SELECT n_regionkey, c_mktsegment, round(avg(sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey)), 4) AS mean, round(stddev_pop(sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey)), 4) AS std FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def agg_vector_norm_features(spark, d):
    x = F.sqrt(F.col("c_acctbal") * F.col("c_acctbal") + F.col("c_nationkey") * F.col("c_nationkey"))
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(rnd(F.avg(x), 4).alias("mean"), rnd(F.stddev_pop(x), 4).alias("std"))


@query(f"WITH {SEQ}, p AS (SELECT id, coalesce(abs(value - lag(value) OVER (PARTITION BY id ORDER BY pos)), 0) AS step FROM s) SELECT id, round(sum(step), 4) AS path, round(avg(step), 4) AS mean FROM p GROUP BY id")
def agg_path_length_features(spark, d):
    step = F.coalesce(F.abs(F.col("value") - F.lag("value").over(S.by())), F.lit(0.0))
    return sequences(spark, d).withColumn("step", step).groupBy("id").agg(rnd(F.sum("step"), 4).alias("path"), rnd(F.avg("step"), 4).alias("mean"))


@query("SELECT conv_id, CASE WHEN sum((role = 'user')::INT) >= sum((role <> 'user')::INT) THEN 'user' ELSE 'other' END AS side, round(CASE WHEN sum((role = 'user')::INT) >= sum((role <> 'user')::INT) THEN avg(CASE WHEN role = 'user' THEN length(text) END) ELSE avg(CASE WHEN role <> 'user' THEN length(text) END) END, 4) AS score FROM conversations GROUP BY conv_id")
def agg_weighted_handedness(spark, d):
    user = F.col("role") == "user"
    more = F.count_if(user) >= F.count_if(~user)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(more, "user").otherwise("other").alias("side"), rnd(F.when(more, F.avg(F.when(user, F.length("text")))).otherwise(F.avg(F.when(~user, F.length("text")))), 4).alias("score"))


@query("SELECT user_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'a' WHEN 'purchase' THEN 'b' ELSE '-3' END AS g, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std, round(max(value) - min(value), 4) AS spread FROM events GROUP BY ALL")
def agg_reduce_distance_columns(spark, d):
    g = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("click", "a", "view", "a", "purchase", "b"))), F.col("event_type")), F.lit("-3"))
    return table(spark, d, "events").groupBy("user_id", g.alias("g")).agg(rnd(F.avg("value")).alias("mean"), rnd(F.stddev_pop("value"), 5).alias("std"), rnd(F.max("value") - F.min("value"), 4).alias("spread"))


@query("WITH m AS (SELECT l_returnflag AS g, l_suppkey AS k, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL) SELECT g, round(avg(s) / stddev_pop(m), 4) AS ratio FROM m GROUP BY g")
def agg_dispersion_ratio(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_suppkey").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return m.groupBy("g").agg(rnd(F.avg("s") / F.stddev_pop("m"), 4).alias("ratio"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 4) AS q5, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.9), 4) AS q90 FROM events GROUP BY event_type")
def agg_quantile(spark, d):
    q = lambda p, n: rnd(F.percentile("value", p), 4).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(q(0.05, "q5"), q(0.25, "q25"), q(0.9, "q90"))


@query(f"WITH {RUN}, g AS (SELECT r.id, r.seg, s.value FROM r JOIN s ON s.id = r.id AND s.pos >= r.s AND s.pos < r.e) SELECT id, seg, round(sum(value * value) - sum(value) * sum(value) / count(*), 3) AS cost FROM g GROUP BY id, seg")
def cpd_gram_cost(spark, d):
    """cpd.gram_cost and agg.segment_cost_stats for the linear kernel: |x|^2 - |sum x|^2 / n."""
    new = F.when(F.col("label") == F.lag("label").over(S.by()), 0).otherwise(1)
    g = sequences(spark, d).withColumn("new", new).withColumn("seg", F.sum("new").over(S.by()))
    v = F.col("value")
    return g.groupBy("id", "seg").agg(rnd(F.sum(v * v) - F.sum(v) * F.sum(v) / F.count("*"), 3).alias("cost"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def agg_computation_report(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count().select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(rnd(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS lo, max(x) AS hi FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY l_returnflag")
def agg_auc_metric_summary(spark, d):
    x = "l_extendedprice"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(rnd(F.avg(x), 4).alias("mean"), rnd(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))


@query()
def agg_approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
