"""Windows, ordering, sampling, sets, reshaping and scalar functions over sequences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import sequences as S
from loomspan.plans.registry import query
from loomspan.plans.relational import RUN, SEQ, rnd
from loomspan.sources.tables import sequences, table


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS gid FROM customer")
def win_dense_group_id(spark, d):
    """ngroup: the window without a partition runs over the distinct keys only."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    keys = c.select("c_mktsegment", "c_nationkey").distinct().withColumn("gid", (F.row_number().over(W.orderBy("c_mktsegment", "c_nationkey")) - 1).cast("long"))
    return c.join(F.broadcast(keys), ["c_mktsegment", "c_nationkey"]).select("c_custkey", "gid")


@query("WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type) SELECT event_id, code FROM events e JOIN f ON e.event_type = f.event_type")
def win_factorize(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    codes = e.groupBy("event_type").agg(F.min("event_id").alias("first")).withColumn("code", (F.row_number().over(W.orderBy("first")) - 1).cast("long"))
    return e.join(codes, "event_type").select("event_id", "code")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def win_order_in_group(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def win_dedup_keep_first(spark, d):
    return S.keep_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey, n FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1")
def win_argmax_per_group(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return c.groupBy("l_partkey").agg(F.max(F.struct("n", (-F.col("l_suppkey")).alias("s"))).alias("b")).select("l_partkey", (-F.col("b.s")).alias("l_suppkey"), "b.n")


@query("WITH a AS (SELECT event_type, user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) <= 2) SELECT event_type, user_id, event_id FROM a QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 10")
def win_topk_per_group_with_cap(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    a = e.withColumn("k", F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("value", "event_id"))).where("k <= 2")
    return a.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy("value", "event_id"))).where("k <= 10").select("event_type", "user_id", "event_id")


@query(f"WITH {RUN} SELECT id, seg, s, e, label FROM r")
def win_run_segments(spark, d):
    return S.runs(sequences(spark, d)).select("id", "seg", "s", "e", "label")


@query(f"WITH {RUN}, n AS (SELECT id, max(e) AS n FROM r GROUP BY id) SELECT r.id, s, CASE WHEN e = n THEN e - 1 ELSE e END AS e, label FROM r JOIN n ON r.id = n.id WHERE label <> 4")
def win_label_runs_bg(spark, d):
    """Runs without the background (4); a recording's last run ends at its last index."""
    r = S.runs(sequences(spark, d)).withColumn("n", F.max("e").over(W.partitionBy("id")))
    return r.where("label <> 4").select("id", "s", F.when(F.col("e") == F.col("n"), F.col("e") - 1).otherwise(F.col("e")).alias("e"), "label")


@query(f"WITH {SEQ}, g AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM s WHERE label IN (0, 4)) SELECT id, min(pos) AS a, max(pos) AS b FROM g GROUP BY id, k")
def win_connected_subseries(spark, d):
    g = sequences(spark, d).where("label IN (0, 4)").select("id", "pos", (F.col("pos") - F.row_number().over(S.by())).alias("k"))
    return g.groupBy("id", "k").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).drop("k")


@query(f"WITH {RUN}, a AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY id ORDER BY s) <= 2 THEN 0 ELSE 1 END AS n FROM r WHERE label = 4), g AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY s) AS k FROM a) SELECT id, min(s) AS s, max(e) AS e FROM g GROUP BY id, k HAVING max(e) - min(s) > 3")
def win_join_and_discard(spark, d):
    return S.join_and_discard(S.runs(sequences(spark, d)).where("label = 4").select("id", "s", "e"), 2, 3)


@query(f"WITH {SEQ}, f AS (SELECT id, pos, (label IN (0, 4))::INT AS f FROM s), a AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN min(f) OVER w ELSE 0 END AS er FROM f WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), b AS (SELECT *, max(er) OVER w AS op FROM a WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), c AS (SELECT *, max(op) OVER w AS di FROM b WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT id, pos, op AS opened, CASE WHEN count(*) OVER w = 5 THEN min(di) OVER w ELSE 0 END AS closed FROM c WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def win_morph_open_close(spark, d):
    f = sequences(spark, d).select("id", "pos", F.when(F.col("label").isin(0, 4), 1).otherwise(0).alias("f"))
    return S.opened_closed(f, "f", 3, 5).select("id", "pos", "opened", "closed")


@query(f"WITH {RUN}, b AS (SELECT id, min(s) AS lo, max(e) AS hi FROM r WHERE e - s >= 2 GROUP BY id) SELECT s.id, s.pos - lo AS pos, label FROM s JOIN b ON s.id = b.id AND s.pos >= lo AND s.pos < hi")
def win_edge_crop(spark, d):
    """Positions outside the first and last run of two or more are cut off, the rest shifted."""
    s = sequences(spark, d)
    b = S.runs(s).where("e - s >= 2").groupBy("id").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return s.join(b, "id").where("pos >= lo AND pos < hi").select("id", (F.col("pos") - F.col("lo")).alias("pos"), "label")


@query(f"WITH {RUN}, m AS (SELECT id, s, e, CASE WHEN label IN (0, 4) THEN 0 ELSE label END AS label FROM r), a AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY id ORDER BY s) THEN 0 ELSE 1 END AS c FROM m), g AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY s) AS k FROM a) SELECT id, min(s) AS s, max(e) AS e, min(label) AS label, count(*) - 1 AS merged FROM g GROUP BY id, k")
def win_prune_segmentation(spark, d):
    m = S.runs(sequences(spark, d)).withColumn("label", F.when(F.col("label").isin(0, 4), 0).otherwise(F.col("label")))
    return S.merge_equal(m).select("id", "s", "e", "label", "merged")


@query(f"WITH {RUN}, a AS (SELECT *, coalesce(e - s <= 1 AND lag(label) OVER (PARTITION BY id ORDER BY s) = lead(label) OVER (PARTITION BY id ORDER BY s), false) AS short FROM r), b AS (SELECT *, sum(1 - short::INT) OVER (PARTITION BY id ORDER BY s) AS k FROM a), c AS (SELECT id, k, min(s) AS s, max(e) AS e, arg_min(label, s) AS label, sum(short::INT) AS i FROM b GROUP BY id, k), f AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY id ORDER BY s) THEN 0 ELSE 1 END AS n FROM c), g AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY s) AS q FROM f) SELECT id, min(s) AS s, max(e) AS e, min(label) AS label, sum(i)::BIGINT AS interruptions FROM g GROUP BY id, q")
def win_smooth_segments(spark, d):
    return S.smooth(S.runs(sequences(spark, d)), 1).select("id", "s", "e", "label", "interruptions")


@query(f"WITH {RUN} SELECT id, s, e, CASE WHEN e - s <= 1 AND lag(label) OVER w = lead(label) OVER w THEN lag(label) OVER w ELSE label END AS label FROM r WINDOW w AS (PARTITION BY id ORDER BY s)")
def win_short_island_relabel(spark, d):
    w = W.partitionBy("id").orderBy("s")
    before, after = F.lag("label").over(w), F.lead("label").over(w)
    return S.runs(sequences(spark, d)).select("id", "s", "e", F.when((F.col("e") - F.col("s") <= 1) & (before == after), before).otherwise(F.col("label")).alias("label"))


@query(f"WITH {RUN} SELECT id, unnest(range(s, e)) AS pos, label FROM r")
def win_propagate_to_positions(spark, d):
    return S.to_positions(S.runs(sequences(spark, d)))


@query(f"WITH {SEQ}, v AS (SELECT id, unnest(range(pos, pos + 4)) AS frame, label FROM s), c AS (SELECT id, frame, label, count(*) AS n FROM v GROUP BY ALL) SELECT id, frame, label, n = sum(n) OVER (PARTITION BY id, frame) AS agreed FROM c QUALIFY row_number() OVER (PARTITION BY id, frame ORDER BY n DESC, label) = 1")
def win_frame_votes(spark, d):
    return S.frame_votes(sequences(spark, d), 4)


@query(f"WITH {RUN} SELECT label, e - s AS len, count(*) AS n FROM r GROUP BY ALL")
def win_segment_length(spark, d):
    return S.runs(sequences(spark, d)).groupBy("label", (F.col("e") - F.col("s")).alias("len")).agg(F.count("*").alias("n"))


@query(f"WITH {SEQ}, p AS (SELECT label AS i, lead(label) OVER (PARTITION BY id ORDER BY pos) AS j FROM s), c AS (SELECT i, j, count(*) AS n FROM p WHERE i <> j GROUP BY i, j) SELECT i, j, n, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM c")
def win_transition_counts(spark, d):
    return S.transitions(sequences(spark, d)).select("i", "j", "n", rnd("p").alias("p"))


@query(f"WITH {RUN}, k AS (SELECT unnest(range(8)) AS label) SELECT k.label, count(r.id) AS n FROM k LEFT JOIN r ON r.label = k.label GROUP BY k.label")
def win_motif_usage(spark, d):
    r = S.runs(sequences(spark, d)).groupBy("label").agg(F.count("*").alias("n"))
    return spark.range(8).toDF("label").join(r, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {SEQ}, c AS (SELECT id, label, count(*) AS n FROM s GROUP BY id, label), t AS (SELECT label, sum(n) AS t, count(*) AS k FROM c GROUP BY label), q AS (SELECT count(DISTINCT id) AS ids FROM s) SELECT s.id, s.pos, round(s.pos / count(*) OVER (PARTITION BY s.id), 6) AS time, round(n / (t + 1e-6), 6) AS w, round(sqrt(1 / (n / (t + 1e-6) + 1e-6)), 4) AS inverse, round(100e0 * k / ids, 4) AS prevalence FROM s JOIN c ON s.id = c.id AND s.label = c.label JOIN t ON s.label = t.label, q")
def win_timestamps_weighting(spark, d):
    """win.normalized_time and win.timestamps_weighting (alpha 0.5)."""
    s = sequences(spark, d)
    c = s.groupBy("id", "label").agg(F.count("*").alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    q = c.agg(F.count_distinct("id").alias("ids"))
    w = F.col("n") / (F.col("t") + 1e-6)
    out = s.join(c, ["id", "label"]).join(F.broadcast(t), "label").crossJoin(F.broadcast(q))
    return out.select("id", "pos", rnd(F.col("pos") / F.count("*").over(W.partitionBy("id"))).alias("time"), rnd(w).alias("w"), rnd(F.sqrt(1 / (w + 1e-6)), 4).alias("inverse"), rnd(F.col("k") * 100.0 / F.col("ids"), 4).alias("prevalence"))


@query(f"WITH {SEQ} SELECT id, value, round(row_number() OVER (PARTITION BY id ORDER BY value, event_id) / count(*) OVER (PARTITION BY id), 6) AS f FROM s")
def win_ecdf(spark, d):
    return sequences(spark, d).select("id", "value", rnd(F.row_number().over(W.partitionBy("id").orderBy("value", "event_id")) / F.count("*").over(W.partitionBy("id"))).alias("f"))


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS roll FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank_family(spark, d):
    w, t = W.partitionBy("o_custkey").orderBy("o_orderpriority"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(t).cast("long").alias("q"), rnd(F.sum("o_totalprice").over(t.rowsBetween(-2, 0)), 2).alias("roll"))


# --- 2.6 order, limits, samples ---


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 50")
def sort_multi_topk(spark, d):
    """sort.multi, topk.nsmallest, limit.head: the limit is the feature."""
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size").orderBy(F.desc("p_size"), "p_brand", "p_partkey").limit(50)


@query("SELECT o_orderkey, list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT AS place, substr(o_orderpriority, 1, 1)::INTEGER AS suffix FROM orders")
def sort_custom_rank(spark, d):
    order = F.array(*map(F.lit, ("3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")))
    return table(spark, d, "orders").select("o_orderkey", F.array_position(order, F.col("o_orderpriority")).alias("place"), F.substring("o_orderpriority", 1, 1).cast("int").alias("suffix")).orderBy("place", "suffix", "o_orderkey")


@query(f"WITH {SEQ} SELECT label, round(avg(pos), 4) AS mean, row_number() OVER (ORDER BY avg(pos), label) AS place FROM s GROUP BY label")
def sort_by_mean_time(spark, d):
    m = sequences(spark, d).groupBy("label").agg(F.avg("pos").alias("m"))
    return m.select("label", rnd("m", 4).alias("mean"), F.row_number().over(W.orderBy("m", "label")).cast("long").alias("place"))


@query("WITH q AS (SELECT *, md5(doc_id::VARCHAR || '47') AS h, ceil(0.1 * count(*) OVER (PARTITION BY lang)) AS quota FROM documents) SELECT doc_id, lang FROM q QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= quota")
def sample_stratified(spark, d):
    """A tenth of each group, chosen by a seeded hash: the same rows on every run."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("47")).cast("binary"))
    q = table(spark, d, "documents").select("doc_id", "lang", h.alias("h")).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).withColumn("quota", F.ceil(F.count("*").over(W.partitionBy("lang")) * F.lit(0.1)))
    return q.where("k <= quota").select("doc_id", "lang")


@query()
def sample_weighted(spark, d):
    """Without replacement, by the keys -ln(u) / w."""
    u = (F.pmod(F.xxhash64("p_partkey", F.lit(42)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(-F.log(u) / F.col("p_retailprice"), "p_partkey").limit(20)


@query("WITH k AS (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 25) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (FROM k)")
def sample_groups(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(F.broadcast(o.select("o_custkey").distinct().orderBy("o_custkey").limit(25)), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


# --- 2.7 sets and reshaping ---


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def set_union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("SELECT user_id AS k FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60")
def set_intersection(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'error'").select(F.col("user_id").alias("k")).intersect(e.where("event_type = 'purchase' AND value > 60").select("user_id"))


@query("SELECT c_custkey, m.name AS metric, m.v AS v FROM customer, unnest([{'name': 'acctbal', 'v': c_acctbal}, {'name': 'nation', 'v': c_nationkey::DOUBLE}]) AS u(m)")
def reshape_melt(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot(["c_custkey"], ["acctbal", "nation"], "metric", "v")


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings")
def reshape_explode(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS is_f, (o_orderstatus = 'O')::INTEGER AS is_o, (o_orderstatus = 'P')::INTEGER AS is_p FROM orders")
def reshape_one_hot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *((F.col("o_orderstatus") == v).cast("int").alias(f"is_{v.lower()}") for v in "FOP"))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, greatest(ceil((value - lo) / ((hi - lo) / 4)) - 1, 0)::BIGINT AS bin FROM events, b")
def reshape_bin_cut(spark, d):
    """Four bins of equal width, closed on the right, the first one on both sides."""
    e = table(spark, d, "events").select("event_id", "value")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.crossJoin(F.broadcast(b)).select("event_id", F.greatest(F.ceil((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 4)) - 1, F.lit(0).cast("long")).alias("bin"))


@query("WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, ((value > b.a)::INT + (value > b.b)::INT + (value > b.c)::INT)::BIGINT AS q FROM events, b")
def reshape_quantize(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    b = e.agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("b"))
    out = e.crossJoin(F.broadcast(b))
    return out.select("event_id", F.when(F.col("value").isNull() | F.isnan("value"), -1).otherwise(F.size(F.filter("b", lambda x: F.col("value") > x))).cast("long").alias("q"))


# --- 2.8 functions ---


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, list_last(string_split(url, '/')) AS leaf, len(string_split(url, '/'))::INTEGER AS parts FROM pages")
def str_parse_path(spark, d):
    p = F.split("url", "/")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.element_at(p, -1).alias("leaf"), F.size(p).alias("parts"))


@query("WITH t AS (SELECT item_id, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, levenshtein(a.t, b.t)::INTEGER AS d, round(100e0 * (1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))::DOUBLE), 4) AS score FROM t a JOIN t b ON a.item_id < b.item_id")
def str_levenshtein(spark, d):
    """Edit distance of the letters of every pair of items of a small codebook."""
    from loomspan.operators.joins import pairs

    t = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^a-zA-Z]", "").alias("t"))
    dist = F.levenshtein("t_a", "t_b")
    return pairs(t, "item_id").select(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b"), dist.alias("d"), rnd((1 - dist / F.greatest(F.length("t_a"), F.length("t_b"))) * 100, 4).alias("score"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing, CASE WHEN event_id % 2 = 0 THEN (event_id % 30)::DOUBLE ELSE (event_id % 30 + event_id % 7) / 2e0 END AS mean FROM events")
def json_extract(spark, d):
    """json.extract and str.number_or_list: "25" or "[25, 30]" read as a mean."""
    a, b = (F.col("event_id") % 30).cast("string"), (F.col("event_id") % 7).cast("string")
    raw = F.when(F.col("event_id") % 2 == 0, a).otherwise(F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")))
    xs = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<double>")
    mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), mean.alias("mean"))


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, max(date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::INTEGER AS age FROM orders GROUP BY month")
def date_parse_diff(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max(F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))).alias("age"))


@query("WITH m AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mu, stddev_pop(value) OVER (PARTITION BY event_type) AS sd, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) SELECT event_id, round((value - mu) / sd, 5) AS z, round((value - lo) / (hi - lo), 6) AS unit, round(value / hi, 6) AS share, least(greatest(value, 10), 90) AS clipped, round(exp(-0.5e0 * power((value - 50) / 12, 2)), 6) AS bell FROM m")
def math_scalars(spark, d):
    """math.zscore, math.minmax, math.clip, math.gaussian_prob_vec: statistics joined back, five rows broadcast."""
    e, v = table(spark, d, "events"), F.col("value")
    m = e.groupBy("event_type").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = e.join(m, "event_type")
    return out.select("event_id", rnd((v - F.col("mu")) / F.col("sd"), 5).alias("z"), rnd((v - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("unit"), rnd(v / F.col("hi")).alias("share"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clipped"), rnd(F.exp(-0.5 * F.pow((v - 50) / 12, 2))).alias("bell"))


@query(f"WITH {RUN}, c AS (SELECT r.id, r.seg, s.sym, count(*) AS n, min(s.pos) AS p FROM r JOIN s ON s.id = r.id AND s.pos >= (r.s // 6) * 6 AND s.pos < (r.s // 6) * 6 + 6 GROUP BY r.id, r.seg, s.sym) SELECT id, seg, sym, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY id, seg ORDER BY n DESC, p) = 1")
def arr_majority_vote(spark, d):
    """Majority in slices of six positions, first seen of equals, attached to each segment by its slice."""
    s = sequences(spark, d).withColumn("slice", F.expr("pos div 6"))
    best = S.majority(s, ["id", "slice"], "sym")
    return S.runs(s).withColumn("slice", F.expr("s div 6")).join(best, ["id", "slice"]).select("id", "seg", "sym", "votes")


@query(f"WITH {SEQ}, g AS (SELECT id, list(value ORDER BY pos) AS v FROM s GROUP BY id) SELECT id, round(list_min(v), 6) AS lo, list_position(v, list_min(v)) - 1 AS argmin, round(v[2] - v[1], 6) AS step, array_to_string(list_transform(v[1:3], lambda x: round(x, 2)::VARCHAR), '|') IS NOT NULL AS head FROM g")
def arr_slice_ediff_argmin(spark, d):
    g = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    return g.select("id", rnd(F.array_min("v")).alias("lo"), (F.array_position("v", F.array_min("v")) - 1).cast("int").alias("argmin"), rnd(F.get("v", F.lit(1)) - F.get("v", F.lit(0))).alias("step"), F.slice("v", 1, 3).isNotNull().alias("head"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '-1' WHEN value >= 80 THEN '-1' WHEN event_type IN ('click', 'view') THEN 'G' || event_type ELSE 'K' || event_type END AS symbol FROM events")
def arr_symbolize(spark, d):
    """arr.symbolize and arr.pyramid_labels: excluded or distant labels become -1, others get their level."""
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", F.when((t == "error") | (F.col("value") >= 80), "-1").when(t.isin("click", "view"), F.concat(F.lit("G"), t)).otherwise(F.concat(F.lit("K"), t)).alias("symbol"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS clicks, count(*)::INTEGER AS keys FROM c GROUP BY user_id")
def map_build(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.try_element_at("m", F.lit("click")).alias("clicks"), F.size("m").alias("keys"))


# --- 2.12 state and operations ---


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'p' WHEN bool_or(o_orderstatus = 'F') THEN 'f' ELSE 'o' END AS machine, count(DISTINCT o_orderpriority) = 5 AS complete FROM orders GROUP BY o_custkey")
def ops_assignment(spark, d):
    """ops.assignment, ops.union_metadata, ops.collate_subset."""
    have = F.collect_set("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.array_contains(have, "P"), "p").when(F.array_contains(have, "F"), "f").otherwise("o").alias("machine"), (F.count_distinct("o_orderpriority") == 5).alias("complete"))
