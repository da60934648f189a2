"""Vector spaces, kernels, distribution distances, scores and statistics that Spark expressions can state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.operators import kernels as K
from loomspan.operators import mixtures as M
from loomspan.operators import moments as Q
from loomspan.operators import scores as E
from loomspan.operators import sequences as S
from loomspan.operators import spectral as P
from loomspan.operators import trees as R
from loomspan.functions import vectors as V
from loomspan.plans.registry import query
from loomspan.plans.relational import RUN, SEQ, rnd
from loomspan.sources.stored import stored
from loomspan.sources.tables import blocks, sequences, table

#: Blocks, their components and the mean vector of each label, in SQL.
VEC = "b AS (SELECT vec_id AS pos, vec_id // 50 AS id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT pos, id, label, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM b), p AS (SELECT label AS proto, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL) GROUP BY label)"
EUCLID = "sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def prototypes(spark, d):
    return V.centroids(blocks(spark, d), "label").withColumnRenamed("label", "proto")


def kk(spark, d):
    """(i, j, d): Euclidean distances between the prototypes, both directions and the diagonal."""
    p = prototypes(spark, d)
    return p.toDF("i", "a").crossJoin(F.broadcast(p.toDF("j", "b"))).select("i", "j", V.euclid("a", "b").alias("d"))


KK = VEC + ", k AS (SELECT a.proto AS i, b.proto AS j, sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM p a, p b)"


@query(f"WITH {VEC} SELECT pos, proto, round(dist, 5) AS dist FROM (SELECT pos, proto, {EUCLID} AS dist, row_number() OVER (PARTITION BY pos ORDER BY {EUCLID}, proto) AS k FROM b, p) WHERE k = 1")
def join_nearest_centroid(spark, d):
    return J.nearest_centroid(blocks(spark, d).select("pos", "v"), prototypes(spark, d)).select("pos", "proto", rnd("dist", 5).alias("dist"))


@query(f"WITH {VEC} SELECT pos, proto, round(list_cosine_similarity(v, c), 6) AS cosine, round({EUCLID}, 5) AS euclid, round(exp(-power({EUCLID}, 2) / (2 * 53.633e0 * 53.633e0)), 6) AS rbf FROM b JOIN p ON b.label = p.proto")
def dist_cosine_euclid_rbf(spark, d):
    """dist.cosine/euclid and math.rbf to the block's own prototype."""
    both = blocks(spark, d).join(F.broadcast(prototypes(spark, d)), F.col("label") == F.col("proto"))
    e = V.euclid("v", "c")
    return both.select("pos", "proto", rnd(V.cosine("v", "c")).alias("cosine"), rnd(e, 5).alias("euclid"), rnd(V.rbf(e, 53.633)).alias("rbf"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS l2, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 5) AS l1 FROM embeddings")
def math_l1_l2_norm(spark, d):
    b = blocks(spark, d)
    return b.select(F.col("pos").alias("vec_id"), rnd(V.norm2("v"), 5).alias("l2"), rnd(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


@query(f"WITH {KK}, m AS (SELECT median(d) AS sigma FROM k WHERE i < j) SELECT round(sigma, 5) AS sigma, round(1 / (2 * sigma * sigma), 5) AS gamma FROM m")
def math_median_heuristic(spark, d):
    m = kk(spark, d).where("i < j").agg(F.median("d").alias("s"))
    return m.select(rnd("s", 5).alias("sigma"), rnd(1 / (2 * F.col("s") * F.col("s")), 5).alias("gamma"))


@query(f"WITH {VEC} SELECT a.id, a.pos AS a, b.pos AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 5) AS g FROM b a JOIN b b ON a.id = b.id AND a.pos <= b.pos")
def dist_gram(spark, d):
    b = blocks(spark, d).select("id", "pos", "v")
    other = b.select("id", F.col("pos").alias("b"), F.col("v").alias("w"))
    return b.withColumnRenamed("pos", "a").join(other, "id").where("a <= b").select("id", "a", "b", rnd(V.dot("v", "w"), 5).alias("g"))



@query(f"WITH {VEC} SELECT label % 3 AS g, dim - 1 AS dim, round(avg(m), 6) AS x FROM (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL) GROUP BY ALL")
def agg_reduce_centroids(spark, d):
    return V.long(prototypes(spark, d), "c").groupBy((F.col("proto") % 3).alias("g"), F.col("dim").cast("long").alias("dim")).agg(rnd(F.avg("x")).alias("x"))


@query(f"WITH {KK} SELECT i AS medoid, round(s, 4) AS total FROM (SELECT i, sum(d) AS s FROM k GROUP BY i) ORDER BY s, i LIMIT 1")
def dist_medoid(spark, d):
    return kk(spark, d).groupBy(F.col("i").alias("medoid")).agg(F.sum("d").alias("s")).orderBy("s", "medoid").limit(1).select("medoid", rnd("s", 4).alias("total"))


@query(f"WITH {KK} SELECT least(i % 2, j % 2) AS ga, greatest(i % 2, j % 2) AS gb, i % 2 = j % 2 AS intra, count(*) AS n, round(avg(d), 5) AS mean FROM k WHERE i < j GROUP BY ALL")
def dist_intra_inter_group(spark, d):
    a, b = F.col("i") % 2, F.col("j") % 2
    return kk(spark, d).where("i < j").groupBy(F.least(a, b).alias("ga"), F.greatest(a, b).alias("gb"), (a == b).alias("intra")).agg(F.count("*").alias("n"), rnd(F.avg("d"), 5).alias("mean"))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding WHERE b.label < 5")
def dist_find_subset(spark, d):
    """Rows of a part (five labels) found in the whole by equality of their vectors."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("a"), "embedding").join(e.where("label < 5").select(F.col("vec_id").alias("b"), "embedding"), "embedding").select("a", "b")


# --- 2.10 segmentation, clustering, density, statistics ---


@query(f"WITH {RUN}, g AS (SELECT r.id, r.seg, avg(s.value) AS m, count(*) AS n, sum(s.value * s.value) AS q FROM r JOIN s ON s.id = r.id AND s.pos >= r.s AND s.pos < r.e GROUP BY r.id, r.seg) SELECT id, seg, round(power(m - lag(m) OVER w, 2), 3) AS mmd_before, round(power(m - lead(m) OVER w, 2), 3) AS mmd_after, round(q / (q + lag(q) OVER w), 5) AS ratio FROM g WINDOW w AS (PARTITION BY id ORDER BY seg)")
def cpd_mmd_vs_neighbours(spark, d):
    """cpd.cost_vs_neighbours and mmd_vs_neighbours for the linear kernel."""
    new = F.when(F.col("label") == F.lag("label").over(S.by()), 0).otherwise(1)
    v, w = F.col("value"), W.partitionBy("id").orderBy("seg")
    g = sequences(spark, d).withColumn("new", new).withColumn("seg", F.sum("new").over(S.by())).groupBy("id", "seg").agg(F.avg(v).alias("m"), F.sum(v * v).alias("q"))
    return g.select("id", "seg", rnd(F.pow(F.col("m") - F.lag("m").over(w), 2), 3).alias("mmd_before"), rnd(F.pow(F.col("m") - F.lead("m").over(w), 2), 3).alias("mmd_after"), rnd(F.col("q") / (F.col("q") + F.lag("q").over(w)), 5).alias("ratio"))


@query()
def clu_kmeans(spark, d):
    """k-means by angle and by distance, each the better of two starts; labels do not depend on how rows are dealt."""
    x = stored(blocks(spark, d).select("pos", "v"), "vectors")
    out = None
    for metric, cosine in (("cosine", True), ("euclidean", False)):
        centres, _ = M.kmeans(x, 10, cosine)
        labels = M.nearest(x, centres, cosine).select(F.lit(metric).alias("metric"), "pos", "cluster")
        out = labels if out is None else out.unionByName(labels)
    return out


@query()
def clu_gmm(spark, d):
    """Whole vectors, full covariances."""
    x = stored(blocks(spark, d).select("pos", "v"), "vectors")
    return M.predict(x, M.fit(x, 3, rounds=30)).select("pos", "cluster")


@query()
def clu_bayes_gmm(spark, d):
    """A Dirichlet process of 20 components at most over ten whitened principal components: each block's component, its share, and the component's weight."""
    z, _ = Q.components(blocks(spark, d).select("pos", "v"), 10, True)
    x = stored(z.withColumnRenamed("z", "v"), "vectors")
    model = M.fit(x, 20, process=True)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(model.weights)], "cluster long, weight double")
    return M.predict(x, model).join(F.broadcast(weights), "cluster").select("pos", "cluster", F.col("dist").alias("share"), "weight")


@query()
def clu_gmm_incremental(spark, d):
    """Five Gaussians over ten principal components, fitted block after block: a report for each block, as its fit ends."""
    z, _ = Q.components(blocks(spark, d).select("pos", "v"), 10)
    _, reports = M.incremental(z.withColumnRenamed("z", "v"), 5)
    return spark.createDataFrame([tuple(r.values()) for r in reports], "block long, rows long, rounds long, converged boolean, bound double, aic double, bic double")


@query()
def clu_pca(spark, d):
    """Ten principal components of all blocks."""
    return Q.components(blocks(spark, d).select("pos", "v"), 10)[0]


@query()
def clu_whiten(spark, d):
    """Blocks whitened by one covariance of all of them."""
    return Q.whitened(blocks(spark, d).select("id", "pos", "v"))


SQUARE = "SELECT i, j, CASE WHEN i = j THEN 1e0 ELSE 0e0 END AS cov FROM range({n}) r(i), range({n}) s(j)"


def covariances(spark, rows):
    _, _, cov = Q.covariance(rows)
    # a table of the width squared
    return spark.createDataFrame([(i, j, float(c)) for i, row in enumerate(cov) for j, c in enumerate(row)], "i long, j long, cov double").select("i", "j", (rnd("cov") + 0.0).alias("cov"))


@query(SQUARE.format(n="(SELECT max(len(embedding)) FROM embeddings)"))
def clu_whiten_covariance(spark, d):
    """The covariance of whitened blocks is the identity."""
    return covariances(spark, clu_whiten(spark, d))


@query(SQUARE.format(n="30"))
def clu_pca_covariance(spark, d):
    """Thirty whitened components have variance 1 and no correlation."""
    return covariances(spark, Q.components(blocks(spark, d).select("pos", "v"), 30, True)[0].withColumnRenamed("z", "v"))


@query(f"WITH {VEC}, v AS (SELECT dim, var_samp(x) AS v FROM l GROUP BY dim) SELECT round(sum(v), 5) AS total, count(*) AS components FROM v")
def clu_pca_variance(spark, d):
    """The variances of all components add up to that of the components of the vectors."""
    _, w = Q.components(blocks(spark, d).select("pos", "v"), 1 << 30)
    return spark.createDataFrame([(float(w.sum()), len(w))], "total double, components long").select(rnd("total", 5).alias("total"), "components")


@query(f"WITH {VEC}, q AS (SELECT *, 20000e0 / count(*) OVER () AS share FROM b), s AS (SELECT k::INT AS sample, pos, label, v FROM q, range(5) r(k) WHERE ('0x' || substr(md5(pos || '|' || k), 1, 8))::BIGINT / 4294967296e0 < share), e AS (SELECT a.sample, a.pos, a.label, b.label AS of, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS t, count(*) AS n FROM s a JOIN s b ON a.sample = b.sample GROUP BY ALL), f AS (SELECT sample, pos, max(t / (n - 1)) FILTER (label = of AND n > 1) AS a, min(t / n) FILTER (label <> of) AS b FROM e GROUP BY ALL) SELECT sample, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) AS silhouette FROM f GROUP BY sample")
def eval_silhouette_cohort(spark, d):
    """Silhouettes of all recordings together, on five samples of 20,000 blocks (all blocks, where there are fewer)."""
    return E.silhouettes(blocks(spark, d)).select("sample", "n", rnd("silhouette", 5).alias("silhouette"))


@query()
def clu_spanning_tree(spark, d):
    """The minimum spanning tree of the blocks under mutual reachability (five points, itself counted)."""
    return R.spanning_tree(blocks(spark, d), 5).select("a", "b", rnd("w").alias("w"))


@query()
def clu_tree_cuts(spark, d):
    """Clusters from one tree: single linkage cut to ten, and parts of five points or more below the median edge (the others are noise)."""
    x = stored(blocks(spark, d).select("pos", "v"), "vectors")
    tree = stored(R.spanning_tree(x, 5), "tree")
    reach = tree.agg(F.median("w")).first()[0] or 0.0
    linkage = R.cut(x, tree, 10).select(F.lit("linkage").alias("how"), "pos", "cluster")
    return linkage.unionByName(R.cut(x, tree, None, reach, 5).select(F.lit("density").alias("how"), "pos", "cluster"))


@query()
def clu_spectral(spark, d):
    """Ten spectral clusters of the blocks over the similarities of ten neighbours each."""
    return P.spectral(P.affinities(stored(blocks(spark, d).select("pos", "v"), "vectors")), 10)


FOURIER = "u AS (SELECT k, j, md5(k || '|' || j) AS h FROM range(256) r(k), range(64) s(j)), fw AS (SELECT k, list(sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 0.5e0) / 4294967296e0)) * cos(2 * pi() * ((('0x' || substr(h, 9, 8))::BIGINT + 0.5e0) / 4294967296e0)) / 2e0 ORDER BY j) AS w FROM u GROUP BY k), fb AS (SELECT k, w, 2 * pi() * ((('0x' || substr(md5(k::VARCHAR), 17, 8))::BIGINT + 0.5e0) / 4294967296e0) AS b FROM fw)"


@query(f"WITH {VEC}, {FOURIER}, c AS (SELECT id, pos, v, CASE WHEN label % 3 = lag(label % 3) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM b), sg AS (SELECT id, pos, v, sum(c) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS seg FROM c), z AS (SELECT id, seg, k, avg(cos(list_dot_product(w, v) + b) * sqrt(2e0 / 256)) AS z, avg(cos(list_dot_product(w, v) + b) * cos(list_dot_product(w, v) + b) * 2e0 / 256) AS zz, count(*) AS n FROM sg, fb GROUP BY ALL), m AS (SELECT id, seg, any_value(n) AS n, sum(zz) AS own, list(z ORDER BY k) AS m FROM z GROUP BY ALL), nb AS (SELECT *, lag(m) OVER w AS p, lead(m) OVER w AS q FROM m WINDOW w AS (PARTITION BY id ORDER BY seg)), o AS (SELECT id, seg, n, own, list_dot_product(m, m) AS mm, coalesce(list_dot_product(m, m) - 2 * list_dot_product(m, p) + list_dot_product(p, p), 0) + coalesce(list_dot_product(m, m) - 2 * list_dot_product(m, q) + list_dot_product(q, q), 0) AS mmd, coalesce(own - 2 * list_dot_product(m, p) + list_dot_product(p, p), 0) + coalesce(own - 2 * list_dot_product(m, q) + list_dot_product(q, q), 0) AS about, p IS NULL AND q IS NULL AS alone FROM nb) SELECT id, seg, n, round(mmd, 5) AS mmd, CASE WHEN NOT alone THEN round((own - mm) / (about + 1e-12), 5) END AS cost_ratio FROM o")
def cpd_rbf_vs_neighbours(spark, d):
    """cpd.cost_vs_neighbours and mmd_vs_neighbours of whole vectors under the Gaussian kernel (sigma 2), by 256 Fourier features."""
    new = F.when(F.col("label") % 3 == F.lag(F.col("label") % 3).over(S.by()), 0).otherwise(1)
    rows = blocks(spark, d).withColumn("new", new).withColumn("seg", F.sum("new").over(S.by()))
    means = K.segment_means(K.features(spark, rows, 64, 2.0), ["id", "seg"])
    return K.against_neighbours(means).select("id", "seg", "n", rnd("mmd", 5).alias("mmd"), rnd("cost_ratio", 5).alias("cost_ratio"))


@query(f"WITH {SEQ}, r AS (SELECT id, stddev_pop(value) * 0.2e0 AS r FROM s GROUP BY id), t AS (SELECT id, pos, value AS x0, lead(value, 1) OVER w AS x1, lead(value, 2) OVER w AS x2, lead(value, 3) OVER w AS x3, lead(value, 4) OVER w AS x4 FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)), p AS (SELECT a.id, count(*) AS near, count(*) FILTER (abs(a.x4 - b.x4) <= r.r) AS nearer FROM t a JOIN t b ON a.id = b.id AND a.pos < b.pos JOIN r ON r.id = a.id WHERE a.x4 IS NOT NULL AND b.x4 IS NOT NULL AND abs(a.x0 - b.x0) <= r.r AND abs(a.x1 - b.x1) <= r.r AND abs(a.x2 - b.x2) <= r.r AND abs(a.x3 - b.x3) <= r.r GROUP BY a.id) SELECT r.id, coalesce(near, 0) AS near, coalesce(nearer, 0) AS nearer, CASE WHEN nearer > 0 THEN round(-ln(nearer::DOUBLE / near), 6) END AS entropy FROM r LEFT JOIN p ON p.id = r.id")
def stat_entropy(spark, d):
    """Sample entropy of four places and a fifth of the deviation, of the values."""
    return E.sample_entropy(sequences(spark, d)).withColumn("entropy", rnd("entropy"))


@query(f"WITH {SEQ}, r AS (SELECT id, stddev_pop(label) * 0.2e0 AS r FROM s GROUP BY id), t AS (SELECT id, pos, label AS x0, lead(label, 1) OVER w AS x1, lead(label, 2) OVER w AS x2, lead(label, 3) OVER w AS x3, lead(label, 4) OVER w AS x4 FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)), p AS (SELECT a.id, count(*) AS near, count(*) FILTER (abs(a.x4 - b.x4) <= r.r) AS nearer FROM t a JOIN t b ON a.id = b.id AND a.pos < b.pos JOIN r ON r.id = a.id WHERE a.x4 IS NOT NULL AND b.x4 IS NOT NULL AND abs(a.x0 - b.x0) <= r.r AND abs(a.x1 - b.x1) <= r.r AND abs(a.x2 - b.x2) <= r.r AND abs(a.x3 - b.x3) <= r.r GROUP BY a.id) SELECT r.id, coalesce(near, 0) AS near, coalesce(nearer, 0) AS nearer, CASE WHEN nearer > 0 THEN round(-ln(nearer::DOUBLE / near), 6) END AS entropy FROM r LEFT JOIN p ON p.id = r.id")
def stat_entropy_symbols(spark, d):
    """The same of the symbols, as the survey takes it: equal windows are counted once."""
    return E.sample_entropy(sequences(spark, d), value="label").withColumn("entropy", rnd("entropy"))


SIL = VEC + ", e AS (SELECT a.id, a.pos, a.label, b.label AS other, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) FILTER (a.pos <> b.pos) AS d FROM b a JOIN b b ON a.id = b.id GROUP BY ALL)"


@query(f"WITH {SIL}, f AS (SELECT pos, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM e GROUP BY ALL) SELECT pos, label, round((b - a) / greatest(a, b), 5) AS silhouette FROM f")
def eval_silhouette(spark, d):
    """Silhouettes of blocks among those of their recording."""
    b = blocks(spark, d).select("id", "pos", "label", "v")
    both = b.join(b.toDF("id", "q", "other", "w"), "id").where("pos <> q")
    e = both.groupBy("pos", "label", "other").agg(F.avg(V.euclid("v", "w")).alias("d"))
    f = e.groupBy("pos", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return f.select("pos", "label", rnd((F.col("b") - F.col("a")) / F.greatest("a", "b"), 5).alias("silhouette"))




@query("WITH p AS (SELECT p_brand || p_type AS k0, ((sum(p_partkey) * 7919) % 10007)::BIGINT / 10007e0 AS p FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, k0) AS k, count(*) OVER () AS n FROM p) SELECT k0, round(least(min(p * n / k) OVER (ORDER BY p, k0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r")
def stat_bh(spark, d):
    """Benjamini-Hochberg over a table of tests, one for each group; the windows see those only."""
    p = table(spark, d, "part").groupBy(F.concat("p_brand", "p_type").alias("k0")).agg(((F.sum("p_partkey") * 7919) % 10007 / 10007.0).alias("p"))
    w = W.orderBy("p", "k0")
    r = p.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.orderBy("p", "k0").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return r.select("k0", rnd(F.least(F.min(F.col("p") * F.col("n") / F.col("k")).over(w.rowsBetween(0, W.unboundedFollowing)), F.lit(1.0))).alias("q"))
