"""Queries that need an array kernel: elastic distances, change points, small-table clustering, fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspan.operators import alignment as A
from loomspan.operators import segmentation as G
from loomspan.operators.sequences import by, parted, running_totals, runs, transitions
from loomspan.plans.registry import QUERIES, query
from loomspan.plans.vector import kk
from loomspan.sources.tables import blocks, sequences, table

#: Costs between symbols 1 to 5 and the background 0.
COSTS = np.abs(np.arange(6)[:, None] - np.arange(6)[None]) / 5.0


def cohort(spark, d):
    """(id, q): all sequences, symbols from 1, resampled to the length of the longest by nearest place."""
    g = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("q"))
    places = (g.agg(F.max(F.size("q"))).first()[0] or 1) - 1
    at = lambda i: F.rint(i * (F.size("q") - 1) / F.lit(float(max(places, 1)))).cast("int")
    return g.select("id", F.transform(F.sequence(F.lit(0), F.lit(places)), lambda i: F.get("q", at(i)) + 1).alias("q"))


def neighbours(spark, d):
    """Each recording with the next one by id: numbered by running totals, joined by number."""
    c = cohort(spark, d).withColumn("one", F.lit(1).cast("long"))
    ids = c.select("id", "one")
    k = running_totals(ids, parted(ids, "id"), ["id"], ["one"]).select("id", F.col("before_one").alias("k"))
    both = c.select("id", "q").join(k, "id")
    return both.select(F.col("id").alias("a"), F.col("q").alias("x"), (F.col("k") + 1).alias("k")).join(both.select(F.col("id").alias("b"), F.col("q").alias("y"), "k"), "k").drop("k")


@query()
def dist_rtwe_pairwise(spark, d):
    return A.all_pairs(cohort(spark, d), COSTS)


@query()
def dist_rtwe_banded(spark, d):
    """dist.bounding: a Sakoe-Chiba band."""
    return A.all_pairs(cohort(spark, d), COSTS, kind="sakoe", share=0.2)


@query()
def dist_rtwe_parallelogram(spark, d):
    """dist.bounding: an Itakura parallelogram; the cohort is of one length."""
    return A.all_pairs(cohort(spark, d), COSTS, kind="itakura", share=0.3)


@query()
def dist_eshape_dtw(spark, d):
    """Every window of 8 symbols counts, whatever its start."""
    return A.all_pairs(cohort(spark, d), COSTS, "eshape", width=8, step=1)


@query()
def dist_rtwe_path(spark, d):
    """dist.rtwe_path and dist.backtrack: cells of the alignment of each recording with the next; as many pairs at once as tables are held."""

    def run(frames):
        for f in frames:
            a, b, x, y = (f[c].to_numpy() for c in ("a", "b", "x", "y"))
            few = max(1, A.CELLS // (len(x[0]) + 1) ** 2) if len(f) else 1
            for k in range(0, len(f), few):
                row, i, j, cost = A.edit_paths(np.stack(x[k : k + few]).astype(int), np.stack(y[k : k + few]).astype(int), COSTS)
                yield pd.DataFrame({"a": a[k + row], "b": b[k + row], "i": i, "j": j, "cost": cost})

    return neighbours(spark, d).mapInPandas(run, "a long, b long, i long, j long, cost double")


@query()
def dist_dba_barycenter(spark, d):
    """The time-warp edit barycentre of each market segment, from the train half of its recordings."""
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    return A.barycenters(A.train_half(cohort(spark, d).join(seg, "id").select("g", "id", "q")), COSTS).withColumn("cost", F.round("cost", 6))


@query()
def cpd_kernel_pelt(spark, d):
    """One recording is one group; with the linear kernel a row of costs comes from prefix sums."""

    def run(pdf):
        x = pdf.sort_values("pos")["value"].to_numpy()[:, None] / 25.0
        cuts, _ = G.change_points(x, 2 * np.log(max(len(x), 2)))
        return pd.DataFrame({"id": pdf["id"].iloc[0], "seg": np.arange(len(cuts) - 1), "s": cuts[:-1], "e": cuts[1:]})

    return sequences(spark, d).select("id", "pos", "value").groupBy("id").applyInPandas(run, "id long, seg long, s long, e long")


#: (kernel, jump, mode, value): how a recording is cut. Modes: a constant, one times log n, one of the recording (by its
#: number), one of its modality (by label of the first event), twice the global slope of the risk, a number of changes.
EXPERIMENTS = [(k, j, mode, v) for k, j in (("linear", 1), ("cosine", 1), ("rbf", 1), ("rbf", 5)) for mode, v in (("constant", 1.0), ("log", 0.5), ("personalized", 0.25), ("modality", 0.5), ("slope", -9.746668895818161e-05), ("calibration", 4.0))]


def penalty_of(mode: str, value: float, n: int, number: int, first: int) -> float:
    return {"constant": value, "log": value * np.log(max(n, 2)), "personalized": value * (1 + number % 4), "modality": value * (1 + first), "slope": -2 * value * n}[mode]


def ordered(spark, d):
    """(id, label, value): a recording is one row, its symbols and values in order."""
    rows = sequences(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "value"))).alias("x"))
    return rows.select("id", "x.label", "x.value")


@query()
def cpd_kernel_grid(spark, d):
    """cpd.kernel_pelt and cpd.deploy: each recording under each experiment, kernels, jumps and penalty modes.

    A recording is dealt once; the experiments, a parameter table, go with the function. Recordings of about one length are cut
    together, and under one kernel all penalties share the costs.
    """

    def run(frames):
        for f in frames:
            xs = [np.column_stack([np.asarray(v, np.float64) / 25.0, np.eye(5)[np.asarray(s, int)]]) for v, s in zip(f["value"], f["label"], strict=True)]
            gammas = [G.median_gamma(x) for x in xs]
            for kernel, jump in dict.fromkeys(e[:2] for e in EXPERIMENTS):
                own = [(mode, v) for k, j, mode, v in EXPERIMENTS if (k, j) == (kernel, jump)]
                free, (changes,) = [e for e in own if e[0] != "calibration"], [int(v) for mode, v in own if mode == "calibration"]
                lam = np.array([[penalty_of(mode, v, len(x), int(i), int(s[0])) for mode, v in free] for x, i, s in zip(xs, f["id"], f["label"], strict=True)]).reshape(len(xs), -1)
                rows = []
                for i, weights, cuts in zip(f["id"], lam, G.change_points_many(xs, lam, kernel, 2, jump, changes, gammas), strict=True):
                    rows += [(i, kernel, jump, mode, c, total - w * (len(c) - 2), total) for (mode, _), w, (c, total) in zip(free, weights, cuts)]
                    rows.append((i, kernel, jump, "calibration", cuts[-1][0], cuts[-1][1], cuts[-1][1]))
                yield pd.DataFrame(rows, columns=["id", "kernel", "jump", "mode", "cuts", "fit", "total"])

    return ordered(spark, d).mapInPandas(run, "id long, kernel string, jump int, mode string, cuts array<long>, fit double, total double")


@query()
def cpd_deploy_decomposition(spark, d):
    """cpd.deploy and cpd.cost_decomposition: each recording under a table of penalties, which goes with the function."""
    grid = np.array([1.0, 5.0, 25.0])

    def run(frames):
        for f in frames:
            xs = [np.asarray(v, np.float64)[:, None] / 25.0 for v in f["value"]]
            cuts = G.change_points_many(xs, np.tile(grid, (len(xs), 1)))
            rows = [(i, lam, len(c), total - lam * (len(c) - 2), total) for i, own in zip(f["id"], cuts, strict=True) for lam, (c, total) in zip(grid.tolist(), own, strict=True)]
            yield pd.DataFrame(rows, columns=["id", "penalty", "n_cpts", "fit", "total"])

    return ordered(spark, d).mapInPandas(run, "id long, penalty double, n_cpts long, fit double, total double")


@query()
def clu_twfinch(spark, d):
    """Eight segments of each recording's blocks by temporally weighed nearest neighbours; a recording is one group."""

    def run(pdf):
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"id": pdf["id"], "pos": pdf["pos"], "cluster": G.temporal_neighbours(np.stack(pdf["v"]), 8)})

    return blocks(spark, d).select("id", "pos", "v").groupBy("id").applyInPandas(run, "id long, pos long, cluster long")


@query()
def clu_kmeans_personalized(spark, d):
    def run(pdf):
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"id": pdf["id"], "pos": pdf["pos"], "cluster": G.kmeans(np.stack(pdf["v"]), 5)})

    return blocks(spark, d).groupBy("id").applyInPandas(run, "id long, pos long, cluster long")


def small(spark, d) -> np.ndarray:
    """The K x K distance table of the prototypes, on the driver: K is the number of labels of a codebook."""
    rows = kk(spark, d).collect()
    keys = sorted({r["i"] for r in rows})
    out = np.zeros((len(keys), len(keys)))
    for r in rows:
        out[keys.index(r["i"]), keys.index(r["j"])] = r["d"]
    return out


@query()
def clu_small_table(spark, d):
    """clu.hac, clu.spectral/dbscan, clu.run_comparison: a grid of models on the prototype table."""
    x = small(spark, d)
    w = np.exp(-(x**2) / (2 * np.median(x[x > 0]) ** 2))
    models = {**{f"hac_{m}_{k}": G.linkage_labels(x, k, m) for m in ("complete", "average", "single") for k in (3, 5)}, "dbscan": G.density_labels(x, float(np.median(x)), 3), "spectral_3": G.spectral_labels(w, 3)}
    return spark.createDataFrame([(m, i, int(v)) for m, labels in models.items() for i, v in enumerate(labels)], "model string, proto int, cluster int")


@query()
def eval_matrix_stats(spark, d):
    """Rank, effective rank, spectral gap, and whether the triangle inequality holds."""
    x = small(spark, d)
    stats = G.matrix_stats(x) | {"triangle": float((x[:, :, None] <= x[:, None, :] + x.T[None] + 1e-9).all())}
    return spark.createDataFrame(list(stats.items()), "stat string, value double")


@query()
def clu_inconsistency(spark, d):
    """stat.correlated metrics: by depth, the threshold at which a tenth of the merges is inconsistent, and the clusters of that cut."""
    tree = G.merges(small(spark, d))
    rows = []
    for depth in (2, 3, 4, 5, 6, 7, 8, 10):
        t = float(np.percentile(G.inconsistency(tree, depth), 90))
        rows.append((depth, t, int(G.inconsistent_labels(tree, t, depth).max()) + 1))
    return spark.createDataFrame(rows, "depth int, threshold double, clusters int")


def chances(spark, d) -> np.ndarray:
    """Probabilities of transitions between states, on the driver: K x K for the states there are."""
    rows = transitions(sequences(spark, d)).collect()
    k = 1 + max(max(r["i"], r["j"]) for r in rows)
    p = np.zeros((k, k))
    for r in rows:
        p[r["i"], r["j"]] = r["p"]
    return p


@query()
def graph_tree_merge(spark, d):
    """The tree of states merged by the likeliest transition or the least cost (less the log of it), and the bags of its cut at three."""
    p = chances(spark, d)
    both, rows = (p + p.T) / 2, []
    for how, x in (("max_p", 1 - both), ("min_cost", -np.log(np.maximum(both, 1e-12)))):
        tree, bags = G.merges(x, "average"), G.linkage_labels(x, 3, "average")
        rows += [(how, "merge", len(p) + k, [int(a), int(b)], float(h)) for k, (a, b, h, _) in enumerate(tree)]
        rows += [(how, "bag", int(g), np.flatnonzero(bags == g).tolist(), None) for g in range(bags.max() + 1)]
    return spark.createDataFrame(rows, "how string, kind string, node int, states array<int>, height double")


@query()
def dist_ot_projection(spark, d):
    """Blocks of a recording to prototypes by an approximate transport plan (Sinkhorn), not exact."""
    from loomspan.plans.vector import prototypes

    p = np.stack([np.asarray(r["c"]) for r in prototypes(spark, d).orderBy("proto").collect()])

    def run(pdf):
        x = np.stack(pdf["v"])
        plan = G.sinkhorn(((x[:, None] - p[None]) ** 2).sum(-1))
        return pd.DataFrame({"id": pdf["id"], "pos": pdf["pos"], "proto": plan.argmax(1)})

    return blocks(spark, d).select("id", "pos", "v").groupBy("id").applyInPandas(run, "id long, pos long, proto long")


@query()
def dist_gromov_wasserstein(spark, d):
    """Approximate discrepancy of the time densities of all pairs of symbols, on a grid of 64 places each."""
    k = QUERIES["dens_kde"](spark, d).where("size = 64").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x", "density"))).alias("g"))
    rows = k.toDF("i", "a").crossJoin(F.broadcast(k.toDF("j", "b"))).where("i < j")

    def run(frames):
        for f in frames:
            out = []
            for i, j, a, b in zip(f["i"], f["j"], f["a"], f["b"], strict=True):
                (s, p), (t, q) = ((np.array([r[c] for r in g]) for c in ("x", "density")) for g in (a, b))
                out.append((i, j, G.gromov_wasserstein(np.abs(s[:, None] - s[None]), np.abs(t[:, None] - t[None]), a=p + 1e-9, b=q + 1e-9)))
            yield pd.DataFrame(out, columns=["i", "j", "d"])

    return rows.mapInPandas(run, "i long, j long, d double")


@query()
def join_hungarian(spark, d):
    """Labels matched to the labels before them by most common co-occurrence: K x K counts for the labels there are."""
    c = sequences(spark, d).select(F.col("label").alias("g"), F.lag("label").over(by()).alias("p")).where("p IS NOT NULL").groupBy("g", "p").agg(F.count("*").alias("n")).collect()
    gain = np.zeros((1 + max(max(r["g"], r["p"]) for r in c),) * 2)
    for r in c:
        gain[r["g"], r["p"]] = r["n"]
    return spark.createDataFrame(G.matching(gain), "g long, p long")


@query()
def stat_mixed_model(spark, d):
    """Log run lengths by group with a random intercept for each recording: group means, ICC, and a likelihood ratio test of the group.

    What the likelihood needs is added up by group and number of runs before it reaches the driver, so its size does not
    grow with the recordings.
    """
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    y = runs(sequences(spark, d)).join(seg, "id").select("g", "id", F.log(F.col("e") - F.col("s")).alias("y"))
    unit = y.groupBy("g", "id").agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("w"))
    rows = unit.groupBy("g", "n").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum("w").alias("w")).orderBy("g", "n").collect()
    stats, groups = np.array([[r["n"], r["k"], r["m"], r["mm"], r["w"]] for r in rows], float), np.array([r["g"] for r in rows])
    full, beta, tau, sigma = G.random_intercept(stats, groups)
    null = G.random_intercept(stats, np.zeros(len(stats)))[0]
    names = sorted(set(groups))
    ratio = 2 * (full - null)
    out = [(g, float(b), tau / (tau + sigma), ratio, G.chi2_tail(ratio, len(names) - 1)) for g, b in zip(names, beta, strict=True)]
    return spark.createDataFrame(out, "g string, mean double, icc double, lr double, p double")


@query()
def cpd_fit_sigmoid(spark, d):
    """Survival of run lengths by symbol, a sigmoid fitted to it, and its bends."""

    def run(pdf):
        pdf = pdf.sort_values("len")
        y = pdf["n"][::-1].cumsum()[::-1].to_numpy(float) / pdf["n"].sum()
        top, k, x0 = G.sigmoid_fit(pdf["len"].to_numpy(float), y)
        bend = np.log(2 + 3**0.5) / k if k else np.nan
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "top": [top], "k": [k], "x0": [x0], "low": [x0 - bend], "high": [x0 + bend]})

    r = runs(sequences(spark, d)).groupBy("label", (F.col("e") - F.col("s")).alias("len")).agg(F.count("*").alias("n"))
    return r.groupBy("label").applyInPandas(run, "label long, top double, k double, x0 double, low double, high double")
