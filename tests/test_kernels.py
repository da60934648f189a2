"""The queries without SQL against plain loops over a few rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row

from loomspan.operators import segmentation as G
from loomspan.plans import domain, kernels, measures, streams, vector
from loomspan.sources import annotations as N
from loomspan.sources import tables as T
from tests.test_operators import COSTS, partitions, slow_cost, slow_edit

SYMBOLS = ("click", "error", "purchase", "signup", "view")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(67)
    return {u: [(int(rng.integers(5)), round(float(rng.exponential(40)), 2)) for _ in range(4 + u % 5)] for u in range(1, 9)}


@pytest.fixture(scope="module")
def sf(spark, data, tmp_path_factory):
    at = tmp_path_factory.mktemp("few")
    rows, k = [], itertools.count()
    for u, events in data.items():
        rows += [(next(k), u, f"2024-01-01 00:00:{i:02d}", SYMBOLS[s], v) for i, (s, v) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").write.parquet(f"{at}/events.parquet")
    rng = np.random.default_rng(71)
    centres = rng.normal(0, 4, (3, 6))
    spark.createDataFrame([(i, [float(z) for z in centres[i % 3] + rng.normal(size=6)], i % 3) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(u, "ab"[u % 2]) for u in data], "c_custkey long, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    return str(at)


def cohort(data):
    longest = max(map(len, data.values())) - 1
    return {u: np.array([e[round(i * (len(e) - 1) / longest)][0] + 1 for i in range(longest + 1)]) for u, e in data.items()}


def test_elastic_distances(spark, sf, data):
    q = cohort(data)
    got = {(r["a"], r["b"]): r["d"] for r in kernels.dist_rtwe_pairwise(spark, sf).collect()}
    assert sorted(got) == list(itertools.combinations(sorted(q), 2))
    assert all(np.isclose(d, slow_edit(q[a], q[b])[-1, -1]) for (a, b), d in got.items())
    for name in ("dist_rtwe_banded", "dist_rtwe_parallelogram"):
        banded = {(r["a"], r["b"]): r["d"] for r in getattr(kernels, name)(spark, sf).collect()}
        assert sorted(banded) == sorted(got) and all(banded[k] >= got[k] - 1e-12 for k in got)
    cells = kernels.dist_rtwe_path(spark, sf).collect()
    users = sorted(q)
    assert {(r["a"], r["b"]) for r in cells} == set(itertools.pairwise(users))
    for a, b in itertools.pairwise(users):
        t, own = slow_edit(q[a], q[b]), [r for r in cells if r["a"] == a]
        assert (own[0]["i"], own[0]["j"]) == (0, 0) and (own[-1]["i"], own[-1]["j"]) == (len(q[a]), len(q[b]))
        assert all(np.isclose(r["cost"], t[r["i"], r["j"]]) for r in own)


def test_medoid_is_the_least_total(spark, sf, data):
    from loomspan.operators.alignment import warp

    q = cohort(data)
    for r in domain.baseline_medoid(spark, sf).collect():
        members = [u for u in q if "ab"[u % 2] == r["g"]]
        total = {u: sum(warp(q[u], q[w], COSTS)[-1, -1] for w in members if w != u) for u in members}
        assert np.isclose(total[r["medoid"]], min(total.values())) and np.isclose(r["total"], min(total.values()))


def test_change_point_queries(spark, sf, data):
    for r in kernels.cpd_deploy_decomposition(spark, sf).collect():
        x = np.array([v for _, v in data[r["id"]]])[:, None] / 25
        c = slow_cost(x, "linear", 1.0)
        best = min(sum(c(a, b) for a, b in itertools.pairwise(p)) + r["penalty"] * (len(p) - 2) for p in partitions(len(x), 2, 1))
        assert np.isclose(r["total"], best) and np.isclose(r["fit"] + r["penalty"] * (r["n_cpts"] - 2), r["total"])
    segments = {}
    for r in kernels.cpd_kernel_pelt(spark, sf).orderBy("id", "seg").collect():
        segments.setdefault(r["id"], []).append((r["s"], r["e"]))
    assert {u: (s[0][0], s[-1][1]) for u, s in segments.items()} == {u: (0, len(e)) for u, e in data.items()}
    assert all(a[1] == b[0] for s in segments.values() for a, b in itertools.pairwise(s))
    rows = kernels.cpd_kernel_grid(spark, sf).collect()
    assert len(rows) == len(data) * len(kernels.EXPERIMENTS)
    value = {e[:3]: e[3] for e in kernels.EXPERIMENTS}
    for r in rows:
        e, n = data[r["id"]], len(data[r["id"]])
        x = np.column_stack([[v / 25 for _, v in e], np.eye(5)[[s for s, _ in e]]])
        c, v = slow_cost(x, r["kernel"], G.median_gamma(x)), value[r["kernel"], r["jump"], r["mode"]]
        every = list(partitions(n, 2, r["jump"]))
        fit = lambda p: sum(c(a, b) for a, b in itertools.pairwise(p))  # noqa: B023, E731
        if r["mode"] == "calibration":
            most = min(int(v), max(map(len, every)) - 2)
            assert np.isclose(r["total"], min(fit(p) for p in every if len(p) == most + 2))
            continue
        penalty = {"constant": v, "log": v * math.log(n), "personalized": v * (1 + r["id"] % 4), "modality": v * (1 + e[0][0]), "slope": -2 * v * n}[r["mode"]]
        assert np.isclose(r["total"], min(fit(p) + penalty * (len(p) - 2) for p in every)) and np.isclose(r["fit"] + penalty * (len(r["cuts"]) - 2), r["total"])


def test_clusters(spark, sf):
    v = np.array([r["v"] for r in T.blocks(spark, sf).orderBy("pos").collect()])
    for metric in ("cosine", "euclidean"):
        got = {r["pos"]: r["cluster"] for r in vector.clu_kmeans(spark, sf).where(f"metric = '{metric}'").collect()}
        labels = np.array([got[i] for i in range(120)])
        x = v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v
        means = {k: x[labels == k].mean(0) for k in set(labels)}
        near = {i: min(means, key=lambda k: (np.linalg.norm(x[i] - means[k]) if metric == "euclidean" else -(x[i] @ means[k]) / np.linalg.norm(means[k]))) for i in range(120)}
        assert np.mean([near[i] == labels[i] for i in range(120)]) > 0.97  # a fixed point of Lloyd's step, but for ties
        assert all(len({int(i) % 3 for i in np.flatnonzero(labels == k)}) == 1 for k in means)  # no cluster mixes the planted ones
    for name in ("clu_kmeans_personalized", "clu_twfinch"):
        rows = getattr(kernels, name)(spark, sf).collect()
        assert {(r["id"], r["pos"]) for r in rows} == {(i // 50, i) for i in range(120)}
    z = np.stack([r["z"] for r in vector.clu_pca(spark, sf).orderBy("pos").collect()])
    _, axes = np.linalg.eigh(np.cov(v.T))
    assert np.allclose(np.abs(z), np.abs((v - v.mean(0)) @ axes[:, ::-1]), atol=1e-6)
    gmm = [r["cluster"] for r in vector.clu_gmm(spark, sf).orderBy("pos").collect()]
    assert len(gmm) == 120 and len(set(gmm)) > 1
    p = np.stack([v[np.arange(120) % 3 == k].mean(0) for k in range(3)])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    stats = {r["stat"]: r["value"] for r in kernels.eval_matrix_stats(spark, sf).collect()}
    s = np.linalg.svd(d, compute_uv=False)
    assert stats["rank"] == 3 and stats["triangle"] == 1 and np.isclose(stats["effective_rank"], np.exp(-(s / s.sum() * np.log(s / s.sum())).sum()))
    assert [r["depth"] for r in kernels.clu_inconsistency(spark, sf).orderBy("depth").collect()] == [2, 3, 4, 5, 6, 7, 8, 10]
    plan = kernels.dist_ot_projection(spark, sf).collect()
    assert len(plan) == 120


def test_tables_of_labels(spark, sf, data):
    n, p = np.zeros((5, 5)), np.zeros((5, 5))
    for e in data.values():
        for (a, _), (b, _) in itertools.pairwise(e):
            n[b, a] += 1
            p[a, b] += a != b
    best = max(sum(n[i, q[i]] for i in range(5)) for q in itertools.permutations(range(5)))
    assert sum(n[r["g"], r["p"]] for r in kernels.join_hungarian(spark, sf).collect()) == best
    assert np.allclose(kernels.chances(spark, sf), p / np.maximum(p.sum(1, keepdims=True), 1))
    rows = kernels.graph_tree_merge(spark, sf).collect()
    for how in ("max_p", "min_cost"):
        bags = [r["states"] for r in rows if r["how"] == how and r["kind"] == "bag"]
        assert sorted(sum(bags, [])) == list(range(5)) and len(bags) == 3
        assert len([r for r in rows if r["how"] == how and r["kind"] == "merge"]) == 4


def test_statistics(spark, sf, data):
    got = {r["id"]: r["entropy"] for r in vector.stat_entropy(spark, sf).collect()}
    for u, e in data.items():
        x = np.array([v for _, v in e])
        count = lambda m: sum(max(abs(x[i + k] - x[j + k]) for k in range(m)) <= 0.2 * x.std() for i in range(len(x) - 4) for j in range(i + 1, len(x) - 4))  # noqa: B023, E731
        a, b = count(5), count(4)
        assert got[u] is None if not a or not b else np.isclose(got[u], -math.log(a / b), atol=1e-6)
    rows = kernels.stat_mixed_model(spark, sf).collect()
    y, unit, group = [], [], []
    for u, e in data.items():
        for _, run in itertools.groupby(e, key=lambda s: s[0]):
            y.append(math.log(len(list(run))))
            unit.append(u)
            group.append("ab"[u % 2])
    stats = np.array([[len(v), 1, v.mean(), v.mean() ** 2, ((v - v.mean()) ** 2).sum()] for u in data for v in [np.array([t for t, w in zip(y, unit) if w == u])]])
    full = G.random_intercept(stats, np.array(["ab"[u % 2] for u in data]))
    null = G.random_intercept(stats, np.zeros(len(stats)))
    assert {r["g"] for r in rows} == set(group) and np.isclose(rows[0]["lr"], 2 * (full[0] - null[0])) and np.isclose(rows[0]["p"], G.chi2_tail(rows[0]["lr"], 1))
    fits = kernels.cpd_fit_sigmoid(spark, sf).collect()
    assert all(r["low"] <= r["x0"] <= r["high"] or r["k"] <= 0 for r in fits)
    d = {(r["i"], r["j"]): r["d"] for r in kernels.dist_gromov_wasserstein(spark, sf).collect()}
    assert set(d) == set(itertools.combinations(sorted({s for e in data.values() for s, _ in e}), 2)) and all(x >= 0 for x in d.values())


def test_gromov_wasserstein_knows_shifts():
    t = np.arange(8.0)
    c = np.abs(t[:, None] - t[None])
    assert G.gromov_wasserstein(c, c[::-1, ::-1]) < 0.5 * G.gromov_wasserstein(c, 3 * c)


def test_tracking(spark, sf, data):
    got = {(r["id"], r["pos"], r["k"]): r["track"] for r in streams.join_greedy_tracking(spark, sf).collect()}
    for u, e in data.items():
        before, fresh = {}, 0
        for pos in range((len(e) + 1) // 2):
            free, now = dict(before), {}
            for k, (s, v) in enumerate(e[2 * pos : 2 * pos + 2]):
                here = (v % 10, float(s))
                best = min(free, key=lambda t: (math.dist(free[t], here) ** 2, t), default=None)
                if best is None or math.dist(free[best], here) > 4:
                    best, fresh = fresh, fresh + 1
                else:
                    free.pop(best)
                now[best] = here
                assert got[u, pos, k] == best
            before = now


def test_lags_over_all_shifts():
    rng = np.random.default_rng(73)
    for n in (1, 2, 7, 20):
        x, y = rng.normal(size=n), rng.normal(size=n)
        lags = range(-(n - 1), n)
        c = [sum(x[i] * y[i - k] for i in range(n) if 0 <= i - k < n) / (np.linalg.norm(x) * np.linalg.norm(y)) for k in lags]
        lag, score = measures.lag_of(x, y)
        assert lag == list(lags)[int(np.argmax(c))] and np.isclose(score, max(c))
    assert np.isnan(measures.lag_of(np.zeros(3), np.ones(3))[0])


def test_names_and_shapes(spark):
    df = spark.createDataFrame([("a_b_c_d_cooking_Phone_v",)], "name string")
    with pytest.raises(Exception, match="invalid modality"):
        df.select(N.identifier("name")).collect()
    assert df.select(N.identifier("name", False).alias("p")).first()["p"]["modality"] is None
    bad = spark.createDataFrame([Row(q=[[1, 2], [3]])])
    with pytest.raises(Exception, match="different lengths"):
        N.shapes(bad, "q").select("dims").collect()
    with pytest.raises(TypeError):
        N.shapes(spark.createDataFrame([Row(q=["a"])]), "q")
    assert [tuple(r) for r in N.shapes(spark.createDataFrame([Row(q=[[1, 2], [3, 4], [5, 6]])]), "q").select("n", "dims").collect()] == [(3, 2)]


def test_running_totals_keep_to_their_parts(spark):
    from loomspan.operators import sequences as S

    rng = np.random.default_rng(79)
    values = sorted(set(np.round(rng.exponential(10, 500), 2).tolist()))
    df = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)], "v double, n long")
    got = {r["v"]: r["before_n"] for r in S.running_totals(df, S.parted(df, "v", 8), ["v"], ["n"]).collect()}
    assert got == dict(zip(values, np.cumsum([0, *(i % 5 for i in range(len(values) - 1))]).tolist()))


@pytest.mark.parametrize(("kernel", "jump"), [("linear", 1), ("cosine", 1), ("rbf", 1), ("rbf", 5)])
def test_recordings_cut_together_are_cut_as_alone(kernel, jump):
    rng = np.random.default_rng(83)
    xs = [rng.normal(size=(n, 3)).cumsum(0) for n in (1, 2, 3, 4, 7, 30, 31, 55, 60, 60, 1003)]
    lam = rng.uniform(0.1, 3, (len(xs), 3))
    for x, own, p in zip(xs, G.change_points_many(xs, lam, kernel, 2, jump, 4), lam, strict=True):
        alone = [G.change_points(x, v, kernel, 2, jump) for v in p] + [G.fixed_change_points(x, 4, kernel, 2, jump)]
        assert [c for c, _ in own] == [c for c, _ in alone] and np.allclose([t for _, t in own], [t for _, t in alone])
