import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import alignment as A
from loomspan.operators import joins as J
from loomspan.operators import segmentation as G
from loomspan.operators import sequences as S
from loomspan.plans import kernels, vector
from loomspan.sources import matrix as X
from loomspan.sources import tables as T
from loomspan.streaming import streams

COSTS = np.abs(np.arange(6)[:, None] - np.arange(6)[None]) / 5.0


def slow_edit(x, y, nu=A.NU, lam=A.LAMBDA):
    x, y = [0, *x], [0, *y]
    d = np.full((len(x), len(y)), np.inf)
    d[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            if i:
                d[i, j] = min(d[i, j], d[i - 1, j] + COSTS[x[i - 1], x[i]] + nu + lam)
            if j:
                d[i, j] = min(d[i, j], d[i, j - 1] + COSTS[y[j - 1], y[j]] + nu + lam)
            if i and j:
                d[i, j] = min(d[i, j], d[i - 1, j - 1] + COSTS[x[i], y[j]] + COSTS[x[i - 1], y[j - 1]] + 2 * nu * abs(i - j))
    return d


def test_time_warp_edit_is_the_textbook_one():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5), (7, 4), (9, 9)):
        x, y = rng.integers(1, 6, n), rng.integers(1, 6, m)
        want = slow_edit(x, y)
        assert np.allclose(A.time_warp_edit(x, y, COSTS), want)
        assert np.isclose(A.time_warp_edits(x[None], y[None], COSTS)[0], want[-1, -1])
        assert np.isclose(A.time_warp_edits(y[None], x[None], COSTS)[0], want[-1, -1])
        assert A.time_warp_edits(x[None], x[None], COSTS)[0] == 0
        assert A.time_warp_edits(x[None], y[None], COSTS, kind="sakoe", share=0.5)[0] >= want[-1, -1] - 1e-12
        p = A.path(want)
        assert p[0] == (0, 0) and p[-1] == (n, m) and all(b[0] - a[0] in (0, 1) and b[1] - a[1] in (0, 1) and a != b for a, b in zip(p, p[1:]))


def test_triangle_of_the_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y, z = (rng.integers(1, 6, 6)[None] for _ in range(3))
        d = lambda a, b: A.time_warp_edits(a, b, COSTS)[0]
        assert d(x, z) <= d(x, y) + d(y, z) + 1e-9


def test_warps_and_bands():
    x, y = np.array([1, 2, 3, 3]), np.array([1, 3, 3])
    assert np.allclose(A.warp(x, y, COSTS), A.warps(COSTS[x[:, None], y[None]][None])[0])
    assert A.band(5, 5, "itakura", 0.5)[0, 0] and A.band(5, 5, "itakura", 0.5)[4, 4] and not A.band(9, 9, "sakoe", 0.1)[0, 8]
    with pytest.raises(ValueError):
        A.band(3, 4, "itakura")
    assert A.shape_warps(np.array([[1, 2, 3, 4, 5, 1, 2, 3]]), np.array([[1, 2, 3, 4, 5, 1, 2, 3]]), COSTS)[0] == 0


def test_late_components_count(spark, monkeypatch):
    rng = np.random.default_rng(41)
    rows = [(0, i, i % 3, [1.0] * 9 + [float(z) for z in rng.normal(20 * (i % 3), 1, 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, pos long, label long, v array<double>")
    monkeypatch.setattr(vector, "blocks", lambda *_: df)
    v = np.stack([r["v"] for r in vector.clu_whiten(spark, "").orderBy("pos").collect()])
    assert v.shape == (90, 12) and np.allclose(np.cov(v[:, 9:].T), np.eye(3), atol=1e-6)
    found = {r["pos"]: r["cluster"] for r in vector.clu_gmm(spark, "").collect()}
    assert len(found) == 90 and len(set(found.values())) > 1


def test_shape_warps_compares_windows():
    rng = np.random.default_rng(37)
    for n, m, step in ((9, 12, 1), (13, 8, 2), (5, 11, 1), (24, 17, 4), (1, 1, 1)):
        x, y = rng.integers(1, 6, (6, n)), rng.integers(1, 6, (6, m))
        for a, b, got in zip(x, y, A.shape_warps(x, y, COSTS, 8, step), strict=True):
            cut = lambda s: np.lib.stride_tricks.sliding_window_view(s, min(8, len(s)))[::step]  # noqa: B023, E731
            inner = np.array([[slow_edit(p, q)[-1, -1] for q in cut(b)] for p in cut(a)])
            assert np.isclose(got, A.warps(inner[None])[0, -1, -1])


def test_shape_query_sees_every_window(spark, monkeypatch):
    rows = [(1, [1] * 17), (2, [1] * 8 + [5] + [1] * 8), (3, [1] * 16 + [5])]
    monkeypatch.setattr(kernels, "cohort", lambda *_: spark.createDataFrame(rows, "id long, q array<int>"))
    got = {(r["a"], r["b"]): r["d"] for r in kernels.dist_eshape_dtw(spark, "").collect()}
    x = dict(rows)
    for (a, b), d in got.items():
        assert np.isclose(d, A.shape_warps(np.array([x[a]]), np.array([x[b]]), COSTS, 8, 1)[0])
    assert len(got) == 3 and min(got.values()) > 0


@pytest.mark.parametrize("cells", [1, 500, A.CELLS])  # a pair and a row at once, some, all
def test_distances_in_bounded_memory(monkeypatch, cells):
    monkeypatch.setattr(A, "CELLS", cells)
    rng = np.random.default_rng(43)
    x = [rng.integers(1, 6, n).tolist() for n in (3, 9, 17, 9, 0, 0)]
    y = [rng.integers(1, 6, n).tolist() for n in (5, 12, 17, 12, 4, 0)]
    got = A.distances(x, y, COSTS, "rtwe")
    assert np.allclose(got[:4], [slow_edit(np.array(a), np.array(b))[-1, -1] for a, b in zip(x[:4], y)]) and got[4] == np.inf and got[5] == 0
    assert np.allclose(A.distances(x[:4], y[:4], COSTS, "dtw"), [A.warp(np.array(a), np.array(b), COSTS)[-1, -1] for a, b in zip(x[:4], y)])
    for step in (1, 3):
        for a, b, d in zip(x[:4], y, A.distances(x[:4], y[:4], COSTS, "eshape", width=4, step=step)):
            cut = lambda s: np.lib.stride_tricks.sliding_window_view(s, min(4, len(s)))[::step]  # noqa: B023, E731
            inner = np.array([[slow_edit(p, q)[-1, -1] for q in cut(b)] for p in cut(a)])
            assert np.isclose(d, A.warps(inner[None])[0, -1, -1])
    for kind, share, n in (("sakoe", 0.2, 12), ("itakura", 0.4, 12)):
        a, b = rng.integers(1, 6, n), rng.integers(1, 6, n)
        assert np.isclose(A.distances([a.tolist()], [b.tolist()], COSTS, "rtwe", kind=kind, share=share)[0], A.time_warp_edit(a, b, COSTS, kind=kind, share=share)[-1, -1])


def test_long_sequences_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(47)
    x, y = rng.integers(1, 6, 5000).tolist(), rng.integers(1, 6, 5000).tolist()
    tracemalloc.start()
    A.distances([x], [y], COSTS, "rtwe")
    A.distances([x], [y], COSTS, "dtw")
    G.change_points(np.array(x, float), 8.0)
    G.change_points(np.array(x[:1500], float), 2.0, "rbf")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_all_pairs_meet_once(spark):
    rng = np.random.default_rng(53)
    rows = [(i, ["u", "v"][i % 3 == 0], rng.integers(1, 6, 4 + i % 3).tolist()) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, g string, q array<int>")
    got = {(r["a"], r["b"]): r["d"] for r in A.all_pairs(df.drop("g"), COSTS, part=5).collect()}
    assert sorted(got) == list(itertools.combinations(range(23), 2))
    assert all(np.isclose(d, slow_edit(np.array(rows[a][2]), np.array(rows[b][2]))[-1, -1]) for (a, b), d in got.items())
    grouped = {(r["g"], r["a"], r["b"]) for r in A.all_pairs(df, COSTS, "dtw", part=5).collect()}
    assert grouped == {(rows[a][1], a, b) for a, b in got if rows[a][1] == rows[b][1]}


def test_barycenter(spark):
    m = spark.createDataFrame([("u", i, [1, 2, 2, 3]) for i in range(5)] + [("v", 9, [4, 4, 5, 5])], "g string, id long, q array<int>")
    for measure in ("rtwe", "dtw"):
        got = {(r["g"], r["pos"]): (r["label"], r["cost"]) for r in A.barycenters(m, COSTS, measure=measure).collect()}
        assert [got["u", i] for i in range(4)] == [(1, 0), (2, 0), (2, 0), (3, 0)] and [got["v", i] for i in range(4)] == [(4, 0), (4, 0), (5, 0), (5, 0)]


def test_barycenter_against_plain_rounds(spark):
    rng = np.random.default_rng(6)
    groups = {"u": rng.integers(1, 6, (9, 12)), "v": np.repeat(rng.integers(1, 6, (7, 6)), 2, 1)}
    m = spark.createDataFrame([(g, i, [int(z) for z in q]) for g, x in groups.items() for i, q in enumerate(x)], "g string, id long, q array<int>").repartition(4)
    got = {}
    for r in A.barycenters(m, COSTS).orderBy("g", "pos").collect():
        got.setdefault(r["g"], []).append((r["label"], r["cost"]))
    for g, x in groups.items():
        c = [min(range(1, 6), key=lambda s: (-(x[:, i] == s).sum(), s)) for i in range(12)]  # noqa: B023
        kept = None
        for _ in range(100):
            tables = [slow_edit(c, q) for q in x]
            cost = sum(t[-1, -1] for t in tables)
            if kept and kept[1] - cost <= 1e-5:
                kept = (c, cost) if cost <= kept[1] else kept
                break
            kept, new = (c, cost), list(c)
            for i in range(12):
                near = [q[b - 1] for t, q in zip(tables, x) for a, b in A.path(t) if a == i + 1 and b]
                if near:
                    new[i] = min(range(6), key=lambda s: (round(sum(COSTS[s, z] for z in near), 9), s))  # noqa: B023
            c = new
        assert [s for s, _ in got[g]] == kept[0] and np.isclose(got[g][0][1], kept[1])
    tables = A.edit_tables(groups["u"][:3], groups["v"][:3, :5], COSTS)
    assert all(np.allclose(t, slow_edit(a, b)) for t, a, b in zip(tables, groups["u"], groups["v"][:3, :5]))
    half = A.train_half(spark.range(4000).withColumnRenamed("id", "id")).count()
    assert 1850 < half < 2150


def slow_cost(x, kernel, gamma):
    if kernel == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    gram = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)) if kernel == "rbf" else x @ x.T
    return lambda a, b: np.trace(gram[a:b, a:b]) - gram[a:b, a:b].sum() / (b - a)


def partitions(n, min_size, jump):
    for k in range(n):
        for mid in itertools.combinations(range(jump, n, jump), k):
            if all(b - a >= min_size for a, b in itertools.pairwise((0, *mid, n))):
                yield (0, *mid, n)


@pytest.mark.parametrize("kernel", ["linear", "cosine", "rbf"])
@pytest.mark.parametrize(("min_size", "jump"), [(1, 1), (2, 1), (3, 1), (2, 3)])
def test_change_points_are_optimal(kernel, min_size, jump):
    rng = np.random.default_rng(3)
    for n in (2 * min_size, 9, 11):
        x = rng.normal(size=(n, 2)) + np.repeat(rng.normal(0, 2, (3, 2)), (n // 3, n // 3, n - 2 * (n // 3)), axis=0) + 1
        c, every = slow_cost(x, kernel, 0.7), list(partitions(n, min_size, jump))
        for penalty in (0.05, 0.4, 3.0):
            total = lambda cuts: sum(c(a, b) for a, b in itertools.pairwise(cuts)) + penalty * (len(cuts) - 2)  # noqa: B023, E731
            cuts, cost = G.change_points(x, penalty, kernel, min_size, jump, 0.7)
            assert tuple(cuts) in every and np.isclose(cost, total(cuts)) and np.isclose(cost, min(map(total, every)))
        for k in (0, 1, 2):
            fit = lambda cuts: sum(c(a, b) for a, b in itertools.pairwise(cuts))
            cuts, cost = G.fixed_change_points(x, k, kernel, min_size, jump, 0.7)
            most = min(k, max(len(e) for e in every) - 2)
            assert len(cuts) == most + 2 and np.isclose(cost, fit(cuts)) and np.isclose(cost, min(fit(e) for e in every if len(e) == most + 2))


def test_trees_and_inconsistency():
    x = np.array([0.0, 0.1, 0.3, 5.0, 5.2, 20.0])
    d = np.abs(x[:, None] - x[None])
    tree = G.merges(d, "complete")
    assert [round(h, 6) for *_, h, _ in tree] == [0.1, 0.2, 0.3, 5.2, 20.0] and tree[-1][3] == 6
    assert G.linkage_labels(d, 3).tolist() == [0, 0, 0, 1, 1, 2]
    off = G.inconsistency(tree, 2)
    # the top merge: heights 20, 5.2 and no more two levels down
    assert off[0] == 0 and np.isclose(off[-1], (20 - 12.6) / np.std([20, 5.2], ddof=1))
    assert len(set(G.inconsistent_labels(tree, 10.0))) == 1 and len(set(G.inconsistent_labels(tree, -1.0))) == 6


def test_temporal_neighbours_find_stretches():
    rng = np.random.default_rng(59)
    centres = np.eye(4)[[0, 1, 0, 2]]
    x = np.repeat(centres, 20, axis=0) + rng.normal(0, 0.02, (80, 4))
    assert G.temporal_neighbours(x, 4).tolist() == np.repeat(range(4), 20).tolist()
    assert len(set(G.temporal_neighbours(x, 7))) == 7 and G.temporal_neighbours(x[:3], 8).tolist() == [0, 1, 2]


def test_random_intercept_is_the_maximum():
    rng = np.random.default_rng(61)
    n = rng.integers(1, 6, 40)
    g = np.arange(40) % 2
    y = [rng.normal(1 + g[i] + b, 0.5, n[i]) for i, b in enumerate(rng.normal(0, 0.8, 40))]
    stats = np.array([[len(v), 1, v.mean(), v.mean() ** 2, ((v - v.mean()) ** 2).sum()] for v in y])

    def dense(beta, tau, sigma):
        out = 0.0
        for i, v in enumerate(y):
            cov = sigma * np.eye(len(v)) + tau
            r = v - beta[g[i]]
            out -= 0.5 * (len(v) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + r @ np.linalg.solve(cov, r))
        return out

    ll, beta, tau, sigma = G.random_intercept(stats, g)
    assert np.isclose(ll, dense(beta, tau, sigma))
    for db in (-0.05, 0, 0.05):
        for a, b in itertools.product((0.9, 1, 1.1), repeat=2):
            assert dense(beta + db, tau * a, sigma * b) <= ll + 1e-9
    # rows of equal n and group added up give the same
    keys = sorted({(int(a), int(b)) for a, b in zip(n, g)})
    added = np.array([[a, *(stats[(n == a) & (g == b)][:, 1:].sum(0))] for a, b in keys])
    assert np.isclose(G.random_intercept(added, np.array([b for _, b in keys]))[0], ll)
    assert np.isclose(G.chi2_tail(3.841458820694124, 1), 0.05) and np.isclose(G.chi2_tail(9.487729036781154, 4), 0.05) and np.isclose(G.chi2_tail(7.814727903251179, 3), 0.05)


def test_small_kernels():
    rng = np.random.default_rng(4)
    gain = rng.integers(0, 9, (4, 4))
    best = max(sum(gain[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
    assert sum(gain[i, j] for i, j in G.matching(gain)) == best
    x = np.concatenate([rng.normal(0, 0.1, (5, 2)), rng.normal(5, 0.1, (5, 2))])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for labels in (G.kmeans(x, 2), G.linkage_labels(d, 2), G.density_labels(d, 1.0, 3), G.spectral_labels(np.exp(-d), 2)):
        assert len(set(labels[:5])) == len(set(labels[5:])) == 1 and labels[0] != labels[9]
    t = np.linspace(0, 10, 40)
    assert np.allclose(G.sigmoid_fit(t, 2 / (1 + np.exp(1.5 * (t - 4)))), (2, 1.5, 4), atol=1e-3)
    assert np.isnan(G.sample_entropy(np.arange(3.0))) and G.sample_entropy(np.tile([0.0, 1.0], 50), 2) < 0.1
    assert np.allclose(G.sinkhorn(d).sum(0), 0.1) and G.gromov_wasserstein(d, d) < G.gromov_wasserstein(d, d * 3)
    assert G.matrix_stats(np.eye(3))["rank"] == 3


def seq(spark, labels):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "id long, pos long, label long")


def test_runs_merge_smooth(spark):
    r = S.runs(seq(spark, [2, 2, -1, 2, 2, 5, 5, -2]))
    assert [(x.s, x.e, x.label) for x in r.orderBy("s").collect()] == [(0, 2, 2), (2, 3, -1), (3, 5, 2), (5, 7, 5), (7, 8, -2)]
    s = S.smooth(r, 1).orderBy("s").collect()
    assert [(x.s, x.e, x.label, x.interruptions) for x in s] == [(0, 5, 2, 1), (5, 7, 5, 0), (7, 8, -2, 0)]
    assert S.runs(seq(spark, [])).count() == 0
    assert S.runs(spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, 3)], "id long, pos long, label long")).count() == 2
    assert S.to_positions(r).count() == 8


def test_join_and_discard_and_morphology(spark):
    mask = [1, 1, 0, 1, 1, 1, 0, 0, 0, 1]
    r = S.runs(seq(spark, mask)).where("label = 1").select("id", "s", "e")
    assert [(x.s, x.e) for x in S.join_and_discard(r, 1, 1).collect()] == [(0, 6)]
    assert sorted((x.s, x.e) for x in S.join_and_discard(r, 1, 1, strict=True).collect()) == [(0, 2), (3, 6), (9, 10)]
    for opening, closing in ((1, 1), (2, 3), (3, 2)):
        out = [r for r in S.opened_closed(seq(spark, mask).withColumnRenamed("label", "f"), "f", opening, closing).orderBy("pos").collect()]
        pad = lambda v, i: v[i] if 0 <= i < len(v) else 0
        erode = lambda v, k: [min(pad(v, i + o) for o in range(-(k // 2), k - k // 2)) for i in range(len(v))]
        dilate = lambda v, k: [max(pad(v, i - o) for o in range(-(k // 2), k - k // 2)) for i in range(len(v))]
        opened = dilate(erode(mask, opening), opening)
        assert [r.opened for r in out] == opened and [r.closed for r in out] == erode(dilate(opened, closing), closing)


def test_votes(spark):
    v = {r.frame: (r.label, r.agreed) for r in S.frame_votes(seq(spark, [1, 2, 2]), 2).collect()}
    assert v == {0: (1, True), 1: (1, False), 2: (2, True), 3: (2, True)}
    m = S.majority(seq(spark, [3, 1, 1, 3]), ["id"]).collect()
    assert [(r.label, r.votes) for r in m] == [(3, 2)]


def test_joins(spark):
    seg = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 5.0, 9.0, "b")], "id long, s double, e double, k string")
    t = spark.createDataFrame([(1, 5.0), (1, 9.5), (1, 0.0), (2, 1.0)], "id long, t double")
    assert sorted((r.t, r.k) for r in J.interval_join(t, seg, 4.0).collect()) == [(0.0, "a"), (5.0, "a"), (5.0, "b")]
    left = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    out = J.with_indicator(left, spark.createDataFrame([(1, 5), (None, 6)], "k long, w long"), ["k"]).collect()
    assert sorted((r.v, r._merge) for r in out) == [("x", "both"), ("y", "left_only")]
    a = J.as_of(spark.createDataFrame([(1, 5), (1, 0)], "k long, t long"), spark.createDataFrame([(1, 1, 7), (1, 5, 8)], "k long, t long, v long"), "k", "t", "v")
    assert sorted((r.t, r.v_asof) for r in a.collect()) == [(0, None), (5, 8)]
    p = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 9.0, 0.0), (1, 1, 0, 9.0, 1.0), (1, 1, 1, 50.0, 0.0)], "id long, pos long, k long, x double, y double")
    assert sorted((r.pos, r.k, r.track) for r in J.track(p, 3.0).collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)]


def test_sources(spark, tmp_path):
    d = tmp_path / "root" / "cook" / "P1" / "cam"
    d.mkdir(parents=True)
    np.save(d / "a.npy", np.arange(12.0).reshape(6, 2))
    m = X.matrices(spark, str(tmp_path / "root"), start=1, end=4).orderBy("pos").collect()
    assert [(r.pos, list(r.v)) for r in m] == [(1, [2, 3]), (2, [4, 5]), (3, [6, 7])]
    assert [(r.task_name, r.participant_id, r.modality) for r in T.artifact_tree(spark, str(tmp_path / "root"), "*.npy").collect()] == [("cook", "P1", "cam")]
    (tmp_path / "g.tsv").write_text("sensor\ttime\tx\nGyro\t1,5\t2,0\nEye\t2\tbad\n")
    g = T.eye_tracker(spark, str(tmp_path / "g.tsv"), ["x"])
    assert g["Gyro"].first().time == 1.5 and g["Eye"].first().x is None
    with pytest.raises(ValueError):
        T.eye_tracker(spark, str(tmp_path / "g.tsv"), ["gone"])
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    assert T.delimited(spark, str(tmp_path / "c.csv"), "a int, b int", ";", ["b"]).collect()[0].asDict() == {"b": 2}
    point = {"x": 1.0, "y": 2.0, "z": 3.0}
    frames = [{"handedness": [[{"category_name": "Left", "score": 0.9}]], "hand_landmarks": [[point]]}, {"handedness": [], "hand_landmarks": []}]
    raw = spark.createDataFrame([("r", json.dumps({"frames": frames}))], "identifier string, j string").select("identifier", F.from_json("j", T.HANDS).frames.alias("frames"))
    out = {(r.frame, r.side): (r.detected, r.points) for r in T.hand_frames(raw).collect()}
    assert out[0, "Left"] == (True, [[1.0, 2.0, 3.0]]) and out[0, "Right"] == (False, None) and not out[1, "Left"][0]
    talk = {"segments": [{"text": "hi", "start": 0.0, "end": 1.0, "words": [{"speaker": "S"}]}]}
    s = T.speech_segments(spark.createDataFrame([("r", json.dumps(talk))], "identifier string, json string")).first()
    assert (s.text, s.scores, s.speakers) == ("hi", [None], ["S"])
    e = spark.createDataFrame([("r", "a", 1.0, "state"), ("r", "a", 2.0, "state"), ("r", "a", 5.0, "state"), ("r", "b", 3.0, "point")], "identifier string, category string, time double, kind string")
    assert sorted((r.start, r.stop) for r in T.paired_events(e).select("start", F.coalesce("stop", F.lit(-1.0)).alias("stop")).collect()) == [(1.0, 2.0), (3.0, 3.0), (5.0, -1.0)]
    T.save(e, str(tmp_path / "out"), "identifier")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_streams_equal_batches(spark, tmp_path):
    e = T.table(spark, "/root/testdata/sf0.001", "events").orderBy("ts", "event_id").repartitionByRange(4, "ts")
    e.write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = lambda df: sorted(map(str, df.collect()))
    live = lambda: streams.source(spark, str(tmp_path / "in"), files=9)
    assert rows(streams.drain(streams.windowed(live()), "w1", "complete")) == rows(streams.windowed(batch))
    assert rows(streams.drain(streams.windowed(live(), "1 hour", "30 minutes"), "w2", "complete")) == rows(streams.windowed(batch, "1 hour", "30 minutes"))
    assert rows(streams.drain(streams.deduplicated(live()).select("event_id"), "w3")) == rows(batch.select("event_id").distinct())
    streams.write_once(live().select("event_id"), str(tmp_path / "sink"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == batch.count()
    done = streams.drain(streams.running_runs(live()), "w4")
    want = S.runs(T.sequences(spark, "/root/testdata/sf0.001"), "sym").groupBy("id").count().selectExpr("sum(count - 1) AS n").first().n
    assert done.count() == want


@pytest.mark.parametrize(("measure", "options"), [("rtwe", {}), ("rtwe", {"kind": "sakoe", "share": 0.2}), ("rtwe", {"kind": "itakura", "share": 0.3}), ("dtw", {}), ("eshape", {"width": 4, "step": 3})])
def test_grids_are_the_distances_of_all_pairs(spark, measure, options):
    rng = np.random.default_rng(31)
    for costs in (COSTS, COSTS * np.pi):  # whole thousandths, and not
        x, y = ([rng.integers(1, 6, n) for n in (9, 0, 9, 9 if options.get("kind") == "itakura" else 14)] for _ in range(2))
        i, j = np.divmod(np.arange(16), 4)
        want = A.distances([x[k] for k in i], [y[k] for k in j], costs, measure, **options).reshape(4, 4)
        assert np.allclose(A.grid(x, y, costs, measure, **options), want)
    # sequences that are there many times are computed once and all their pairs are there
    q = {i: tuple(int(v) for v in np.random.default_rng(i % 5).integers(1, 6, 9)) for i in range(40)}
    rows = A.all_pairs(spark.createDataFrame(list(q.items()), "id long, q array<long>"), COSTS, measure, part=6, **options).collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == 40 * 39 // 2 and all(r.a < r.b for r in rows)
    want = A.distances([q[r.a] for r in rows], [q[r.b] for r in rows], COSTS, measure, **options)
    assert np.allclose([r.d for r in rows], want)


def test_paths_of_many_pairs_are_those_of_each(spark):
    rng = np.random.default_rng(37)
    for n, m in ((12, 12), (1, 5), (9, 4)):
        x, y = rng.integers(1, 6, (20, n)), rng.integers(1, 6, (20, m))
        row, i, j, cost = A.edit_paths(x, y, COSTS)
        for r in range(20):
            t, own = A.time_warp_edit(x[r], y[r], COSTS), row == r
            assert list(zip(i[own].tolist(), j[own].tolist(), strict=True)) == [(int(a), int(b)) for a, b in A.path(t)]
            assert np.array_equal(cost[own], t[i[own], j[own]])
