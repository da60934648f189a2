"""Clusters, moments, kernels and scores against plain NumPy, however rows are dealt."""

import itertools
import math

import numpy as np
import pytest

from loomspan.operators import detection as D
from loomspan.operators import kernels as K
from loomspan.operators import mixtures as M
from loomspan.operators import moments as Q
from loomspan.operators import scores as E


def frame(spark, x, parts=3, labels=None):
    rows = [(i, [float(z) for z in v], 0 if labels is None else int(labels[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pos long, v array<double>, label long").repartition(parts)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(size=(150, 4)) * [0.5, 1, 0.3, 1] + c for c in ([0, 0, 0, 9], [8, 5, 0, 0], [-8, 4, 6, 0])])


def test_kmeans_does_not_depend_on_partitions(spark, planted):
    got = []
    for parts in (1, 4, 9):
        for cosine in (False, True):
            rows = frame(spark, planted, parts)
            centres, cost = M.kmeans(rows, 5, cosine)
            got.append((cosine, np.round(centres, 9).tolist(), round(cost, 6), {r.pos: r.cluster for r in M.nearest(rows, centres, cosine).collect()}))
            x = M.unit(planted) if cosine else planted
            assert np.isclose(cost, M.squared(x, centres).min(1).sum(), rtol=1e-6)
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5]
    assert all(len({i // 150 for i, k in got[0][3].items() if k == c}) == 1 for c in range(5))


def test_digamma():
    h = 1e-5
    for x in (0.05, 0.7, 1.0, 5.5, 40.0):
        assert np.isclose(M.digamma(np.array([x]))[0], (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rtol=1e-6)


@pytest.mark.parametrize("process", [True, False])
def test_mixture(spark, planted, process):
    """The bound never falls, a process empties what it does not need, and partitions do not matter."""
    models = [M.fit(frame(spark, planted, parts), 7 if process else 3, process, rounds=40, tolerance=1e-6) for parts in (1, 5)]
    for m in models:
        assert len(m.bounds) >= 3 and min(np.diff(m.bounds)) > -1e-9
    assert np.allclose(models[0].means, models[1].means, atol=1e-6) and np.allclose(models[0].bounds[:10], models[1].bounds[:10])
    weights = np.sort(models[0].weights)[::-1]
    assert np.allclose(weights[:3], 1 / 3, atol=0.02) and weights[3:].sum() < 0.02
    labels = {r.pos: r.cluster for r in M.predict(frame(spark, planted), models[0]).collect()}
    assert all(len({labels[i] for i in range(k, k + 150)}) == 1 for k in (0, 150, 300))
    if not process:  # the likelihood of the textbook density
        m = models[0]
        cov = [np.linalg.inv(f @ f.T) for f in m.factors]
        dens = sum(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", planted - u, np.linalg.inv(c), planted - u)) / np.sqrt(np.linalg.det(2 * math.pi * c)) for w, u, c in zip(m.weights, m.means, cov))
        n, aic, bic = M.criteria(frame(spark, planted), m)
        assert n == 450 and np.isclose(aic, -2 * np.log(dens).sum() + 2 * 44) and np.isclose(bic, -2 * np.log(dens).sum() + 44 * math.log(450))


def test_incremental_fit_starts_where_the_last_block_ended(spark, planted):
    model, reports = M.incremental(frame(spark, planted), 3, block=150, rounds=20)
    assert sum(r["rows"] for r in reports) == 450 and len(reports) == 3 and all(r["converged"] for r in reports)
    assert all(r["rounds"] <= reports[0]["rounds"] + 1 for r in reports) and np.allclose(np.sort(model.weights), 1 / 3, atol=0.15)
    process, reports = M.incremental(frame(spark, planted), 6, True, block=150, rounds=20)
    assert len(reports) == 3 and reports[0]["aic"] is None


def test_whitening_and_components(spark, planted):
    x = planted @ np.random.default_rng(1).normal(size=(4, 4)) * 100 + 1e5
    n, mean, cov = Q.covariance(frame(spark, x))
    assert n == 450 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    w = np.array([r.v for r in Q.whitened(frame(spark, x)).orderBy("pos").collect()])
    assert np.allclose(np.cov(w.T), np.eye(4), atol=1e-6)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(w, (x - x.mean(0)) @ vectors @ np.diag(values**-0.5) @ vectors.T, atol=1e-6)
    flat = np.column_stack([x, np.full(450, 3.0)])
    z, var = Q.components(frame(spark, flat), 9, True)
    z = np.array([r.z for r in z.orderBy("pos").collect()])
    assert z.shape == (450, 5) and np.allclose(np.cov(z[:, :4].T), np.eye(4), atol=1e-6) and np.allclose(z[:, 4], 0) and np.allclose(var[:4], values[::-1])
    with pytest.raises(ValueError):
        Q.covariance(frame(spark, x).limit(0))


def test_fourier_features_are_near_the_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) + np.repeat(rng.normal(size=(6, 5)), 50, 0)
    gram = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.5**2))
    z = np.array([r.z for r in K.features(spark, frame(spark, x), 5, 1.5, 1024).orderBy("pos").collect()])
    assert np.abs(z @ z.T - gram).max() < 5 / math.sqrt(1024) and np.sqrt(((z @ z.T - gram) ** 2).mean()) < 1 / math.sqrt(1024)
    labels = np.repeat(np.arange(6), 50)
    rows = K.features(spark, frame(spark, x, 3, labels), 5, 1.5, 1024).selectExpr("0 AS id", "label AS seg", "z")
    got = {r.seg: r for r in K.against_neighbours(K.segment_means(rows, ["id", "seg"])).collect()}
    mean = lambda a, b: gram[labels == a][:, labels == b].mean()
    for s in range(6):
        near = [t for t in (s - 1, s + 1) if 0 <= t < 6]
        mmd = sum(mean(s, s) + mean(t, t) - 2 * mean(s, t) for t in near)
        cost = (1 - mean(s, s)) / sum(1 - 2 * mean(s, t) + mean(t, t) for t in near)
        assert abs(got[s].mmd - mmd) < 0.06 and abs(got[s].cost_ratio - cost) < 0.06 and got[s].n == 50
    alone = K.against_neighbours(K.segment_means(rows.where("seg = 0"), ["id", "seg"])).first()
    assert alone.mmd == 0 and alone.cost_ratio is None


def test_silhouettes_of_samples(spark, planted):
    labels = np.arange(450) // 150
    labels[::10] = (labels[::10] + 1) % 3
    labels[7] = 9  # alone in its cluster
    for most, block in ((20000, 1024), (200, 64)):
        rows = frame(spark, planted, 3, labels)
        got = {r["sample"]: r for r in E.silhouettes(rows, most, 3, block=block).collect()}
        drawn = E.sampled(rows, most, 3).collect()
        assert len(got) == 3
        for k in range(3):
            ids = sorted(r.pos for r in drawn if r["sample"] == k)
            assert got[k]["n"] == len(ids) and (most > 450 and len(ids) == 450 or 150 < len(ids) < 250)
            d, own = np.sqrt(((planted[ids][:, None] - planted[ids][None]) ** 2).sum(2)), labels[ids]
            s = []
            for i in range(len(ids)):
                same = own == own[i]
                a = d[i, same].sum() / (same.sum() - 1) if same.sum() > 1 else None
                b = min(d[i, own == t].mean() for t in set(own) - {own[i]})
                s.append(0 if a is None else (b - a) / max(a, b))
            assert np.isclose(got[k]["silhouette"], np.mean(s), atol=1e-6)


def test_entropy_of_symbols_and_ties(spark):
    rng = np.random.default_rng(8)
    series = {0: rng.integers(0, 2, 80).astype(float), 1: rng.normal(size=60), 2: np.ones(20), 3: np.arange(4.0), 4: np.tile([1.0, 2.0], 30)}
    df = spark.createDataFrame([(u, i, float(v)) for u, x in series.items() for i, v in enumerate(x)], "id long, pos long, value double")
    for m in (2, 4):
        got = {r.id: r for r in E.sample_entropy(df, m, grid=min(m, 3)).collect()}
        assert set(got) == set(series)
        for u, x in series.items():
            r = 0.2 * x.std()
            count = lambda k: sum(max(abs(x[i + j] - x[h + j]) for j in range(k)) <= r for i in range(len(x) - m) for h in range(i + 1, len(x) - m))  # noqa: B023, E731
            a, b = count(m + 1), count(m)
            assert (got[u].near, got[u].nearer) == (b, a) and (got[u].entropy is None if not a else np.isclose(got[u].entropy, -math.log(a / b)))


def slow_ap(pred, truth, least):
    """One label: detections in order of score lock the truth they overlap most, recording by recording."""
    taken, hits = set(), []
    for v, seg, s, e, _ in sorted(pred, key=lambda p: (-p[4], p[0], p[1])):
        found = []
        for w, g, a, b in truth:
            if w == v and min(e, b) > max(s, a):
                both = min(e, b) - max(s, a)
                found.append((both / ((e - s) + (b - a) - both), g))
        best = next((g for iou, g in sorted(found, reverse=True) if iou >= least / 100 and (v, g) not in taken), None)
        hits.append(best is not None)
        taken.add((v, best))
    tp = np.cumsum(hits)
    precision = tp / np.arange(1, len(hits) + 1)
    return sum(precision[i:].max() for i in range(len(hits)) if hits[i]) / len(truth), int(sum(hits))


def test_average_precision_with_overlapping_truths(spark):
    rng = np.random.default_rng(12)
    truth, pred = [], []
    for v, label in itertools.product(range(3), range(2)):
        for g in range(12):
            s = int(rng.integers(0, 40))
            truth.append((v, label, g, s, s + int(rng.integers(1, 12))))
        for seg in range(30):
            _, _, _, s, e = truth[-1 - int(rng.integers(12))]
            s, e = s + int(rng.integers(-2, 3)), e + int(rng.integers(-2, 3))
            pred.append((v, label, seg, s, max(e, s + 1), float(rng.integers(0, 8)) / 8))
    truth.append((9, 7, 0, 3, 9))  # a label that is never found
    p = spark.createDataFrame(pred, "id long, label long, seg long, s long, e long, score double")
    t = spark.createDataFrame(truth, "id long, label long, seg long, s long, e long")
    got = {(r.label, r.least): r for r in D.average_precision(p, t, ["id", "label"], 6, ["label"]).collect()}
    assert len(got) == 30
    for (label, least), r in got.items():
        if label == 7:
            assert (r.ap, r.truths, r.detections) == (0, 1, 0)
            continue
        ap, tp = slow_ap([(v, g, s, e, c) for v, k, g, s, e, c in pred if k == label], [(v, g, s, e) for v, k, g, s, e in truth if k == label], least)
        assert np.isclose(r.ap, ap) and r.tp == tp and r.truths == 36 and r.detections == 90


def test_a_chain_of_detections_is_settled_without_rounds(spark):
    # each detection wants the truth that the one before it took, so each waits for all before it
    pairs = [(1, 50, i, g, 1 - i / 100, 0.9 - 0.1 * (g - i + 1)) for i in range(40) for g in (i - 1, i)] + [(2, 50, 0, 0, 0.5, 0.9)]
    rows = spark.createDataFrame(pairs, "id long, least int, seg long, gi long, score double, iou double")
    spark.sparkContext.setJobGroup("greedy", "greedy")
    out = D.greedy(rows, ["id"])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy"))
    spark.sparkContext.setJobGroup("rest", "rest")
    got = {(r.id, r.seg): r.gi for r in out.collect()}
    assert got == {(1, i): i - 1 for i in range(40)} | {(2, 0): 0} and not jobs


def test_windows_of_curves_are_not_scanned_anew(spark):
    rows = spark.createDataFrame([(1, 1, i, 3 * i, 3 * i + 2, 0.5) for i in range(30)], "id long, label long, seg long, s long, e long, score double")
    plan = D.average_precision(rows, rows.drop("score"), ["id", "label"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "max(precision" in plan and "currentrow$(), unboundedfollowing$()" not in plan
