"""Spanning trees, their cuts and linear maps of densities against plain NumPy."""

import numpy as np
import pandas as pd
import pytest

from loomspan.operators import spectral as P
from loomspan.operators import trees as R
from loomspan.plans import measures


def reach(x, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, least - 1] if least > 1 else np.zeros(len(x))
    return np.maximum(d, np.maximum(core[:, None], core))


def prim(w):
    """The tree from point 0; equal weights by (a, b)."""
    inside, edges = [0], set()
    while len(inside) < len(w):
        _, a, b = min((w[i, j], min(i, j), max(i, j)) for i in inside for j in set(range(len(w))) - set(inside))
        edges.add((a, b))
        inside.append(b if a in inside else a)
    return edges


def parts(n, edges):
    label = list(range(n))
    for _ in range(n):
        new = label[:]
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new
    return label


@pytest.mark.parametrize(("least", "block"), [(0, 1024), (4, 30)])
def test_tree_and_cuts(spark, least, block):
    rng = np.random.default_rng(least)
    x = np.round(np.concatenate([rng.normal(size=(30, 2)) + c for c in ([0, 0], [9, 0], [0, 12])]), 1)
    x[80:] = x[50:60]  # points that repeat, and equal distances
    rows = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "pos long, v array<double>").repartition(3)
    w, tree = reach(x, least), R.spanning_tree(rows, least, block)
    got = {(r.a, r.b): r.w for r in tree.collect()}
    assert set(got) == prim(w) and all(np.isclose(got[e], w[e]) for e in got)
    order = sorted(got, key=lambda e: (got[e], *e))
    assert {r.pos: r.cluster for r in R.cut(rows, tree, 5).collect()} == dict(enumerate(parts(90, order[:-4])))
    assert len(set(parts(90, order[:-2]))) == 3
    t = float(np.median(list(got.values())))
    label = parts(90, [e for e in order if got[e] <= t])
    want = {i: c if label.count(c) >= 4 else -1 for i, c in enumerate(label)}
    assert {r.pos: r.cluster for r in R.cut(rows, tree, None, t, 4).collect()} == want


def test_weight_of_a_larger_tree(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 3))
    rows = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "pos long, v array<double>")
    total = R.spanning_tree(rows, 0, 700).selectExpr("count(*) AS n", "sum(w) AS w").first()
    d, near, far = reach(x, 0), np.full(2000, np.inf), 0.0
    left, at = np.ones(2000, bool), 0
    for _ in range(1999):
        left[at] = False
        near = np.minimum(near, d[at])
        at = np.flatnonzero(left)[near[left].argmin()]
        far += near[at]
    assert total.n == 1999 and np.isclose(total.w, far)


def test_edges_of_trees(spark):
    one = spark.createDataFrame([(1, [2.0])], "pos long, v array<double>")
    assert R.spanning_tree(one).count() == 0 and R.spanning_tree(one.limit(0)).count() == 0 and R.spanning_tree(one, 5).count() == 0
    assert [tuple(r) for r in R.cut(one, R.spanning_tree(one), 3).collect()] == [(1, 1)]
    near = R.neighbours(spark.createDataFrame([(i, [float(i * i)]) for i in range(5)], "pos long, v array<double>"), 2, 2)
    assert {(r.pos, r.other) for r in near.collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 0), (3, 2), (3, 4), (4, 3), (4, 2)}


def test_linear_maps(spark):
    """A density and its stretched, shifted and turned copies are mapped onto each other without error."""
    t = np.array([0.0, 1, 2, 3, 10])
    w = [5, 4, 3, 2, 1]
    copies = {0: t, 1: 3 * t + 7, 2: -2 * t, 3: t**2}
    rows = [(k, float(a), b) for k, x in copies.items() for a, b in zip(x, w)] + [(9, 4.0, 3)]
    got = {(r.i, r.j): r for r in measures.linear_gw(spark.createDataFrame(rows, "label long, t double, w long")).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)}  # a single time has no map
    assert np.isclose(got[0, 1].slope, 3) and np.isclose(got[0, 1].shift, 7) and got[0, 1].error < 1e-3
    assert np.isclose(got[0, 2].slope, -2) and np.isclose(got[0, 2].shift, 0) and got[0, 2].error < got[0, 3].error and got[0, 3].error > 0.5


def test_planted_blocks_are_found(spark):
    """Ten thousand vertices in four blocks, dense inside and sparse between."""
    rng = np.random.default_rng(1)
    block = np.arange(10_000) % 4
    edges = set()
    for i in range(10_000):
        edges |= {(min(i, int(j)), max(i, int(j)), 1.0) for j in rng.choice(np.flatnonzero(block == block[i]), 8) if j != i}
        j = int(rng.integers(10_000))
        if block[j] != block[i] and rng.random() < 0.3:
            edges.add((min(i, j), max(i, j), 0.2))
    df = spark.createDataFrame(sorted(edges), "src long, dst long, weight double").repartition(8)
    got = {r.pos: r.cluster for r in P.spectral(df, 4, 15).collect()}
    assert len(got) == 10_000
    sizes = [[sum(got[i] == c for i in range(b, 10_000, 4)) for c in range(4)] for b in range(4)]
    assert all(max(x) > 2450 for x in sizes) and len({int(np.argmax(x)) for x in sizes}) == 4


def test_neighbours_of_many_copies_are_measured_in_full(spark):
    """Copies are at distance 0, whatever a product of matrices rounds to, and ties go by number."""
    rng = np.random.default_rng(3)
    x = 100 + np.repeat(rng.normal(size=(12, 7)), 6, 0)
    rows = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "pos long, v array<double>")
    got = {}
    for r in R.neighbours(rows, 3, 20).collect():
        got.setdefault(r.pos, []).append((r.d, r.other))
    assert {p: sorted(n) for p, n in got.items()} == {i: [(0.0, j) for j in range(i - i % 6, i - i % 6 + 6) if j != i][:3] for i in range(72)}


def test_a_point_is_sent_once_for_each_block(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "pos long, v array<double>")
    sent = R.pairs_of_blocks(rows, lambda a, b: pd.DataFrame({"n": [len(a) + (0 if b is None else len(b))]}), "n long", 10)
    assert sent.agg({"n": "sum"}).first()[0] == 40 * 4


def test_points_are_sent_to_a_number_of_blocks_that_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAST", 10)
    for n in (400, 4000):
        rows = spark.createDataFrame([(i, [float(i), 0.1 if i % 2 else 0.5]) for i in range(n)], "pos long, v array<double>")
        sent = R.pairs_of_blocks(rows, lambda a, b: pd.DataFrame({"n": [len(a) + (0 if b is None else len(b))], "kept": [all(v[1] in (0.1, 0.5) for v in a["v"])]}), "n long, kept boolean")
        assert tuple(sent.selectExpr("sum(n)", "bool_and(kept)").first()) == (n * R.BLOCKS, True)


@pytest.mark.parametrize("tile", [1, 7, 500])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_tiles_give_the_tree_and_the_neighbours(monkeypatch, tile, shift):
    """Equal distances, copies, and vectors far from the origin, whose products are rounded coarsely."""
    monkeypatch.setattr(R, "TILE", tile)
    monkeypatch.setattr(R, "HELD", 40)
    rng = np.random.default_rng(tile)
    x = shift + np.round(8 * rng.normal(size=(60, 3))) / 8  # sums are exact
    x[50:] = x[10:20]
    pos = rng.permutation(60)
    for least in (0, 4):
        w = reach(x, least)
        core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, least - 1] if least else np.zeros(60)
        got = R.tree_of(pos, x[pos], core[pos])
        assert {(int(a), int(b)) for a, b in zip(got["a"], got["b"])} == prim(w) and all(np.isclose(v, w[a, b]) for a, b, v in got.itertuples(index=False))
        # of two sides: the edges between them are those of a graph without the others
        side = rng.random(60) < 0.4
        apart = np.where(side[:, None] == side[None], 1e12, w)
        both = R.tree_of(pos, x[pos], core[pos], side[pos])
        assert {(int(a), int(b)) for a, b in zip(both["a"], both["b"])} == prim(apart)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in (1, 5):
        near = R.nearest(x[pos[:35]], x, pos[:35], np.arange(60), k)
        want = {(i, j) for i in pos[:35] for j in sorted(set(range(60)) - {i}, key=lambda j: (d[i, j], j))[:k]}
        assert {(a, b) for a, b, _ in near.itertuples(index=False)} == want


def test_neighbours_are_taken_once_for_similarities(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(50)], "pos long, v array<double>")
    edges = P.affinities(rows, 3)
    assert "InPandas" not in edges._jdf.queryExecution().toString() and edges.count() == edges.dropDuplicates(["src", "dst"]).count() >= 75
