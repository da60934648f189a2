"""Minimum spanning trees of points by Boruvka's rounds, and the clusters that a tree holds (single linkage, density)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.stored import dropped, stored

#: Blocks that points are dealt to, two of which are compared by one task; points of a block at least, and numbers of their vectors at most.
BLOCKS, LEAST, MOST = 12, 2048, 1 << 23
#: Distances that a task holds at once, and points of a tile of a block whose distances from those of another tile are held.
HELD, TILE = 4_000_000, 6144


def pairs_of_blocks(rows: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str, block: int | None = None) -> DataFrame:
    """What compare(own, other) gives for every pair of blocks of the rows (pos, v, …) once, and for each block alone (other is None).

    All points are compared with all: the work is the square of the rows, shared by as many tasks as there are pairs of blocks.
    A point is sent once for each block, and a task holds two blocks. Without `block` there are BLOCKS of them, as long as
    MOST numbers hold one: so what is sent grows as the rows do, not as their square.
    """
    short = F.bool_and(F.forall("v", lambda x: x.cast("float").cast("double") == x)).alias("short")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), short).first()
    if block is None:
        block = max(LEAST, min(-(-facts["n"] // BLOCKS), MOST // max(facts["width"] or 1, 1)))
    parts = max(1, -(-facts["n"] // block))
    if facts["short"]:  # nothing is lost in half the bytes
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    dealt = rows.withColumn("p_", F.pmod(F.xxhash64("pos"), F.lit(parts)).cast("int")).withColumn("o_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumn("lo_", F.least("p_", "o_")).withColumn("hi_", F.greatest("p_", "o_")).drop("o_")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame["p_"] == frame["lo_"]
        if frame["lo_"].iloc[0] != frame["hi_"].iloc[0] and mine.nunique() < 2:  # the other block is empty
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return compare(frame[mine], None if frame["lo_"].iloc[0] == frame["hi_"].iloc[0] else frame[~mine])

    tasks = min(2000, parts * (parts + 1) // 2)
    return dealt.repartition(tasks, "lo_", "hi_").groupBy("lo_", "hi_").applyInPandas(run, schema)


def vectors_of(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"]).astype(np.float64)


def lengths(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(left, right, slack): left @ right.T is less the halves of the squared distances of the rows of x, by no more than slack off.

    Four-byte numbers, where the squares are in their range.
    """
    mean = x.mean(0)
    z = x - mean
    half = (z * z).sum(1) / 2
    most, one = half.max(), np.ones(len(x))
    kind, rounding = (np.float32, 5e-7) if most < 1e30 else (np.float64, 1e-15)
    slack = rounding * (x.shape[1] + 4) * most + 1e-14 * x.shape[1] * np.sqrt(most) * np.abs(mean).max()
    return np.column_stack([z, one, -half]).astype(kind), np.column_stack([z, -half, one]).astype(kind), float(slack)


def nearest(a: np.ndarray, b: np.ndarray, mine: np.ndarray, theirs: np.ndarray, k: int) -> pd.DataFrame:
    """(pos, other, d): of each row of a its k nearest rows of b of another number, ties by number.

    Products of matrices, tile by tile, leave the rows that may be among them: those no farther than the k-th so far, rounding
    allowed for. What they leave in the end is measured in full.
    """
    out = []
    left, right, slack = halves(np.concatenate([a, b]))
    right = right[len(a) :]
    step = max(1, HELD // TILE)
    for i in range(0, len(a), step):
        own, number = left[i : min(len(a), i + step)], mine[i : i + step]
        bound = np.full(len(own), -np.inf, own.dtype)
        x, y, near = np.zeros(0, int), np.zeros(0, int), np.zeros(0, own.dtype)
        for j in range(0, len(b), TILE):
            d = own @ right[j : j + TILE].T
            if not j and k + 1 < d.shape[1]:  # the row itself may be among those
                bound = np.partition(d, d.shape[1] - k - 1, 1)[:, -k - 1] - own.dtype.type(2 * slack)
            u, v = np.nonzero(d >= bound[:, None])
            other = number[u] != theirs[j + v]
            u, v = u[other], v[other]
            if not len(u):
                continue
            x, y, near = np.concatenate([x, u]), np.concatenate([y, j + v]), np.concatenate([near, d[u, v]])
            order = np.lexsort((-near, x))
            x, y, near = x[order], y[order], near[order]
            last = np.flatnonzero(np.arange(len(x)) - np.searchsorted(x, x) == k - 1)
            bound[x[last]] = np.maximum(bound[x[last]], near[last] - own.dtype.type(2 * slack))
            kept = near >= bound[x]
            x, y, near = x[kept], y[kept], near[kept]
        few = max(1, HELD // a.shape[1])
        far = np.concatenate([np.zeros(0), *(lengths(a[i + x[j : j + few]] - b[y[j : j + few]]) for j in range(0, len(x), few))])
        order = np.lexsort((theirs[y], far, x))
        x, y, far = x[order], y[order], far[order]
        kept = np.arange(len(x)) - np.searchsorted(x, x) < k
        out.append(pd.DataFrame({"pos": number[x[kept]], "other": theirs[y[kept]], "d": far[kept]}))
    return pd.concat(out)


def neighbours(rows: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(pos, other, d): the k nearest other points of each point (pos, v), ties by pos."""

    def gathered(f: pd.DataFrame) -> pd.DataFrame:
        """One row a point: rows of a point lie together."""
        pos, first = np.unique(f["pos"].to_numpy(), return_index=True)
        order = np.argsort(first)
        return pd.DataFrame({"pos": pos[order], **{c: np.split(f[c].to_numpy(), first[order][1:]) for c in ("other", "d")}}) if len(f) else pd.DataFrame(columns=["pos", "other", "d"])

    def compare(own: pd.DataFrame, other: pd.DataFrame | None) -> pd.DataFrame:
        a, mine = vectors_of(own), own["pos"].to_numpy()
        if other is None:
            return gathered(nearest(a, a, mine, mine, k))
        b, theirs = vectors_of(other), other["pos"].to_numpy()
        return pd.concat([gathered(nearest(a, b, mine, theirs, k)), gathered(nearest(b, a, theirs, mine, k))])

    each = pairs_of_blocks(rows.select("pos", "v"), compare, "pos long, other array<long>, d array<double>", block)
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "other")))), 1, k)
    return each.groupBy("pos").agg(best.alias("x")).select("pos", F.explode("x").alias("x")).select("pos", "x.other", "x.d")


def grown(i: np.ndarray, j: np.ndarray | None, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): the least tree of the edges between points i and points j, or among i if j is None, one point after another; equal weights by (a, b).

    A product of matrices says which points may have come closer, rounding allowed for; only these are measured.
    """
    at = i if j is None else np.concatenate([i, j])
    n, m = len(at), len(i)
    own, cores = x[at], core[at]
    left, right, slack = halves(own)
    # less the halves of squared distances, of the rows of i and of those of j
    near = left @ right.T if j is None else left[:m] @ right[m:].T
    back = near if j is None else left[m:] @ right[:m].T
    best, by, bound = np.full(n, np.inf), np.zeros(n, int), np.full(n, -np.inf, near.dtype)
    closer_than, even_with = np.empty(n, bool), np.empty(n, bool)
    a, b, weights = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1)
    new = 0
    for k in range(n - 1):
        best[new] = bound[new] = np.inf
        row, begin, end = (near[new], 0, n) if j is None else (near[new], m, n) if new < m else (back[new - m], 0, m)
        hit = np.greater_equal(row, bound[begin:end], out=closer_than[begin:end]).nonzero()[0]
        if len(hit):
            hit += begin
            w = np.maximum(lengths(own[hit] - own[new]), np.maximum(cores[hit], cores[new]))
            old = best[hit]
            closer, even = w < old, w == old
            if even.any():
                lo, hi = np.minimum(at[hit], at[new]), np.maximum(at[hit], at[new])
                old_lo, old_hi = np.minimum(at[hit], at[by[hit]]), np.maximum(at[hit], at[by[hit]])
                closer |= even & ((lo < old_lo) | ((lo == old_lo) & (hi < old_hi)))
            hit, w = hit[closer], w[closer]
            best[hit], by[hit], bound[hit] = w, new, -(w * w) / 2 - slack
        new = int(best.argmin())
        if np.count_nonzero(np.equal(best, best[new], out=even_with)) > 1:
            same = np.flatnonzero(even_with)
            u, v = at[same], at[by[same]]
            new = int(same[np.lexsort((np.maximum(u, v), np.minimum(u, v)))[0]])
        u, v = at[new], at[by[new]]
        a[k], b[k], weights[k] = min(u, v), max(u, v), best[new]
    return a, b, weights


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges between n points are in their least forest; equal weights by (a, b)."""
    order = np.lexsort((b, a, w))
    a, b = a[order], b[order]
    comp, live, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, int)]
    while True:
        c, d = comp[a[live]], comp[b[live]]
        apart = c != d
        live, c, d = live[apart], c[apart], d[apart]
        if not len(live):
            return order[np.unique(np.concatenate(kept))]
        least = np.full(n, len(a))
        least[c[::-1]] = live[::-1]  # edges are in order, so the first one stays
        other = np.full(n, len(a))
        other[d[::-1]] = live[::-1]
        least = np.minimum(least, other)
        has = np.flatnonzero(least < len(a))
        edge = least[has]
        kept.append(edge)
        up = np.arange(n)
        up[has] = comp[a[edge]] + comp[b[edge]] - has
        mutual = has[(up[up[has]] == has) & (has < up[has])]
        up[mutual] = mutual
        while (up[up] != up).any():
            up = up[up]
        comp = up[comp]


def tree_of(pos: np.ndarray, x: np.ndarray, core: np.ndarray, side: np.ndarray | None = None) -> pd.DataFrame:
    """(a, b, w): the spanning tree of points, or of the edges between points of two sides; equal weights by (a, b).

    Trees of pairs of tiles are taken one after another; of their edges those in the least forest so far are kept.
    """
    order = np.argsort(pos)
    pos, x, core = pos[order], x[order], core[order]
    sides = [np.arange(len(pos))] if side is None else [np.flatnonzero(side[order]), np.flatnonzero(~side[order])]
    tiles = [[s[k : k + TILE] for k in range(0, len(s), TILE)] for s in sides]
    pairs = [(p, q) for p in tiles[0] for q in tiles[1]] if side is not None else [(p, None if k == l else q) for k, p in enumerate(tiles[0]) for l, q in enumerate(tiles[0]) if k <= l]
    held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    fresh, count = [], 0
    for k, (p, q) in enumerate(pairs):
        if len(p) + (0 if q is None else len(q)) > 1:
            fresh.append(grown(p, q, x, core))
            count += len(fresh[-1][0])
        if count > 2 * len(pos) or k == len(pairs) - 1:
            held = tuple(np.concatenate(z) for z in zip(held, *fresh, strict=True))
            if len(pairs) > 1:
                least = forest(*held, len(pos))
                held = tuple(z[least] for z in held)
            fresh, count = [], 0
    a, b, w = held
    return pd.DataFrame({"a": pos[a], "b": pos[b], "w": w})


def roots(links: DataFrame) -> DataFrame:
    """(comp, root) of links (comp, up) of which every chain ends in two that point at each other; the less of these is the root."""
    back = links.select(F.col("comp").alias("up"), F.col("up").alias("back"))
    root = F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up"))
    now = stored(links.join(back, "up").select("comp", root.alias("root")), "roots")
    while True:
        up = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(up, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        settled = new.where("moved").isEmpty()
        dropped(now)
        now = new
        if settled:
            return now.select("comp", "root")


def spanning_tree(rows: DataFrame, least: int = 0, block: int | None = None) -> DataFrame:
    """(a, b, w): the minimum spanning tree of points (pos, v), a < b; equal weights are ordered by (a, b), so there is one tree.

    w is the Euclidean distance, or with `least` above 1 the mutual reachability: no less than either point's distance to its
    least-nearest point, itself counted. All distances are taken once: a task gives the tree of the edges between two blocks,
    or of those in one, and an edge of the whole tree is in the tree of its blocks, since elsewhere a lighter way round it
    would be left out. Among the edges of these trees, no two of which are equal and at most two a point and block, each
    component then takes its least one in rounds of joins; rounds are at most the logarithm of the points.
    """
    points = rows.where("v IS NOT NULL").select("pos", "v")
    if least > 1:
        core = neighbours(points, least - 1, block).groupBy("pos").agg(F.max("d").alias("core"))
        points = points.join(core, "pos", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
    else:
        points = points.withColumn("core", F.lit(0.0))
    points = stored(points, "points")

    def tree(own: pd.DataFrame, other: pd.DataFrame | None) -> pd.DataFrame:
        both = own if other is None else pd.concat([own, other])
        side = None if other is None else np.arange(len(both)) < len(own)
        return tree_of(both["pos"].to_numpy(), vectors_of(both), both["core"].to_numpy(), side)

    each = pairs_of_blocks(points, tree, "a long, b long, w double", block)
    now = stored(each.select("a", "b", "w", F.col("a").alias("from"), F.col("b").alias("to")), "edges")
    dropped(points)
    out = None
    while not now.isEmpty():
        ends = now.select(F.col("from").alias("comp"), F.col("to").alias("up"), "w", "a", "b").unionByName(now.select(F.col("to").alias("comp"), F.col("from").alias("up"), "w", "a", "b"))
        edges = stored(ends.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "up")).alias("e")).select("comp", "e.*"), "chosen")
        chosen = edges.select("a", "b", "w").distinct()
        out = chosen if out is None else out.unionByName(chosen)
        root = roots(edges.select("comp", "up"))
        moved = now.join(root.select(F.col("comp").alias("from"), F.col("root").alias("r")), "from").join(root.select(F.col("comp").alias("to"), F.col("root").alias("s")), "to")
        rest = stored(moved.where("r <> s").select("a", "b", "w", F.col("r").alias("from"), F.col("s").alias("to")), "edges")
        dropped(now)
        now = rest
    return out if out is not None else now.select("a", "b", "w")


def cut(points: DataFrame, tree: DataFrame, clusters: int | None = None, reach: float | None = None, smallest: int = 1) -> DataFrame:
    """(pos, cluster): parts of the tree without its clusters - 1 heaviest edges, or without those above `reach`.

    A cluster is named by its least point; parts of fewer than `smallest` points are -1. Labels go along the edges that are left
    and then jump along labels, so rounds grow with the logarithm of the longest path.
    """
    if clusters is not None:
        gone = tree.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(max(clusters - 1, 0))
        kept = tree.join(F.broadcast(gone.select("a", "b")), ["a", "b"], "left_anti")
    else:
        kept = tree.where(F.col("w") <= reach)
    both = stored(kept.select("a", "b").unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))), "kept")
    now = stored(points.select("pos", F.col("pos").alias("cluster")), "labels")
    while True:
        near = both.join(now.select(F.col("pos").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("pos")).agg(F.min("cluster").alias("near"))
        told = now.join(near, "pos", "left").select("pos", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"))
        up = now.select(F.col("pos").alias("cluster"), F.col("cluster").alias("up"))
        new = stored(told.join(up, "cluster").select("pos", F.least("cluster", "up").alias("cluster"), (F.least("cluster", "up") != F.col("old")).alias("moved")), "labels")
        settled = new.where("moved").isEmpty()
        dropped(now)
        now = new
        if settled:
            break
    sizes = now.groupBy("cluster").agg(F.count("*").alias("n"))
    return now.join(sizes, "cluster").select("pos", F.when(F.col("n") >= smallest, F.col("cluster")).otherwise(-1).alias("cluster"))
