"""Change points, groups and fits of one recording at a time, as array kernels for grouped functions."""

from __future__ import annotations

import numpy as np


def median_gamma(x: np.ndarray, most: int = 1000) -> float:
    """One over the median squared distance of rows, of at most `most` of them, evenly spaced."""
    x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), most)).astype(int))]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d[d > 0]
    return 1 / float(np.median(d)) if len(d) else 1.0


class LinearCost:
    """Squared errors of segments from prefix sums: memory and time of a row in proportion to the length."""

    def __init__(self, x: np.ndarray):
        self.sums = np.vstack([np.zeros(x.shape[1]), x.cumsum(0)])
        self.squares = np.append(0, (x * x).sum(1).cumsum())

    def row(self, starts: np.ndarray, end: int) -> np.ndarray:
        """Costs of the segments [start, end). Ends must not fall from call to call."""
        gap = self.sums[end] - self.sums[starts]
        return self.squares[end] - self.squares[starts] - (gap * gap).sum(1) / (end - starts)


class RbfCost:
    """Kernel costs of segments; of the kernel's table only the sums of one row of blocks are held."""

    def __init__(self, x: np.ndarray, gamma: float | None = None):
        self.x, self.gamma = x, median_gamma(x) if gamma is None else gamma
        self.end, self.block, self.whole = 0, np.zeros(len(x) + 1), np.zeros(len(x) + 1)  # sums over [0, a) x [0, end) and [0, a) x [0, a)

    def row(self, starts: np.ndarray, end: int) -> np.ndarray:
        while self.end < end:
            k = np.exp(-self.gamma * ((self.x - self.x[self.end]) ** 2).sum(1))
            self.block[1:] += k.cumsum()
            self.end += 1
            self.whole[self.end] = self.block[self.end]
        n = end - starts
        return n - (self.block[end] - 2 * self.block[starts] + self.whole[starts]) / n


def segment_costs(x: np.ndarray, kernel: str, gamma: float | None = None) -> LinearCost | RbfCost:
    x = np.asarray(x, np.float64).reshape(len(x), -1)
    if kernel == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    elif kernel not in ("linear", "rbf"):
        raise ValueError(kernel)
    return RbfCost(x, gamma) if kernel == "rbf" else LinearCost(x)


def traced(last: np.ndarray, n: int) -> list[int]:
    out = [n]
    while out[-1] > 0:
        out.append(int(last[out[-1]]))
    return out[::-1]


def change_points(x: np.ndarray, penalty: float, kernel: str = "linear", min_size: int = 2, jump: int = 1, gamma: float | None = None) -> tuple[list[int], float]:
    """Optimal partition by penalised kernel cost with pruning: ([0, ..., n], cost).

    Changes are at multiples of jump; segments hold min_size rows at least (a shorter sequence is one segment). A start is
    pruned once its best can no longer be reached from it through any segment that is long enough, so the result is exact.
    """
    n = len(x)
    if n < 2 * min_size:
        return [0, n], float(segment_costs(x, kernel, gamma).row(np.array([0]), n)[0]) if n else 0.0
    cost = segment_costs(x, kernel, gamma)
    best, last, dead = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.full(n + 1, n + 1)
    best[0], starts = -penalty, np.array([0])
    ends = [b for b in range(jump, n, jump) if b >= min_size] + [n]
    waiting = [b for b in ends if b < n]
    for b in ends:
        fresh = [a for a in waiting if a <= b - min_size]
        waiting = waiting[len(fresh) :]
        starts = np.append(starts, fresh).astype(int)
        starts = starts[(dead[starts] > b) & np.isfinite(best[starts])]
        total = best[starts] + cost.row(starts, b) + penalty
        k = int(total.argmin())
        best[b], last[b] = total[k], starts[k]
        hopeless = starts[total - penalty > best[b]]
        dead[hopeless] = np.minimum(dead[hopeless], b + min_size)
    return traced(last, n), float(best[n])


def fixed_change_points(x: np.ndarray, changes: int, kernel: str = "linear", min_size: int = 2, jump: int = 1, gamma: float | None = None) -> tuple[list[int], float]:
    """The partition of least cost with so many changes, or as many as fit: ([0, ..., n], cost)."""
    n, cost = len(x), segment_costs(x, kernel, gamma)
    if not n:
        return [0, 0], 0.0
    best, last = np.full((changes + 1, n + 1), np.inf), np.zeros((changes + 1, n + 1), int)
    places = np.array([0, *(a for a in range(jump, n, jump) if a >= min_size)])
    for b in [*places[1:].tolist(), n]:
        starts = places[places <= b - min_size] if b >= 2 * min_size else np.array([0])
        c = cost.row(starts, b)
        best[0, b] = c[0]
        for k in range(1, changes + 1):
            total = np.where(starts > 0, best[k - 1, starts] + c, np.inf)
            i = int(total.argmin())
            best[k, b], last[k, b] = total[i], starts[i]
    k = int(np.flatnonzero(np.isfinite(best[:, n])).max())
    out, at = [n], n
    for step in range(k, -1, -1):
        at = int(last[step, at]) if step else 0
        out.append(at)
    return out[::-1], float(best[k, n])


#: Rows of recordings that are cut together, about; longer recordings than LONG are cut one by one, with pruning.
TOGETHER, LONG = 20_000, 1000


class ManyCosts:
    """segment_costs of recordings of about one length, padded: rows of costs for all of them at once."""

    def __init__(self, xs: list[np.ndarray], kernel: str, gammas: list[float] | None = None):
        if kernel not in ("linear", "cosine", "rbf"):
            raise ValueError(kernel)
        size, self.kernel = max(map(len, xs)), kernel
        self.x = np.zeros((len(xs), size, xs[0].shape[1]))
        for own, x in zip(self.x, xs, strict=True):
            own[: len(x)] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if kernel == "cosine" else x
        if kernel == "rbf":
            self.gammas = np.array([median_gamma(x) for x in xs] if gammas is None else gammas)[:, None]
            self.end, self.block, self.whole = 0, np.zeros((len(xs), size + 1)), np.zeros((len(xs), size + 1))
        else:
            self.sums = np.pad(self.x.cumsum(1), ((0, 0), (1, 0), (0, 0)))
            self.squares = np.pad((self.x * self.x).sum(2).cumsum(1), ((0, 0), (1, 0)))

    def row(self, rows: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """(rows, starts): costs of the segments [start, end). Ends must not fall from call to call."""
        n, at = end - starts, np.ix_(rows, starts)
        if self.kernel == "rbf":
            while self.end < end:
                k = np.exp(-self.gammas * ((self.x - self.x[:, self.end : self.end + 1]) ** 2).sum(2))
                self.block[:, 1:] += k.cumsum(1)
                self.end += 1
                self.whole[:, self.end] = self.block[:, self.end]
            return n - (self.block[rows, end][:, None] - 2 * self.block[at] + self.whole[at]) / n
        gap = self.sums[rows, end][:, None] - self.sums[at]
        return self.squares[rows, end][:, None] - self.squares[at] - (gap * gap).sum(2) / n


def partitions_of(xs: list[np.ndarray], kernel: str, penalties: np.ndarray | None, changes: int | None, min_size: int, jump: int, gammas: list[float] | None) -> list[list[tuple[list[int], float]]]:
    """For recordings of about one length: change_points under each of their penalties (recordings, penalties), then fixed_change_points, if a number is given."""
    n, cost = np.array([len(x) for x in xs]), ManyCosts(xs, kernel, gammas)
    penalties = np.zeros((len(xs), 0)) if penalties is None else penalties
    levels, free = 0 if changes is None else changes + 1, penalties.shape[1]
    best, last = np.full((len(xs), free + levels, n.max() + 1), np.inf), np.zeros((len(xs), free + levels, n.max() + 1), int)
    best[:, :free, 0] = -penalties
    for b in range(1, n.max() + 1):
        rows = np.flatnonzero((n == b) | ((n > b) & (b % jump == 0) & (b >= min_size)))
        if not len(rows):
            continue
        starts = np.array([0, *(a for a in range(jump, b - min_size + 1, jump) if a >= min_size)])
        c = cost.row(rows, starts, b)[:, None]
        total = np.empty((len(rows), free + levels, len(starts)))
        total[:, :free] = best[rows, :free][:, :, starts] + c + penalties[rows][:, :, None]
        if levels:
            # with no change all is one segment; the others begin where one change less ended
            total[:, free] = np.where(starts > 0, np.inf, c[:, 0])
            total[:, free + 1 :] = np.where(starts > 0, best[rows, free:-1][:, :, starts] + c, np.inf)
        k = total.argmin(2)
        best[rows, :, b], last[rows, :, b] = np.take_along_axis(total, k[:, :, None], 2)[:, :, 0], starts[k]
    out = []
    for r, end in enumerate(n.tolist()):
        own = [(traced(last[r, i], end), float(best[r, i, end])) for i in range(free)]
        if levels:
            k = int(np.flatnonzero(np.isfinite(best[r, free:, end])).max())
            cuts, at = [end], end
            for step in range(k, -1, -1):
                at = int(last[r, free + step, at])
                cuts.append(at)
            own.append((cuts[::-1], float(best[r, free + k, end])))
        out.append(own)
    return out


def change_points_many(xs: list[np.ndarray], penalties: np.ndarray, kernel: str = "linear", min_size: int = 2, jump: int = 1, changes: int | None = None, gammas: list[float] | None = None) -> list[list[tuple[list[int], float]]]:
    """For each recording (rows of at least one place) its change_points under each of its penalties, then fixed_change_points, if a number is given.

    Recordings of about one length are cut together, so a step is one for all of them.
    """
    out: list = [None] * len(xs)
    order, at = sorted(range(len(xs)), key=lambda i: len(xs[i])), 0
    while at < len(order):
        own = [i for i in order[at : at + max(1, TOGETHER // max(1, len(xs[order[at]])))] if len(xs[i]) <= max(8, 2 * len(xs[order[at]]))]
        at += len(own)
        gamma = None if gammas is None else [gammas[i] for i in own]
        if len(xs[own[-1]]) <= LONG:
            cut = partitions_of([xs[i] for i in own], kernel, penalties[own], changes, min_size, jump, gamma)
        else:
            cut = []
            for k, i in enumerate(own):
                g = None if gamma is None else gamma[k]
                cut.append([change_points(xs[i], float(p), kernel, min_size, jump, g) for p in penalties[i]] + ([] if changes is None else [fixed_change_points(xs[i], changes, kernel, min_size, jump, g)]))
        for i, c in zip(own, cut, strict=True):
            out[i] = c
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 50, seed: int = 47) -> np.ndarray:
    """Lloyd's labels; an empty cluster keeps its centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return near


def merges(d: np.ndarray, method: str = "complete") -> list[tuple[int, int, float, int]]:
    """The tree of agglomerative clusters of a small distance table: (left, right, height, size) by step; leaves are 0 to n - 1, step k makes n + k."""
    how = {"complete": np.max, "single": np.min, "average": np.mean}[method]
    groups, out = {i: [i] for i in range(len(d))}, []
    while len(groups) > 1:
        keys = sorted(groups)
        h, a, b = min((how(d[np.ix_(groups[a], groups[b])]), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        groups[len(d) + len(out)] = groups.pop(a) + groups.pop(b)
        out.append((a, b, float(h), len(groups[len(d) + len(out)])))
    return out


def leaves(tree: list[tuple], node: int) -> list[int]:
    n = len(tree) + 1
    return [node] if node < n else sorted(leaves(tree, tree[node - n][0]) + leaves(tree, tree[node - n][1]))


def numbered(groups: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, int)
    for g, members in enumerate(sorted(groups, key=min)):
        out[members] = g
    return out


def linkage_labels(d: np.ndarray, k: int, method: str = "complete") -> np.ndarray:
    """Agglomerative clusters of a small distance table, cut at k; ties by position."""
    tree, n = merges(d, method), len(d)
    nodes = set(range(n))
    for step, (a, b, *_) in enumerate(tree[: max(0, n - k)]):
        nodes = nodes - {a, b} | {n + step}
    return numbered([leaves(tree, x) for x in nodes], n)


def inconsistency(tree: list[tuple], depth: int = 2) -> np.ndarray:
    """How far each merge's height lies above the mean of the heights down to `depth` levels below it, in their deviations; 0 for none."""
    n, out = len(tree) + 1, []

    def heights(node: int, levels: int) -> list[float]:
        if node < n or not levels:
            return []
        a, b, h, _ = tree[node - n]
        return [h, *heights(a, levels - 1), *heights(b, levels - 1)]

    for k, (_, _, h, _) in enumerate(tree):
        below = np.array(heights(n + k, depth))
        spread = below.std(ddof=1) if len(below) > 1 else 0.0
        out.append((h - below.mean()) / spread if spread > 0 else 0.0)
    return np.array(out)


def inconsistent_labels(tree: list[tuple], threshold: float, depth: int = 2) -> np.ndarray:
    """Clusters of merges that, with all below them, are not more inconsistent than the threshold."""
    n, off, worst = len(tree) + 1, inconsistency(tree, depth), []
    for k, (a, b, *_) in enumerate(tree):
        worst.append(max(off[k], *(worst[x - n] for x in (a, b) if x >= n)) if a >= n or b >= n else off[k])
    nodes, out = [2 * n - 2], []
    while nodes:
        x = nodes.pop()
        if x < n or worst[x - n] <= threshold:
            out.append(leaves(tree, x))
        else:
            nodes += tree[x - n][:2]
    return numbered(out, n)


def temporal_neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Segments of a sequence of vectors: nearest neighbours, distances weighed by how far apart in time, joined level by level down to k.

    Groups of a level become their mean vectors and times. The level that would go below k is replaced by single merges
    of the nearest pair.
    """
    n = len(x)
    label, t = np.arange(n), np.arange(n) / max(n, 1)

    def table(lab: np.ndarray) -> np.ndarray:
        size = np.bincount(lab)
        mean = np.stack([np.bincount(lab, c) / size for c in x.T], 1)
        u = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        at = np.bincount(lab, t) / size
        d = (1 - u @ u.T) * np.abs(at[:, None] - at[None])
        np.fill_diagonal(d, np.inf)
        return d

    def joined(m: int, links: list[tuple[int, int]]) -> np.ndarray:
        root = list(range(m))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return np.unique([find(i) for i in range(m)], return_inverse=True)[1]

    while (m := label.max() + 1) > k:
        d = table(label)
        up = joined(m, list(enumerate(d.argmin(1).tolist())))
        if up.max() + 1 < k:
            a, b = np.unravel_index(int(d.argmin()), d.shape)
            up = joined(m, [(int(a), int(b))])
        label = up[label]
    first = np.full(label.max() + 1, n)
    np.minimum.at(first, label, np.arange(n))
    return np.argsort(np.argsort(first))[label]


def density_labels(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """DBSCAN labels of a small distance table; -1 is noise."""
    near = d <= eps
    core, out, g = near.sum(1) >= least, np.full(len(d), -1), 0
    for i in range(len(d)):
        if not core[i] or out[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if out[j] < 0:
                out[j] = g
                if core[j]:
                    todo += list(np.flatnonzero(near[j] & (out < 0)))
        g += 1
    return out


def spectral_labels(w: np.ndarray, k: int) -> np.ndarray:
    """Normalised spectral clusters of a small similarity table."""
    s = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    _, v = np.linalg.eigh(s[:, None] * w * s[None])
    u = v[:, -k:]
    return kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), k)


def matrix_stats(x: np.ndarray) -> dict[str, float]:
    """Rank, effective rank (exponential of the entropy of singular values) and largest spectral gap."""
    s = np.linalg.svd(x, compute_uv=False)
    p = s / s.sum()
    p = p[p > 0]
    return {"rank": float((s > s[0] * max(x.shape) * np.finfo(float).eps).sum()), "effective_rank": float(np.exp(-(p * np.log(p)).sum())), "gap": float(np.max(s[:-1] - s[1:])) if len(s) > 1 else 0.0}


def matching(gain: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of most total gain (Kuhn-Munkres with potentials); a square or wider table."""
    cost = -np.asarray(gain, float)
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[p[j0] - 1, free - 1] - u[p[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = int(free[least[free].argmin()])
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    return sorted((int(p[j]) - 1, j - 1) for j in range(1, m + 1) if p[j])


def sample_entropy(x: np.ndarray, m: int = 4, r: float = 0.2) -> float:
    """-log of the share of m-long matches that stay matches one step on; null where there are none."""
    tol = r * x.std()
    count = lambda k: sum(int((np.abs(e[i + 1 :] - e[i]).max(1) <= tol).sum()) for e in [np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - m]] for i in range(len(e) - 1))
    if len(x) <= m + 1:
        return float("nan")
    a, b = count(m + 1), count(m)
    return float(-np.log(a / b)) if a and b else float("nan")


def sigmoid_fit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """(L, k, x0) of L / (1 + exp(k (x - x0))) by damped Gauss-Newton; the bends are at x0 -+ ln(2 + sqrt 3) / k."""
    p, damp = np.array([max(y.max(), 1e-9), 1.0, float(np.median(x))]), 1e-2
    f = lambda q: q[0] / (1 + np.exp(np.clip(q[1] * (x - q[2]), -50, 50)))
    for _ in range(rounds):
        s = f(p) / p[0]
        j = np.stack([s, -p[0] * s * (1 - s) * (x - p[2]), p[0] * s * (1 - s) * p[1]], 1)
        move = np.linalg.solve(j.T @ j + damp * np.eye(3), j.T @ (y - f(p)))
        better = ((y - f(p + move)) ** 2).sum() < ((y - f(p)) ** 2).sum()
        p, damp = (p + move, damp / 3) if better else (p, damp * 3)
        if np.abs(move).max() < 1e-10 or damp > 1e12:
            break
    return tuple(map(float, p))


def sinkhorn(cost: np.ndarray, reg: float = 0.05, rounds: int = 200, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """Approximate transport plan, of uniform margins if none are given."""
    k = np.exp(-cost / max(reg * cost.max(), 1e-12))
    a = np.full(len(cost), 1 / len(cost)) if a is None else a
    b = np.full(cost.shape[1], 1 / cost.shape[1]) if b is None else b
    u = np.ones_like(a)
    for _ in range(rounds):
        v = b / np.maximum(k.T @ u, 1e-300)
        u = a / np.maximum(k @ v, 1e-300)
    return u[:, None] * k * v[None]


def gromov_wasserstein(c: np.ndarray, d: np.ndarray, rounds: int = 20, reg: float = 0.05, a: np.ndarray | None = None, b: np.ndarray | None = None) -> float:
    """Approximate Gromov-Wasserstein discrepancy of two distance tables by entropic steps, root taken; uniform margins if none are given."""
    a = np.full(len(c), 1 / len(c)) if a is None else a / a.sum()
    b = np.full(len(d), 1 / len(d)) if b is None else b / b.sum()
    plan = a[:, None] * b[None]
    fixed = ((c**2) @ a)[:, None] + ((d**2) @ b)[None]
    for _ in range(rounds):
        plan = sinkhorn(fixed - 2 * c @ plan @ d + 1e-9, reg, a=a, b=b)
    return float(max(0.0, ((fixed - 2 * c @ plan @ d) * plan).sum()) ** 0.5)


def chi2_tail(x: float, df: int) -> float:
    """Probability that a chi-squared variable exceeds x, from the closed forms for whole degrees of freedom."""
    from math import erfc, exp, gamma, sqrt

    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        return exp(-half) * sum(half**k / gamma(k + 1) for k in range(df // 2))
    return erfc(sqrt(half)) + exp(-half) * sum(half ** (k - 0.5) / gamma(k + 0.5) for k in range(1, (df + 1) // 2))


def random_intercept(stats: np.ndarray, groups: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """(log likelihood, group means, between variance, within variance) of a random intercept model by maximum likelihood.

    stats has rows (n, units, sum of means, sum of squared means, sum of squares within): units of n observations each, of
    the group of that row. With the ratio of the variances fixed the rest is in closed form; the ratio is found by golden
    section. Rows of one group and n can be added up beforehand, so their number does not grow with the units.
    """
    n, units, m, mm, within = stats.T
    names = np.unique(groups)
    total = float((n * units).sum())

    def fit(ratio: float) -> tuple:
        w = n / (1 + n * ratio)
        beta = np.array([(w * m)[groups == g].sum() / (w * units)[groups == g].sum() for g in names])
        b = beta[np.searchsorted(names, groups)]
        sigma = (within + w * (mm - 2 * b * m + units * b * b)).sum() / total
        return -0.5 * (total * (np.log(2 * np.pi * sigma) + 1) + (units * np.log1p(n * ratio)).sum()), beta, sigma

    best = max((fit(r)[0], r) for r in (0.0, *np.logspace(-6, 4, 101)))[1]
    if best:
        lo, hi = np.log(best) - 0.25, np.log(best) + 0.25
        gold = (5**0.5 - 1) / 2
        for _ in range(80):
            p, q = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, q) if fit(np.exp(p))[0] >= fit(np.exp(q))[0] else (p, hi)
        best = float(np.exp((lo + hi) / 2))
    ll, beta, sigma = fit(best)
    return float(ll), beta, float(best * sigma), float(sigma)
