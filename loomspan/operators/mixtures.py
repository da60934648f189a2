"""Clusters of vectors by k-means, by Gaussian mixtures and by Dirichlet-process mixtures.

All three go the same way: the driver holds parameters whose size does not depend on the rows, tasks add up what the next ones
need (`moments.added`), and a step on the driver makes them. Starts come from a sample in order of hashed ids, so nothing
depends on how rows are dealt, but for the last digits of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.moments import added, covariance, matrix, pilot
from loomspan.sources.stored import shared

#: Added to the diagonal of a covariance that is estimated from its rows alone.
REGULAR = 1e-6
TOLERANCE = 1e-3
#: Rows of a block of the incremental fit, and blocks, at most: beyond, blocks grow.
BLOCK, MOST_BLOCKS = 10_000, 100


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to 6 and the asymptotic series from there: error below 1e-10."""
    x, out = np.array(x, np.float64), np.zeros(np.shape(x))
    while (x < 6).any():
        out, x = np.where(x < 6, out - 1 / x, out), np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


lgamma = np.vectorize(math.lgamma)


# --- k-means ---


def seeds(sample: np.ndarray, k: int, cosine: bool = False, seed: int = 47, rounds: int = 20) -> np.ndarray:
    """k centres of a sample: drawn in proportion to the squared distance from those before, then moved by Lloyd's rounds."""
    x, rng = unit(sample) if cosine else sample, np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    for _ in range(k - 1):
        d = squared(x, centres).min(1)
        if d.sum() <= 0:
            break
        centres = np.vstack([centres, x[min(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), "right"), len(x) - 1)]])
    for _ in range(rounds):
        at = squared(x, centres).argmin(1)
        centres = moved(centres, np.array([np.append(x[at == j].sum(0), (at == j).sum()) for j in range(len(centres))]), cosine)
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def moved(centres: np.ndarray, sums: np.ndarray, cosine: bool) -> np.ndarray:
    """The means of each centre's rows (columns: sums, count); a centre without rows stays."""
    n = sums[:, -1:]
    new = np.where(n > 0, sums[:, :-1] / np.maximum(n, 1), centres)
    return unit(new) if cosine else new


def kmeans(rows: DataFrame, k: int, cosine: bool = False, id_col: str = "pos", rounds: int = 100, tolerance: float = 1e-4, tries: int = 2) -> tuple[np.ndarray, float]:
    """(centres, cost): Lloyd's rounds over all rows from each of `tries` starts; the start of least cost wins.

    All starts share one pass a round. The cost is the sum of squared distances; by cosine, of vectors of length 1.
    """
    sample = pilot(rows, id_col)
    if not len(sample):
        raise ValueError("no vectors")
    books = [seeds(sample, k, cosine, 47 + t) for t in range(tries)]
    for _ in range(rounds):

        def sums(x: np.ndarray, books: list = books) -> np.ndarray:
            x = unit(x) if cosine else x
            out = []
            for c in books:
                d = squared(x, c)
                at = d.argmin(1)
                s = np.zeros((len(c), x.shape[1] + 2))
                np.add.at(s, at, np.column_stack([x, np.ones(len(x)), d[np.arange(len(x)), at]]))
                out.append(s)
            return np.vstack(out)

        parts = np.split(added(rows, sums), np.cumsum([len(c) for c in books])[:-1])
        costs = [p[:, -1].sum() for p in parts]
        new = [moved(c, p[:, :-1], cosine) for c, p in zip(books, parts, strict=True)]
        far = max(((a - b) ** 2).sum(1).max() for a, b in zip(books, new, strict=True))
        if far <= tolerance**2:
            break
        books = new
    best = int(np.argmin(costs))
    return books[best], float(costs[best])


def nearest(rows: DataFrame, centres: np.ndarray, cosine: bool = False) -> DataFrame:
    """rows without v, plus cluster and dist: the nearest centre (the least number of equals); dist is Euclidean, or one less the cosine."""

    def label(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squared(unit(x) if cosine else x, centres)
        at = d.argmin(1)
        d = d[np.arange(len(x)), at]
        return at, d / 2 if cosine else np.sqrt(d)

    return labelled(rows, label)


def labelled(rows: DataFrame, label) -> DataFrame:
    """rows without v, plus cluster and dist as label(x) gives them; null vectors are left out."""
    kept = [c for c in rows.columns if c != "v"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "cluster long, dist double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, dist = label(matrix(b))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(cluster.astype(np.int64)), pa.array(dist)], [*kept, "cluster", "dist"])

    return rows.where("v IS NOT NULL").select(*(F.col(f"`{c}`") for c in kept), "v").mapInArrow(run, schema)


# --- mixtures ---


@dataclass
class Mixture:
    """Full covariances. A row's weight in component k goes as exp(const[k] - |(x - mean[k]) factor[k]|^2 / 2)."""

    const: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    weights: np.ndarray
    #: what is taken off the sum of the rows' log densities to give the lower bound
    penalty: float = 0.0
    bounds: list = field(default_factory=list)
    converged: bool = False

    def logs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([c - 0.5 * (((x - m) @ f) ** 2).sum(1) for c, m, f in zip(self.const, self.means, self.factors, strict=True)])

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each row's log density, its share in each component)."""
        log = self.logs(x)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return total, np.exp(log - total[:, None])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """A row for each component: sum of shares, of shares times x, of shares times x x', and of log densities (in the first row)."""
        total, r = self.shares(x)
        y = np.column_stack([np.ones(len(x)), x])
        out = np.einsum("nk,ni,nj->kij", r, y, y, optimize=True).reshape(r.shape[1], -1)
        first = np.zeros((len(out), 1))
        first[0] = total.sum()
        return np.hstack([out, first])


def unpacked(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(counts, means, scatter about the means, sum of log densities)."""
    s = sums[:, :-1].reshape(-1, d + 1, d + 1)
    n = s[:, 0, 0] + 10 * np.finfo(float).eps
    mean = s[:, 0, 1:] / n[:, None]
    return n, mean, s[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :], float(sums[:, -1].sum())


def gaussian(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> Mixture:
    """The most likely mixture."""
    d = mean.shape[1]
    factors = np.array([np.linalg.inv(np.linalg.cholesky(s / c + REGULAR * np.eye(d))).T for s, c in zip(scatter, n, strict=True)])
    weights = n / n.sum()
    const = np.log(weights) - d / 2 * math.log(2 * math.pi) + np.log(np.einsum("kii->ki", factors)).sum(1)
    return Mixture(const, mean, factors, weights)


@dataclass
class Prior:
    """Of a Dirichlet process (sticks of concentration 1 / k) over Normal-Wishart components about the mean and covariance of all rows."""

    mean: np.ndarray
    covariance: np.ndarray
    precision: float = 1.0


def wishart(logdet: np.ndarray, nu: np.ndarray, d: int) -> np.ndarray:
    """The log of the Wishart density's constant."""
    i = np.arange(d)
    return -nu / 2 * logdet - (nu * d / 2 * math.log(2) + d * (d - 1) / 4 * math.log(math.pi) + lgamma((nu[:, None] - i) / 2).sum(1))


def dirichlet(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray, prior: Prior) -> Mixture:
    """The posterior given the shares, as expected logs; penalty is the divergence of all parameters from the prior."""
    k, d = mean.shape
    gamma, b0, nu0 = 1 / k, prior.precision, float(d)
    beta, nu = b0 + n, nu0 + n
    m = (b0 * prior.mean + n[:, None] * mean) / beta[:, None]
    off = mean - prior.mean
    inverse = prior.covariance * nu0 + scatter + (b0 * n / beta)[:, None, None] * off[:, :, None] * off[:, None, :]
    w = np.linalg.inv(inverse)
    w = (w + w.transpose(0, 2, 1)) / 2
    logdet = -np.linalg.slogdet(inverse)[1]
    a, b = 1 + n, gamma + np.append(np.cumsum(n[::-1])[-2::-1], 0.0)
    stay, go = digamma(a) - digamma(a + b), digamma(b) - digamma(a + b)
    weight = stay + np.append(0.0, np.cumsum(go)[:-1])
    expected = digamma((nu[:, None] - np.arange(d)) / 2).sum(1) + d * math.log(2) + logdet
    const = weight + 0.5 * (expected - d * math.log(2 * math.pi) - d / beta)
    factors = np.array([np.linalg.cholesky(x) * math.sqrt(v) for x, v in zip(w, nu, strict=True)])
    # divergences: sticks, means given precisions, precisions
    beta_log = lambda p, q: lgamma(p) + lgamma(q) - lgamma(p + q)
    sticks = beta_log(np.ones(k), np.full(k, gamma)) - beta_log(a, b) + (a - 1) * stay + (b - gamma) * go
    shift = m - prior.mean
    normal = 0.5 * (d * b0 / beta + b0 * nu * np.einsum("ki,kij,kj->k", shift, w, shift) - d + d * np.log(beta / b0))
    w0 = -np.linalg.slogdet(prior.covariance * nu0)[1]
    precision = (nu - nu0) / 2 * expected - nu * d / 2 + nu / 2 * np.einsum("ij,kji->k", prior.covariance * nu0, w)
    precision += wishart(logdet, nu, d) - wishart(np.full(k, w0), np.full(k, nu0), d)
    share = np.exp(np.log(a / (a + b)) + np.append(0.0, np.cumsum(np.log(b / (a + b)))[:-1]))
    return Mixture(const, m, factors, share / share.sum(), float((sticks + normal + precision).sum()))


def start(rows: DataFrame, k: int, id_col: str, prior: Prior | None) -> Mixture:
    """From the k-means of a sample: shares of 0 and 1."""
    x = pilot(rows, id_col)
    if not len(x):
        raise ValueError("no vectors")
    at = squared(x, seeds(x, k)).argmin(1)
    r = np.eye(k)[at]
    y = np.column_stack([np.ones(len(x)), x])
    s = np.einsum("nk,ni,nj->kij", r, y, y, optimize=True).reshape(k, -1)
    n, mean, scatter, _ = unpacked(np.hstack([s, np.zeros((k, 1))]), x.shape[1])
    return dirichlet(n, mean, scatter, prior) if prior else gaussian(n, mean, scatter + n[:, None, None] * np.cov(x.T).reshape(x.shape[1], -1) * 1e-3)


def fit(rows: DataFrame, k: int, process: bool = False, id_col: str = "pos", rounds: int = 100, tolerance: float = TOLERANCE, warm: Mixture | None = None, prior: Prior | None = None) -> Mixture:
    """A mixture of k Gaussians, or the Dirichlet process cut at k, by rounds over all rows (id, v) until the lower bound of a row gains less than the tolerance.

    bounds holds the lower bound (of a row: the mean log likelihood, less the divergence from the prior for a process) at the
    start of each round; it never falls. Components that the rows do not need lose their weight in a process. Parameters are
    k times the squared width: reduce wide vectors before (moments.components). warm: where to start.
    """
    if process and prior is None:
        _, mean, cov = covariance(rows, id_col)
        prior = Prior(mean, cov + REGULAR * np.eye(len(mean)))
    model = warm or start(rows, k, id_col, prior if process else None)
    bounds: list = []
    for _ in range(rounds):
        n, mean, scatter, total = unpacked(added(rows, model.sums), model.means.shape[1])
        bounds.append(float((total - model.penalty) / n.sum()))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tolerance:
            model.converged = True
            break
        model = dirichlet(n, mean, scatter, prior) if process else gaussian(n, mean, scatter)
    model.bounds = bounds
    return model


def predict(rows: DataFrame, model: Mixture) -> DataFrame:
    """rows without v, plus cluster (the component of the greatest share) and dist, its share."""

    def label(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = model.shares(x)[1]
        at = r.argmax(1)
        return at, r[np.arange(len(x)), at]

    return labelled(rows, label)


def criteria(rows: DataFrame, model: Mixture) -> tuple[int, float, float]:
    """(rows, AIC, BIC) of a mixture of Gaussians."""
    s = added(rows, lambda x: np.array([[len(x), model.shares(x)[0].sum()]]))[0]
    k, d = model.means.shape
    free = k * d + k * d * (d + 1) // 2 + k - 1
    return int(s[0]), float(-2 * s[1] + 2 * free), float(-2 * s[1] + free * math.log(s[0]))


def incremental(rows: DataFrame, k: int, process: bool = False, id_col: str = "pos", block: int = BLOCK, rounds: int = 100) -> tuple[Mixture, list[dict]]:
    """(model, one report for each block): the rows in blocks of about `block` in order of hashed ids, each fitted from where the one before ended.

    Blocks are written once as folders, so a block's rounds read that block only. Blocks grow beyond MOST_BLOCKS of them, since
    they wait for each other. The prior of a process is that of all rows. A report has the block, its rows, rounds, whether
    they settled, the lower bound, and AIC and BIC for Gaussians.
    """
    spark, n = rows.sparkSession, rows.where("v IS NOT NULL").count()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(n / block)))
    path = f"{shared(spark)}/blocks-{id(rows)}-{np.random.default_rng().integers(1 << 62)}"
    rows.where("v IS NOT NULL").select(F.col(id_col).alias("pos"), "v").withColumn("block", F.pmod(F.xxhash64("pos", F.lit(11)), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
    prior = None
    if process:
        _, mean, cov = covariance(rows, id_col)
        prior = Prior(mean, cov + REGULAR * np.eye(len(mean)))
    model, reports = None, []
    for b in sorted(r["block"] for r in spark.read.parquet(path).select("block").distinct().collect()):
        own = spark.read.parquet(f"{path}/block={b}")
        model = fit(own, k, process, "pos", rounds, warm=model, prior=prior)
        size, aic, bic = (own.count(), None, None) if process else criteria(own, model)
        reports.append({"block": int(b), "rows": size, "rounds": len(model.bounds), "converged": model.converged, "bound": model.bounds[-1], "aic": aic, "bic": bic})
    return model, reports
