"""Sums of vectors and of their products over all rows, and what follows from them: means, covariances, whitening, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that seeds and shifts are taken from, at most.
SAMPLE = 4096
#: The reference's guard of a direction without variance.
EPSILON = 1e-10


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """A column of arrays as a matrix."""
    v = batch.column(batch.schema.get_field_index(column))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


def added(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of sums(x), a matrix whose shape does not depend on x.

    Each task adds up its own batches; the tasks' matrices are then dealt by their row and added up there, so the driver gets
    one matrix, whatever the tasks. Null vectors are left out.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = sums(matrix(b))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lists(total)], ["k", "x"])

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), matrix(b, "x"), strict=True):
                held[k] = held[k] + x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), lists(np.array(list(held.values())))], ["k", "x"])

    schema = "k long, x array<double>"
    parts = rows.where("v IS NOT NULL").select("v").mapInArrow(own, schema).repartition("k").mapInArrow(all_, schema).collect()
    return np.array([r["x"] for r in sorted(parts, key=lambda r: r["k"])])


def pilot(rows: DataFrame, id_col: str = "pos", most: int = SAMPLE) -> np.ndarray:
    """Up to `most` vectors, those of the least hashes of their ids: the same ones however the rows are dealt."""
    held = rows.where("v IS NOT NULL").select("v", F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(most).collect()
    return np.array([r["v"] for r in held], np.float64)


def covariance(rows: DataFrame, id_col: str = "pos") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) from one pass; sums are taken about the mean of a sample, which keeps their digits."""
    about = pilot(rows, id_col)
    if not len(about):
        raise ValueError("no vectors")
    c = about.mean(0)

    def sums(x: np.ndarray) -> np.ndarray:
        y = np.column_stack([np.ones(len(x)), x - c])
        return y.T @ y

    s = added(rows, sums)
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    return int(n), c + mean, (s[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def mapped(rows: DataFrame, a: np.ndarray, about: np.ndarray, out: str = "v") -> DataFrame:
    """rows with (v - about) times a in place of v, named `out`; null vectors are left out."""
    kept = [c for c in rows.columns if c != "v"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), lists((matrix(b) - about) @ a)], [*kept, out])

    return rows.where("v IS NOT NULL").select(*(F.col(f"`{c}`") for c in kept), "v").mapInArrow(run, schema)


def spectrum(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest, and the vectors as columns, each with its greatest component above zero."""
    w, u = np.linalg.eigh(cov)
    w, u = w[::-1], u[:, ::-1]
    return np.maximum(w, 0), u * np.sign(u[np.abs(u).argmax(0), np.arange(len(w))])


def whitened(rows: DataFrame, id_col: str = "pos") -> DataFrame:
    """rows with v whitened by one covariance of all rows, turned back to the axes it came from (ZCA)."""
    _, mean, cov = covariance(rows, id_col)
    w, u = spectrum(cov)
    return mapped(rows, (u / np.sqrt(w + EPSILON)) @ u.T, mean)


def components(rows: DataFrame, k: int, white: bool = False, id_col: str = "pos") -> tuple[DataFrame, np.ndarray]:
    """(rows with z in place of v, variances): the first k principal components, divided by their deviation if white.

    k above the number of components gives all of them. A direction without variance is 0 when whitened.
    """
    _, mean, cov = covariance(rows, id_col)
    w, u = spectrum(cov)
    scale = np.where(w > w[0] * 1e-12, 1 / np.sqrt(w + EPSILON), 0.0) if white else np.ones(len(w))
    return mapped(rows, (u * scale)[:, :k], mean, "z"), w[:k]
