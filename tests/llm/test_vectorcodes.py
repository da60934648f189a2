"""Product codes by Exponion search against plain search over all entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import vectorcodes as V


def frame(spark, vectors, labels=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None if labels is None else labels[i]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("seed", range(6))
def test_search_is_exact_from_any_start(seed):
    """Small whole numbers make ties and equal entries common."""
    rng = np.random.default_rng(seed)
    span = (2, 3, 10, 100, 10**4, 1 << 26)[seed]
    entries = rng.integers(-span, span, (3, 20, 2))
    x = rng.integers(-span, span, (500, 3, 2))
    x[:60] = entries[:, rng.integers(0, 20, 60)].transpose(1, 0, 2)
    got, d = V.Book(entries).nearest(x, rng.integers(0, 20, (500, 3)))
    all_d = ((x[:, :, None] - entries[None]) ** 2).sum(3)
    assert (got == all_d.argmin(2)).all() and (d == all_d.min(2)).all()


def test_search_scans_few_entries(monkeypatch):
    """Near its entry, a part meets only the entries inside the radius."""
    rng = np.random.default_rng(7)
    book = V.Book(rng.integers(-1000, 1000, (1, 64, 4)))
    start = rng.integers(0, 64, (300, 1))
    x = book.flat[start[:, 0]][:, None] + rng.integers(-3, 4, (300, 1, 4))
    scanned = []
    monkeypatch.setattr(V, "inside", lambda e, a, b, f=V.inside: scanned.append(len(e)) or f(e, a, b))
    book.nearest(x, start)
    assert sum(scanned) < 2 * 300


def slow(rows, parts, entries, rounds):
    book = np.array([v for _, v in sorted(rows)[:entries]]).reshape(min(entries, len(rows)), parts, -1).transpose(1, 0, 2).copy()
    x = np.array([v for _, v in rows]).reshape(len(rows), parts, -1)
    for k in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(3)
        at = d.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    own = x[at[:, p] == e, p]
                    if len(own):
                        book[p, e] = own.sum(0) // len(own)
    return at, d.min(2).sum(1), book


@pytest.mark.parametrize(("n", "entries", "rounds"), [(300, 16, 2), (300, 16, 4), (5, 16, 2), (40, 1, 2)])
def test_fit_and_encode(spark, n, entries, rounds):
    v = np.random.default_rng(n + rounds).normal(size=(n, 8))
    v[n // 2 :] = v[: n - n // 2]  # rows that repeat
    rows = V.quantized(frame(spark, v)).repartition(5)
    books = V.fit(rows, 4, entries, rounds)
    at, d, book = slow([(i, x) for i, x in enumerate(np.floor(v * 256).astype(int).tolist())], 4, entries, rounds)
    assert len(books) == rounds + 1 and (books[-1] == book).all()
    got = {r["id"]: r for r in V.encode(rows, books).collect()}
    assert len(got) == n and all(got[i]["code"] == bytes(at[i].tolist()).hex() and got[i]["error"] == d[i] for i in range(n))
    near = {r["id"]: r["v"] for r in V.decode(V.encode(rows, books), books).collect()}
    assert np.allclose([np.sum((np.array(near[i]) * 256 - 0.5 - np.floor(v[i] * 256)) ** 2) for i in range(n)], d)


def test_edges(spark, tmp_path):
    odd = [[1.0] * 4, None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0, 0, 0], [-0.001, 0.999 / 256, 2.0, -2.0]]
    rows = V.quantized(frame(spark, odd)).where(F.size("v") > 0)
    assert {r["id"]: r["v"] for r in rows.collect()} == {0: [256] * 4, 6: [-1, 0, 512, -512]}
    assert V.fit(rows.limit(0)) == []
    for bad in ([[1.0] * 4, [1.0] * 3], [[1.0] * 3], [[1e9] * 4]):
        with pytest.raises(ValueError):
            V.fit(V.quantized(frame(spark, bad)), 2, 4)
    frame(spark, odd[1:2]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert V.op12_vector_codes(spark, str(tmp_path)).count() == 0


def test_label_errors_of_nulls_and_repeats(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(200, 16))
    labels = [None if i % 3 == 0 else i % 2 for i in range(200)]
    df = frame(spark, v, labels).withColumn("code", F.lit("x")).withColumn("id", F.lit(1))
    df.unionByName(df.limit(3)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op12_vector_codes(spark, str(tmp_path)).collect()
    sums = {}
    for r in got:
        sums[labels[r["vec_id"]]] = sums.get(labels[r["vec_id"]], 0) + r["error"]
    assert len(got) == 203 and all(r["label_error"] == sums[labels[r["vec_id"]]] for r in got)
