"""The matrix source: row ranges, pushed filters, bytes read, parts and commits."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.sources import matrix as X


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f4", ">f8", "i2"])
def test_only_the_range_is_read(order, dtype):
    x = np.asarray(np.arange(5000).reshape(500, 10), dtype, order)
    f = Counted()
    np.save(f, x)
    f.seek(0)
    h = X.header(f)
    start = f.read_bytes
    assert start == h.offset <= 256
    got = X.rows_of(f, h, 100, 120, 2, 5)
    assert (got == x[100:120, 2:5]).all()
    assert f.read_bytes - start == 20 * (3 if order == "F" else 10) * x.dtype.itemsize


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=(1000, 6)), "b/c d": np.asfortranarray(rng.normal(size=(7, 6))), "empty": np.zeros((0, 6)), "v": np.arange(5.0)}
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "a.npy", x["a"])
    np.save(tmp_path / "deep" / "b%2Fc%20d.npy", x["b/c d"])
    np.save(tmp_path / "empty.npy", x["empty"])
    np.save(tmp_path / "v.npy", x["v"])
    return str(tmp_path), x


def test_partitions_ranges_and_filters(spark, folder):
    path, x = folder
    m = X.matrices(spark, f"file:{path}", split=100 * 6 * 8)
    assert m.rdd.getNumPartitions() == 12  # ten of a, one of b and v each
    rows = {(r.identifier, r.pos): r.v for r in m.collect()}
    assert len(rows) == 1012 and all(np.array_equal(rows[n, i], np.atleast_1d(x[n][i])) for n, i in rows)
    some = m.where("pos >= 250 AND pos < 251 AND identifier = 'a'")
    assert some.rdd.getNumPartitions() == 1 and [list(r.v) for r in some.collect()] == [list(x["a"][250])]
    assert X.matrices(spark, path, columns="1:3", start=998).collect()[1].v == list(x["a"][999, 1:3])
    assert X.matrices(spark, path).where("identifier IN ('a', 'v') AND pos > 2 AND pos <= 4").count() == 4
    assert X.matrices(spark, path, end=0).count() == 0 and X.matrices(spark, path).where("pos < 0").count() == 0
    assert X.matrices(spark, f"{path}/v.npy").count() == 5


def test_write_in_parts(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(n, 40 + i, [float(z) for z in rng.normal(size=3)]) for n, k in (("long", 95), ("s/1", 10), ("one", 1)) for i in range(k)]
    df = spark.createDataFrame(rows, "identifier string, pos long, v array<double>").repartition(7)
    at = str(tmp_path / "out")
    for _ in range(2):  # the second run replaces the first
        X.save_matrices(df, at, rows=10)
    assert np.load(f"{at}/s%2F1.npy").shape == (10, 3) and len(os.listdir(f"{at}/long.npy")) == 10
    assert sorted(os.listdir(at)) == ["_temporary", "long.npy", "one.npy", "s%2F1.npy"] and not os.listdir(f"{at}/_temporary")
    got = {(r.identifier, r.pos + 40): r.v for r in X.matrices(spark, at).collect()}
    assert got == {(n, i): v for n, i, v in rows}
    inside = X.matrices(spark, at, start=15, end=31)
    assert sorted(r.pos for r in inside.collect()) == list(range(15, 31)) and inside.rdd.getNumPartitions() == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    good = spark.createDataFrame([("a", i, [1.0]) for i in range(4)], "identifier string, pos long, v array<double>")
    X.save_matrices(good, at)
    for bad in (good.withColumn("pos", F.col("pos") * 2), good.withColumn("v", F.sequence(F.lit(0), F.col("pos").cast("int")).cast("array<double>"))):
        with pytest.raises(PySparkException):
            X.save_matrices(bad, at)
    assert X.matrices(spark, at).count() == 4


def test_items_are_cropped_while_they_are_read(spark, folder):
    path, x = folder
    meta = spark.createDataFrame([("a", 10, 13, "g"), ("v", 0, 99, "h"), ("gone", 0, 5, "i"), ("empty", 0, 5, "j")], "identifier string, s long, e long, label string")
    got = {r.identifier: (r.first, np.array(r.inputs), r.label) for r in X.items(spark, path, meta).collect()}
    assert set(got) == {"a", "v"} and got["a"][0] == 10 and np.array_equal(got["a"][1], x["a"][10:13]) and got["v"][1].shape == (5, 1)
    assert X.items(spark, path, meta.limit(0)).count() == 0


def test_tasks_and_bounds_do_not_grow_with_small_files_and_other_recordings(spark, tmp_path, monkeypatch):
    for i in range(300):
        np.save(tmp_path / f"{i}.npy", np.full((6, 2), float(i)))
    m = X.matrices(spark, str(tmp_path), split=32)
    assert m.rdd.getNumPartitions() == X.TASKS
    assert {(r.identifier, r.pos): r.v for r in m.collect()} == {(str(i), k): [float(i)] * 2 for i in range(300) for k in range(6)}
    asked = []
    whole = X.matrices
    monkeypatch.setattr(X, "matrices", lambda s, path, **o: asked.append(o) or whole(s, path, **o))
    meta = spark.range(290, 2000).selectExpr("cast(id AS string) AS identifier", "1 AS s", "4 AS e")
    got = {r.identifier: (len(r.inputs), r.first) for r in X.items(spark, str(tmp_path), meta).collect()}
    assert got == {str(i): (3, 1) for i in range(290, 300)} and len(json.loads(asked[0]["bounds"])) == 10
