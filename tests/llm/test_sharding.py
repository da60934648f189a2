"""Sharding by a hierarchical weighted hash tree."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import sharding
from loomspan.llm.sharding import Leaf, assign, grown, numbered, uniform


def shards(df, tree, col="shard"):
    return {r["doc_id"]: r[col] for r in assign(df, tree, out=col).select("doc_id", col).collect()}


def slow(own, tree):
    """The descent written plainly: least -ln(u) / weight among the children at each level."""
    up, layer = "", -1
    for level in range(3):
        weights = Counter()
        for x in tree:
            if level == 0 or (x.path(level - 1), x.layer) == (up, layer):
                weights[(x.path(level), x.layer)] += x.weight
        key = lambda k: (-math.log((int(hashlib.md5(f"{own}|{k[0]}|{k[1]}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / weights[k], k)
        up, layer = min((k for k in weights if weights[k] > 0), key=key)
    return int(up.rsplit("/", 1)[1])


TREE = [Leaf("a", "x", 0, 2.0), Leaf("a", "x", 1, 1.0), Leaf("a", "y", 2, 3.0), Leaf("b", "x", 3, 1.0), Leaf("b", "x", 4, 0.0), Leaf("c", "z", 5, 5.0)]


def test_descent(spark):
    df = spark.range(400).toDF("doc_id")
    assert shards(df, TREE) == {i: slow(str(i), TREE) for i in range(400)}


def test_rows_follow_the_weights(spark):
    got = Counter(shards(spark.range(24000).toDF("doc_id"), TREE).values())
    assert got[4] == 0 and all(abs(got[x.shard] - 2000 * x.weight) < 5 * math.sqrt(2000 * x.weight + 1) for x in TREE)


@pytest.mark.parametrize("new", [[Leaf("a", "x", 6)], [Leaf("b", "new", 6, 4.0)], [Leaf("d", "x", 6, 0.5)], [Leaf("a", "y", 6), Leaf("c", "z", 7, 2.0)]])
def test_a_new_layer_takes_rows_only_into_itself(spark, new):
    df = spark.range(5000).toDF("doc_id")
    before, after = shards(df, TREE), shards(df, grown(TREE, new))
    moved = {i for i in before if before[i] != after[i]}
    share = sum(x.weight for x in new) / (12 + sum(x.weight for x in new))
    assert {after[i] for i in moved} <= {x.shard for x in new} and abs(len(moved) - 5000 * share) < 5 * math.sqrt(5000 * share)


def test_layer_on_layer(spark):
    df, tree = spark.range(3000).toDF("doc_id"), uniform(1, 2, 2)
    before = shards(df, tree)
    for k in range(4, 9):
        tree = grown(tree, [Leaf("r0", f"k{k % 2}", k)])
        after = shards(df, tree)
        assert all(after[i] in (before[i], k) for i in after)
        before = after


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    """Racks and regions whose weights stay never exchange a row directly, and shards keep their rows among themselves."""
    df = spark.range(6000).toDF("doc_id")
    changed = [x if x.shard != 2 else Leaf("a", "y", 2, 6.0) for x in TREE]
    before, after = shards(df, TREE), shards(df, changed)
    region = {x.shard: x.region for x in TREE}
    moved = [(region[before[i]], region[after[i]], before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b == "a" for _, b, _, _ in moved)
    assert all(y == 2 for a, _, _, y in moved if a == "a")


def test_slots_have_no_gap_and_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 50)
    df = spark.range(900).select((F.col("id") % 600).alias("doc_id"), F.lit(9).alias("size"))
    df = df.unionByName(spark.range(500).select(F.lit(5).cast("long").alias("doc_id"), F.lit(9).alias("size"))).unionByName(spark.range(130).select(F.lit(None).cast("long").alias("doc_id"), F.lit(8).alias("size")))
    rows = numbered(assign(df, uniform(1, 1, 3))).collect()
    assert len(rows) == 1530
    for s in range(3):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


def test_edges(spark, tmp_path):
    odd = spark.createDataFrame([(1, "x", "y", "z"), (None, None, "", "")], "doc_id long, `a.b` string, Shard string, up string")
    out = assign(odd, TREE)
    assert out.columns == ["doc_id", "a.b", "up", "shard"] and out.count() == 2
    assert assign(odd.limit(0), TREE).count() == 0 and numbered(assign(odd.select("doc_id").limit(0), TREE)).count() == 0
    sharding.write(odd.drop("Shard"), TREE, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    with pytest.raises(ValueError):
        assign(odd, [Leaf("a", "x", 0, 0.0)])
    with pytest.raises(ValueError):
        assign(odd, [Leaf("a", "x", 0), Leaf("b", "x", 0)])
