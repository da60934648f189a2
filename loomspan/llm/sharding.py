"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A row descends from the root: at each level every child draws -ln(u) / weight, where u is a hash of the row's id and the
child's name, and the least draw wins. A draw depends on nothing but id, name and weight, so rows move only into or out of
subtrees whose weight changes, and inside them; two children whose weights stay never exchange a row directly.

A plain tree has one flaw: when a new shard makes its region heavier, rows that enter the region fall to its old shards
too. So capacity is commissioned in layers: a layer holds the shards that came together, with their weights. Each level
draws among (child, layer) pairs, and a row won by a layer goes on among that layer's shards only. A shard added later is
a layer of its own and takes rows only into itself; all other rows stay where they were.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, read

#: Bound of a tree's leaves: the children of a level are broadcast.
MOST_LEAVES = 65_536
#: Hexadecimal digits of a draw's hash: 52 bits, so a draw is never 0 or 1.
DIGITS = 13
#: Copies of one row that are numbered by one task; more are dealt out in chunks.
CHUNK = 65_536
LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0
    layer: int = 0

    def path(self, level: int) -> str:
        return "/".join(map(str, (self.region, self.rack, self.shard)[: level + 1]))


def uniform(regions: int, racks: int, shards: int) -> list[Leaf]:
    """Regions of so many racks of so many shards, numbered from 0, of weight 1."""
    return [Leaf(f"r{i}", f"k{j}", (i * racks + j) * shards + k) for i in range(regions) for j in range(racks) for k in range(shards)]


def grown(tree: list[Leaf], new: list[Leaf]) -> list[Leaf]:
    """The tree with these leaves as a layer of their own."""
    layer = 1 + max((x.layer for x in tree), default=-1)
    return checked([*tree, *(replace(x, layer=layer) for x in new)])


def checked(tree: list[Leaf]) -> list[Leaf]:
    if not any(x.weight > 0 for x in tree):
        raise ValueError("no shard has a weight above zero")
    if len(tree) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} shards")
    if len({(x.shard) for x in tree}) < len(tree) or any(not 0 <= x.weight < float("inf") for x in tree):
        raise ValueError("shards need numbers of their own and finite weights, not below zero")
    return tree


def children(spark: SparkSession, tree: list[Leaf], level: int) -> DataFrame:
    """(up, in_layer, kids): the children of each node that hold weight; the root's are those of every layer."""
    weights: dict = {}
    for x in tree:
        up, layer = (x.path(level - 1), x.layer) if level else ("", -1)
        key = (x.path(level), x.layer, x.shard if level == 2 else -1)
        own = weights.setdefault((up, layer), {})
        own[key] = own.get(key, 0.0) + x.weight
    rows = [(up, layer, sorted((*k, float(w)) for k, w in kids.items() if w > 0)) for (up, layer), kids in weights.items()]
    return spark.createDataFrame([r for r in rows if r[2]], "up string, in_layer int, kids array<struct<path: string, layer: int, shard: int, weight: double>>")


def draw(own: Column, kid: Column) -> Column:
    digest = F.md5(F.concat_ws("|", own, kid["path"], kid["layer"].cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / kid["weight"]


def assign(docs: DataFrame, tree: list[Leaf], id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """docs plus `out`, the number of each row's shard: broadcast joins to the tree's levels, no shuffle.

    The id as text and the tree decide alone, so rows of equal ids go together and a null id counts as an empty one.
    Texts are not read. A column of docs that has the name `out`, in any case, is replaced, others are passed through,
    whatever their names. An empty table gives an empty table; ties of draws go to the first name.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in kept)).alias("row_"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("own_"), F.lit("").alias("up"), F.lit(-1).alias("in_layer"))
    for level in range(len(LEVELS)):
        met = rows.join(F.broadcast(children(spark, checked(tree), level)), ["up", "in_layer"])
        drawn = F.transform("kids", lambda k: F.struct(draw(F.col("own_"), k).alias("draw"), k.alias("kid")))
        rows = met.select("row_", "own_", F.array_min(drawn)["kid"].alias("kid")).select("row_", "own_", F.col("kid.path").alias("up"), F.col("kid.layer").alias("in_layer"), F.col("kid.shard").alias("shard_"))
    return rows.select("row_.*", F.col("shard_").alias(out))


def numbered(rows: DataFrame, shard_col: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """rows plus slot: the place of each row in its shard, from 0 without a gap, by md5 of the id, id and the other columns.

    Columns must be comparable. Equal rows are counted first and numbered as one group, so a row that repeats for a third
    of the table is one row until the end, where its copies are dealt out in chunks. Shards are counted in 4,096 slices of
    the hash, which are then shifted by the sizes of those before: no window sees a whole shard.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n_")).withColumn("salt_", F.md5(own.cast("binary")))
    groups = materialize(groups.withColumn("slice_", F.substring("salt_", 1, 3)), "shards")
    sizes = groups.groupBy(shard_col, "slice_").agg(F.sum("n_").alias("size_"))
    before = W.partitionBy(shard_col).orderBy("slice_").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(shard_col, "slice_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("shift_"))
    inside = W.partitionBy(shard_col, "slice_").orderBy("salt_", own, *(c for c in rows.columns if c != shard_col)).rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("base_", F.coalesce(F.sum("n_").over(inside), F.lit(0))).join(shift, [shard_col, "slice_"]).withColumn("base_", F.col("base_") + F.col("shift_"))
    slots = lambda df, lo, hi: df.select(*rows.columns, F.explode(F.sequence(lo, hi)).alias("slot"))
    base, n = F.col("base_"), F.col("n_")
    few = slots(placed.where(n <= CHUNK), base, base + n - 1)
    many = placed.where(n > CHUNK).withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK)))).repartition("salt_", "chunk_")
    return few.unionByName(slots(many, base + F.col("chunk_") * CHUNK, base + F.least(n, (F.col("chunk_") + 1) * CHUNK) - 1))


def write(docs: DataFrame, tree: list[Leaf], path: str, id_col: str = "doc_id") -> None:
    """The rows as Parquet files in one folder for each shard (path/shard=N), as assign deals them."""
    assign(docs, tree, id_col).write.partitionBy("shard").parquet(path)


#: The query's tree and the shard that comes next.
TREE = uniform(2, 3, 4)
NEXT = Leaf("r0", "k0", len(TREE))


def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in 24 shards by law `key`, and the shard that each row would have with one more.

    A null text has no bytes and the checksum of an empty one; nulls, ties, repeats, empty tables and other columns as in
    assign and numbered.
    """
    text = F.col("text")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"))
    both = assign(assign(docs, TREE), grown(TREE, [NEXT]), out="grown_shard")
    return numbered(both).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op11_hash_tree_sharding": op11_hash_tree_sharding}
# children by level as (path, layer, weight); crc is the checksum of the bytes by its bitwise table
ORACLE = {
    "op11_hash_tree_sharding": """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS own, coalesce(text, '') AS text FROM documents),
b AS (SELECT rid, doc_id, own, octet_length(encode(text)) + 8 AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM d, t),
g AS (SELECT 'r' || i AS p, 0 AS layer, 12e0 AS w FROM range(2) r(i) UNION ALL SELECT 'r0', 1, 1e0),
k AS (SELECT 'r' || i AS up, 'r' || i || '/k' || j AS p, 0 AS layer, 4e0 AS w FROM range(2) r(i), range(3) s(j) UNION ALL SELECT 'r0', 'r0/k0', 1, 1e0),
s AS (SELECT 'r' || i || '/k' || j AS up, 'r' || i || '/k' || j || '/' || (i * 12 + j * 4 + l) AS p, 0 AS layer, 1e0 AS w, (i * 12 + j * 4 + l)::INT AS shard FROM range(2) r(i), range(3) s(j), range(4) q(l) UNION ALL SELECT 'r0/k0', 'r0/k0/24', 1, 1e0, 24),
v AS (SELECT *, unnest([0, 1]) AS most FROM b),
a1 AS (SELECT v.*, g.p AS up, g.layer FROM v JOIN g ON g.layer <= v.most QUALIFY row_number() OVER (PARTITION BY rid, most ORDER BY -ln((('0x' || substr(md5(own || '|' || g.p || '|' || g.layer), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0) / g.w, g.p) = 1),
a2 AS (SELECT a1.* EXCLUDE (up, layer), k.p AS up, k.layer FROM a1 JOIN k ON k.up = a1.up AND k.layer = a1.layer QUALIFY row_number() OVER (PARTITION BY rid, most ORDER BY -ln((('0x' || substr(md5(own || '|' || k.p || '|' || k.layer), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0) / k.w, k.p) = 1),
a3 AS (SELECT a2.*, s.shard FROM a2 JOIN s ON s.up = a2.up AND s.layer = a2.layer QUALIFY row_number() OVER (PARTITION BY rid, most ORDER BY -ln((('0x' || substr(md5(own || '|' || s.p || '|' || s.layer), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0) / s.w, s.p) = 1)
SELECT x.doc_id, x.size::BIGINT AS size, x.text_crc32, 'key' AS law, x.shard, row_number() OVER (PARTITION BY x.shard ORDER BY md5(x.own), x.own, x.size, x.text_crc32) - 1 AS slot, y.shard AS grown_shard
FROM a3 x JOIN a3 y ON y.rid = x.rid AND y.most = 1 WHERE x.most = 0""",
}
