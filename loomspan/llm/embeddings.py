"""Embedding near-duplicates on a flat, robust-pruned graph.

Vectors are dealt to the shards of their nearest centroids, so shards overlap. Each shard builds a pruned neighbour
graph; a vector's adjacency list is the union over its shards. Greedy search descends from the shard's medoid along the
joined lists to each query, then the range expansion follows every neighbour inside the range until no new one turns up.
A node's edges and the beam are bounded, so a bunch of near copies can hide its neighbours: each shard's search is
therefore held against all pairs of the shard, by blocks, and what it missed is added. From there the range expansion
goes on over the merged graph: along the united lists of a vector's linked neighbours to vectors that share no shard with
it, until no new link turns up. Links are verified in double precision, and the recall of every build is audited against brute
force for a sample of queries; a build that misses the target is repeated with more overlap, and in the end by a search
that compares all pairs of shards that the triangle inequality does not rule out.

Equal vectors are collapsed first. Only centroids (a bounded number) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, read
from loomspan.llm.graph import connected_components

RANGE = 0.9
#: Edges a vector keeps in one shard, candidates considered, and how much closer a kept neighbour must be to shadow another.
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Search beam of the descent.
BEAM = 16
SHARD = 1500
#: Bounds: vectors that centroids are fitted on, and centroids.
SAMPLE, MOST_CENTROIDS = 20_000, 4096
OVERLAP = 3
#: A shard beyond this many vectors is split at random; a vector is a query in all parts and a node in one.
MOST_SHARD = 6000
RECALL = 0.98
#: Queries of the recall audit, chosen by a hash of the vector.
AUDIT = 256


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def pruned(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n x degree, -1 for none) by robust pruning of each node's nearest candidates, all nodes at once.

    A candidate goes when a kept neighbour is alpha times closer to it than the node is, by Euclidean distance.
    """
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return out
    for begin in range(0, n, 512):
        rows = np.arange(begin, min(n, begin + 512))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -9
        cand = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        d = np.maximum(0, 2 - 2 * np.take_along_axis(near, cand, 1))
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        alive = np.ones_like(cand, bool)
        vec = x[cand]
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[rows[some], k] = cand[some, pick[some]]
            alive[np.arange(len(rows)), pick] = False
            between = np.maximum(0, 2 - 2 * np.einsum("npd,nd->np", vec, vec[np.arange(len(rows)), pick]))
            alive &= ~((alpha * alpha * between <= d) & some[:, None])
    return out


def expand(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, medoid: int, limit: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each query (a row of x), the nodes within the range, itself left out: greedy descent, then range expansion."""
    out = []
    for q in queries:
        v = x[q]
        seen = np.zeros(len(x), bool)
        seen[medoid] = seen[q] = True
        near = np.array([medoid])
        sims = x[near] @ v
        done: set[int] = set()
        own = links[q]  # the query is a node: its own edges start the search too
        front = own[~seen[own]]
        while True:
            front = np.unique(front)
            if len(front):
                seen[front] = True
                near = np.append(near, front)
                sims = np.append(sims, x[front] @ v)
            best = [i for i in np.argsort(-sims, kind="stable")[:beam] if near[i] not in done]
            inside = [i for i in np.flatnonzero(sims >= limit - 0.05) if near[i] not in done]
            todo = {int(near[i]) for i in (*best[:2], *inside)}
            if not todo:
                break
            done |= todo
            more = np.concatenate([links[i] for i in todo])
            front = more[~seen[more]]
        out.append(near[sims >= limit - 1e-6])
    return out


def close(x: np.ndarray, queries: np.ndarray, nodes: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (q, i) of x, q of queries and i of nodes, within the range: all pairs, by blocks."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    y = x[nodes].T
    for k in range(0, len(queries), 512):
        at, of = np.nonzero(x[queries[k : k + 512]] @ y >= limit - 1e-6)
        out.append((queries[k + at], nodes[of]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def linked(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    keep = a != b
    return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()


def kind(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.simpleString()


def shards_of(vectors: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """(shard int, home boolean, id, v): each vector in its `overlap` nearest shards; home is the nearest."""
    overlap = min(overlap, len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                near = np.argsort(-(unit(part.column(1).to_pylist()) @ c.T), axis=1, kind="stable")[:, :overlap]
                take = pa.array(np.repeat(np.arange(part.num_rows), overlap))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(overlap) == 0, part.num_rows)), part.column(0).take(take), part.column(1).take(take)], ["shard", "home", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, f"shard int, home boolean, id long, v {kind(vectors)}")


def graph_links(vectors: DataFrame, c: np.ndarray, overlap: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) ids of vectors with cosine >= limit that share a shard, a < b: those the graph search finds and those it misses; and the merged graph.

    The graph is (id, near, shards): the union of a vector's adjacency lists, and the shards it is in.
    """
    dealt = materialize(shards_of(vectors, c, overlap), "embedding-shards")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    parts = dealt.join(F.broadcast(sizes), "shard").withColumn("parts", F.ceil(F.col("n") / MOST_SHARD).cast("int"))
    nodes = parts.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["v"].tolist())
        ids = pdf["id"].to_numpy()
        adjacent = pruned(x)
        return pd.DataFrame({"id": ids, "near": [ids[a[a >= 0]].tolist() for a in adjacent]})

    local = nodes.groupBy("shard", "part").applyInPandas(build, "id long, near array<long>")
    # the union of the lists of all shards that hold a vector
    union = materialize(local.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "embedding-graph")
    # a task of a split shard holds one part's nodes and one part's vectors as guests
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = (F.col("home") | (F.col("parts") > 1)) & (F.col("guest") == F.col("part"))
    members = nodes.join(union, "id").withColumn("guest", every).select("shard", "parts", "part", "guest", "id", "v", "near", F.lit(True).alias("node"), asked.alias("query"))
    guests = nodes.where("parts > 1").join(union, "id").withColumnRenamed("part", "guest").withColumn("part", every).where("part <> guest").select("shard", "parts", "part", "guest", "id", "v", "near", F.lit(False).alias("node"), F.lit(True).alias("query"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["v"].tolist())
        ids = pdf["id"].to_numpy()
        node = pdf["node"].to_numpy()
        place = {int(i): k for k, i in enumerate(ids)}
        links: list[list[int]] = [[place[i] for i in near if i in place] for near in pdf["near"]]
        for a, near in enumerate([list(n) for n in links]):  # edges both ways, so that nothing is out of reach
            for b in near:
                links[b].append(a)
        lists = [np.array(sorted(set(n)), np.int64) for n in links]
        inner = np.flatnonzero(node) if node.any() else np.arange(len(ids))
        medoid = int(inner[(x[inner] @ x[inner].mean(0)).argmax()])
        queries = np.flatnonzero(pdf["query"].to_numpy())
        found = expand(x, lists, queries, medoid, limit)
        a = np.repeat(ids[queries], [len(f) for f in found])
        b = ids[np.concatenate(found)] if len(found) else np.zeros(0, np.int64)
        # neighbours that no edge leads to; in a whole shard also pairs of vectors that are at home elsewhere
        whole = pdf["parts"].iloc[0] == 1
        p, q = close(x, np.arange(len(ids)) if whole else queries, inner, limit)
        return linked(np.append(a, ids[p]), np.append(b, ids[q]))

    graph = union.join(dealt.groupBy("id").agg(F.sort_array(F.collect_list("shard")).alias("shards")), "id")
    return members.unionByName(guests).groupBy("shard", "part", "guest").applyInPandas(search, "a long, b long").distinct(), materialize(graph, "embedding-merged")


def expanded(vectors: DataFrame, graph: DataFrame, links: DataFrame, limit: float) -> DataFrame:
    """links and what the range expansion over the merged graph adds to them, round by round until nothing is new.

    A link (q, b) leads from q to all of b's united list. Pairs that share a shard are known, so a round follows only
    links whose ends lie in different shards, to vectors that share none with q.
    """
    front = links
    places = graph.select("id", "shards")
    while not front.isEmpty():
        ends = front.select(F.col("a").alias("q"), F.col("b").alias("id")).unionByName(front.select(F.col("b").alias("q"), F.col("a").alias("id")))
        hops = ends.join(places.toDF("q", "own"), "q").join(graph, "id").where("own <> shards").select("q", "own", F.explode("near").alias("id"))
        there = hops.join(places, "id").where((F.col("q") != F.col("id")) & ~F.arrays_overlap("own", "shards"))
        pairs = there.select(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
        front = materialize(verified(vectors, pairs, limit), "embedding-expanded")
        links = links.unionByName(front)
    return links


def exact_links(vectors: DataFrame, c: np.ndarray, limit: float) -> DataFrame:
    """(a, b) ids of all vectors with cosine >= limit, a < b, whatever the centroids.

    A vector is a node of its nearest shard and a guest of every other one whose widest angle from the centroid, plus
    the range's angle, it is within: by the triangle inequality no other shard holds a neighbour. Nodes and guests meet
    in parts of MOST_SHARD, so a task is bounded; the work grows with the square of the vectors if no shard is ruled out.
    """
    homes = materialize(shards_of(vectors, c, 1).select("shard", "id", "v"), "embedding-homes")

    def angles(v: list) -> np.ndarray:
        return np.arccos(np.clip(unit(v) @ c.T, -1, 1))

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                home = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(angles(part.column(1).to_pylist())[np.arange(len(home)), home])], ["shard", "angle"])

    sizes = homes.select("shard", "v").mapInArrow(widths, "shard int, angle double").groupBy("shard").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()  # a row for each centroid
    reach, parts = np.full(len(c), -1.0), np.ones(len(c), np.int64)
    for r in sizes:
        reach[r["shard"]], parts[r["shard"]] = r["angle"] + np.arccos(limit) + 1e-6, -(-r["n"] // MOST_SHARD)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                home = part.column(0).to_numpy()
                # a pair of two shards needs one meeting: the guest is of the higher shard, or of the same
                row, shard = np.nonzero((angles(part.column(2).to_pylist()) <= reach) & (np.arange(len(c))[None] <= home[:, None]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), part.column(1).take(take), part.column(2).take(take)], ["shard", "id", "v"])

    guests = materialize(homes.mapInArrow(visits, f"shard int, id long, v {kind(vectors)}"), "embedding-guests")
    counts = guests.groupBy("shard").agg(F.count("*").alias("m"))
    table = vectors.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "shard int, parts int")
    grid = F.broadcast(table.join(counts, "shard").select("shard", "parts", F.ceil(F.col("m") / MOST_SHARD).cast("int").alias("rooms")))
    spot = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = homes.join(grid, "shard").withColumn("part", spot("parts", 2)).withColumn("room", every("rooms")).select("shard", "part", "room", "id", "v", F.lit(True).alias("node"))
    right = guests.join(grid, "shard").withColumn("room", spot("rooms", 3)).withColumn("part", every("parts")).select("shard", "part", "room", "id", "v", F.lit(False).alias("node"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, node = unit(pdf["v"].tolist()), pdf["id"].to_numpy(), pdf["node"].to_numpy()
        p, q = close(x, np.flatnonzero(~node), np.flatnonzero(node), limit)
        return linked(ids[p], ids[q])

    return left.unionByName(right).groupBy("shard", "part", "room").applyInPandas(search, "a long, b long").distinct()


def verified(vectors: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """The pairs whose cosine in double precision is at least the limit."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m.cast("double") * n.cast("double")), F.lit(0.0), lambda s, t: s + t)
    v = vectors.select("id", "v")
    both = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b")
    return both.where(dot("va", "vb") >= limit * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))).select("a", "b")


def audit(vectors: DataFrame, links: DataFrame, limit: float, queries: int = AUDIT) -> float:
    """Share of the true links of a sample of vectors, found by brute force over all rows in blocks, that links holds."""
    n = vectors.count()
    sample = vectors.where((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)) < queries / max(n, 1)).select("id", "v").limit(4 * queries).collect()
    if not sample:
        return 1.0
    ids, q = np.array([r["id"] for r in sample]), unit([r["v"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for i in range(0, len(own), 4096):
                at, of = np.nonzero(unit(batch.column(1).slice(i, 4096).to_pylist()) @ q.T >= limit)
                a, b = own[i : i + 4096][at], ids[of]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])

    true = vectors.select("id", "v").mapInArrow(run, "a long, b long").distinct()
    row = true.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = RANGE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall): one row per row of rows; recall is the audit's figure, the same in all.

    A column of floats is held as floats, any other as doubles; cosines are in double precision. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are their own
    component. So do vectors whose length differs from the commonest one's. Rows of one vector link with each other.
    A row with a null id is left out of other rows' component ids. An empty table gives an empty table. Only the two
    named columns are read, so other columns cannot clash.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    v = own if kind(own) == "array<float>" else own.withColumn("v", F.col("v").cast("array<double>"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(good, F.lit(False)))
    sizes = v.where("ok").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    v = v.withColumn("ok", F.col("ok") & (F.size("v") == dim)).withColumn("key", F.when(F.col("ok"), F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary"))))
    # a vector's id is its least row id; rows of null ids take a number of their own below all others
    alone = F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63)))
    vectors = materialize(v.where("ok").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")).select("key", "least", "copies", "v", F.coalesce("least", alone).alias("id")), "embedding-vectors")
    n = vectors.count()
    k = max(1, min(MOST_CENTROIDS, -(-n * OVERLAP // SHARD)))
    if n:
        rate = SAMPLE / n
        sample = vectors.where((F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)) < rate).select("v").limit(2 * SAMPLE).collect()
        x = unit([r["v"] for r in sample]) if sample else unit([vectors.first()["v"]])
        c = centroids_of(x, min(k, len(x)))
    overlap, links, found = OVERLAP, None, 1.0
    while n:
        near, graph = graph_links(vectors, c, overlap, limit)
        links = expanded(vectors, graph, materialize(verified(vectors, near, limit), "embedding-links"), limit)
        found = audit(vectors, links, limit)
        if found >= recall:
            break
        overlap *= 2
        if overlap >= len(c):  # so much overlap would send every vector to every shard
            links = materialize(verified(vectors, exact_links(vectors, c, limit), limit), "embedding-links")
            found = audit(vectors, links, limit)
            break
    if links is not None and found < recall:
        raise RuntimeError(f"recall {found:.4f} of the links, less than {recall}")
    own = v.select("vec_id", "key")
    if links is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(found).alias("recall"))
    copies = vectors.select("id", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "embedding")
    named = vectors.select("key", "id", "least", "copies").join(degree, "id", "left").join(parts, "id", "left").withColumn("root", F.coalesce("component", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "root").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = own.join(facts, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(found))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `embeddings`; nulls, empty and very long vectors, ties, repeats, empty tables and other columns as in near_duplicates."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).drop("recall")


QUERIES = {"op1_embedding_neardup": op1_embedding_neardup}
ORACLE = {
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id""",
}
