"""Connected components of edge lists: contracted in the tasks that hold them, then settled in one bounded task or by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, materialize

#: Edges that a task holds at once when it contracts them (16 bytes each).
HELD = 1 << 20
#: Contracted edges up to which one task settles the rest; more go through rounds of joins.
SMALL = 2_000_000


def stars(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id reachable) for all ids of the edges, by hash-min with pointer jumping on arrays."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return ids, ids[label]
        a, b, least = a[open_], b[open_], np.minimum(x, y)[open_]
        np.minimum.at(label, x[open_], least)
        np.minimum.at(label, y[open_], least)
        while (label[label] != label).any():
            label = label[label]


def contracted(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, HELD edges at a time; whole: all of them at once, roots included."""
    held: list = []
    n = 0

    def out() -> pa.RecordBatch:
        ids, roots = stars(*(np.concatenate(x) for x in zip(*held)))
        keep = slice(None) if whole else ids != roots
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(roots[keep])], ["src", "dst"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= HELD and not whole:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    edges: (src, dst) longs; direction, repeats and loops do not matter; rows with a null end are left out. Each task
    first reduces its edges to stars, which never are more than its ids. Up to `small` of these are settled by one
    task. More are settled by rounds of joins: each takes the least label over the neighbours, then jumps twice along
    labels, so the rounds grow with the logarithm of the longest chain; labels are written to the shared folder after
    each. No round groups rows by a vertex without partial aggregation, so a hub costs no more than its edges.
    """
    plain = edges.where("src <> dst").select("src", "dst").mapInArrow(contracted, "src long, dst long")
    each = materialize(plain, f"{tag}-edges")
    if each.count() <= small:
        done = each.coalesce(1).mapInArrow(lambda x: contracted(x, True), "src long, dst long")
        return materialize(done.toDF("id", "component"), f"{tag}-labels")
    each = each.distinct()
    both = materialize(each.unionByName(each.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{tag}-both")
    start = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("least"))
    labels = materialize(start.select("id", F.least("id", "least").alias("label"), F.lit(True).alias("moved")), f"{tag}-labels")
    for _ in range(most_rounds):
        if labels.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        near = both.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        old = labels.select("id", F.col("label").alias("old"))
        new = old.join(near, "id").select("id", "old", F.least("old", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = new.join(up, "label").select("id", "old", F.least("label", "up").alias("label"))
        jumped = jumped.join(up, "label").select("id", "old", F.least("label", "up").alias("label"))
        before, labels = labels, materialize(jumped.select("id", "label", (F.col("label") != F.col("old")).alias("moved")), f"{tag}-labels")
        discard(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
