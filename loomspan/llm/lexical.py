"""Ranked lexical search over a tiered index.

The index has one row for each document and holds, for the terms that are asked, its postings in three tiers as columns:
the high-impact postings of each term, those of middle impact, and the rest. A term's tiers are cut by a histogram of its
impacts over all documents, so a rare term lies in the first tier whole and a common one shows there only its best. For each
term and tier the residual bound is kept: the highest impact that was left to lower tiers.

A search reads the first tier's columns only. A document's score is at least what its postings in there add up to, and at most
that plus the residual bounds of the item's terms that were not met. An item is proven if every document whose upper bound
reaches the k-th lower bound was kept as a finalist; finalists are scored exactly from all tiers. Items without proof (too
many finalists, or documents not met at all that might still win) fall through to two tiers, then to all three, where
every score is exact. Rows never move: each task scores its documents for all items and sends k rows an item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.common import discard, materialize, read, slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BEST = 20
#: Postings of a term in its first tier, and in its first two, about (a whole class of the histogram more, at most).
TIERS = (256, 8192)
#: Classes of the impact histogram of a term; impacts are below a million.
CLASSES = 128
#: Finalists of an item that a task sends, and that are scored exactly; an item with more falls through to the next tier.
FINALISTS = 256
#: Term occurrences of the items that are searched together (one item at least): bounds what goes out with the tasks.
LOAD = 1 << 15
#: Items and documents of one score matrix, and postings of items that are added to it at once.
WIDE, TALL, HELD = 256, 1024, 1 << 20
POSTINGS = "row long, doc_id {id}, n long, tids array<int>, tfs array<long>"
INDEX = "row long, doc_id {id}, " + ", ".join(f"tids{t} array<int>, imps{t} array<long>" for t in range(len(TIERS) + 1))


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def impact(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """The list column of n rows with these values, which come by row."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def postings(docs: DataFrame, asked: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, tids, tfs): every document with a term, its length, and how often each asked term occurs in it.

    Whole texts, null ones have no term. Written to the shared folder, so row is a lasting number of the document.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids, ns, tids, tfs, at = [], [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                found = terms(text)
                if not found:
                    continue
                for t, tf in Counter(found).items():
                    if (tid := asked.get(t)) is not None:
                        tids.append(tid)
                        tfs.append(tf)
                        at.append(len(ids))
                ids.append(i)
                ns.append(len(found))
            where = np.array(at, np.int64)
            kept = b.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(ns, pa.int64()), lists(np.array(tids, np.int32), where, len(ids)), lists(np.array(tfs, np.int64), where, len(ids))], ["row", "doc_id", "n", "tids", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(count, POSTINGS.format(id=kind)), "postings")


@dataclass
class Index:
    """rows: the tiers (INDEX); cuts[t, term]: least impact of the term's postings in tiers up to t; left[t, term]: its highest impact below them."""

    rows: DataFrame | None
    docs: int
    length: int
    df: np.ndarray
    left: np.ndarray


def build(docs: DataFrame, asked: dict[str, int], id_col: str = "doc_id", text_col: str = "text", tiers: tuple = TIERS) -> Index | None:
    """The tiered index of all documents for the asked terms (numbered from 0); None if no document has a term."""
    held = postings(docs, asked, id_col, text_col)
    size = held.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    if not size["docs"]:
        return None
    n, total = size["docs"], size["length"]
    wide = 1_000_000 // CLASSES + 1

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, most = np.zeros(len(asked) * CLASSES, np.int64), np.zeros(len(asked) * CLASSES, np.int64)
        low = np.full(len(asked) * CLASSES, 1 << 60)
        for b in batches:
            tids, at = flat(b.column(1))
            imp = impact(flat(b.column(2))[0], b.column(0).to_numpy()[at], n, total)
            cell = tids.astype(np.int64) * CLASSES + imp // wide
            count += np.bincount(cell, minlength=len(count))
            np.maximum.at(most, cell, imp)
            np.minimum.at(low, cell, imp)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(x[met]) for x in (count, most, low))], ["cell", "k", "most", "low"])

    # one row for each class of an asked term that a task met: bounded by the load
    found = held.select("n", "tids", "tfs").mapInArrow(classes, "cell long, k long, most long, low long")
    cells = found.groupBy("cell").agg(F.sum("k").alias("k"), F.max("most").alias("most"), F.min("low").alias("low"))
    above = F.coalesce(F.sum("k").over(W.partitionBy("tid").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cells.withColumn("tid", F.floor(F.col("cell") / CLASSES)).withColumn("above", above)
    cut = [F.min(F.when(F.col("above") < t, F.col("low"))).alias(f"cut{i}") for i, t in enumerate(tiers)]
    rest = [F.coalesce(F.max(F.when(F.col("above") >= t, F.col("most"))), F.lit(0)).alias(f"left{i}") for i, t in enumerate(tiers)]
    df, cuts, left = np.zeros(len(asked), np.int64), np.zeros((len(tiers), len(asked)), np.int64), np.zeros((len(tiers) + 1, len(asked)), np.int64)
    for r in ranked.groupBy("tid").agg(F.sum("k").alias("df"), *cut, *rest).collect():
        df[r["tid"]] = r["df"]
        for i in range(len(tiers)):
            cuts[i, r["tid"]], left[i, r["tid"]] = r[f"cut{i}"], r[f"left{i}"]

    def tiered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids, at = flat(b.column(3))
            imp = impact(flat(b.column(4))[0], b.column(2).to_numpy()[at], n, total)
            tier = (imp < cuts[:, tids]).sum(0)
            parts = [lists(x[tier == t], at[tier == t], b.num_rows) for t in range(len(tiers) + 1) for x in (tids, imp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], ["row", "doc_id", *(f"{c}{t}" for t in range(len(tiers) + 1) for c in ("tids", "imps"))])

    schema = INDEX.format(id=held.schema["doc_id"].dataType.simpleString())
    rows = materialize(held.where(F.size("tids") > 0).mapInArrow(tiered, schema), "tiers")
    discard(held)
    return Index(rows, n, total, df, left)


class Asked:
    """Items as a sparse matrix by term: for term t, items[first[t]:first[t+1]] ask for it, with weights alike."""

    def __init__(self, counts: list[Counter], asked: dict[str, int], index: Index):
        #: floor(1000 ln((2N + 2) / (2 df + 1))); a term that no document holds is left out
        self.weight = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * f + 1))) for f in index.df.tolist()], np.int64)
        rows = sorted((asked[t], i, k) for i, c in enumerate(counts) for t, k in c.items() if index.df[asked[t]])
        tid, self.items, reps = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(tid, np.arange(len(asked) + 1))
        self.weights = reps * self.weight[tid]
        self.n = len(counts)
        #: what the terms of an item may add below each tier
        self.rest = np.array([np.bincount(self.items, self.weights * left[tid], minlength=self.n) for left in index.left]).astype(np.int64)

    def only(self, open_: np.ndarray) -> None:
        """Leaves out all items but these; their numbers stay."""
        kept = np.isin(self.items, open_)
        tid = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[kept]
        self.items, self.weights = self.items[kept], self.weights[kept]
        self.first = np.searchsorted(tid, np.arange(len(self.first)))

    def scores(self, docs: int, tids: np.ndarray, at: np.ndarray, values: list[np.ndarray], lo: int, hi: int) -> list[np.ndarray]:
        """A matrix (documents, items lo to hi) for each of the values: weight times value, added up over the postings."""
        out = [np.zeros(docs * (hi - lo), np.int64) for _ in values]
        times = self.first[tids + 1] - self.first[tids]
        ends = np.cumsum(times)
        begin = 0
        while begin < len(tids):
            end = max(begin + 1, int(np.searchsorted(ends, HELD + (ends[begin - 1] if begin else 0), "right")))
            part = slice(begin, end)
            which = np.repeat(np.arange(begin, end), times[part])
            entry = np.arange(len(which)) - np.repeat(np.cumsum(times[part]) - times[part], times[part]) + self.first[tids[which]]
            item = self.items[entry]
            inside = (item >= lo) & (item < hi)
            which, entry, item = which[inside], entry[inside], item[inside]
            cell, w = at[which] * (hi - lo) + item - lo, self.weights[entry]
            for m, v in zip(out, values, strict=True):
                np.add.at(m, cell, w * v[which])
            begin = end
        return [m.reshape(docs, hi - lo) for m in out]


class Kept:
    """A task's candidates of each item: those whose upper bound reaches its k-th lower bound so far."""

    def __init__(self, items: int, k: int, exact: bool):
        self.k, self.exact = k, exact
        self.held: list[list[tuple]] = [[] for _ in range(items)]
        #: the highest upper bound of a document that was left out though it reached
        self.spilt = np.zeros(items, np.int64)
        #: the k-th lower bound when the candidates were last settled, 1 if there were fewer
        self.least = np.ones(items, np.int64)

    def add(self, item: int, low: np.ndarray, high: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.held[item].append((low, high, ids, rows))
        if sum(len(x[0]) for x in self.held[item]) > 4 * FINALISTS:
            self.settle(item)

    def settle(self, item: int) -> None:
        low, high, ids, rows = (np.concatenate(x) for x in zip(*self.held[item]))
        # best lower bounds first, equal ones by id (a null id, kept as the highest number, last) and row
        order = np.lexsort((rows, ids, -low))
        low, high, ids, rows = low[order], high[order], ids[order], rows[order]
        if len(low) >= self.k:
            self.least[item] = low[self.k - 1]
        if self.exact:
            low, high, ids, rows = low[: self.k], high[: self.k], ids[: self.k], rows[: self.k]
        elif len(low) > self.k:
            reach = high >= low[self.k - 1]
            reach[: self.k] = True
            low, high, ids, rows = low[reach], high[reach], ids[reach], rows[reach]
            if len(low) > FINALISTS:
                self.spilt[item] = max(self.spilt[item], high[FINALISTS:].max())
                low, high, ids, rows = low[:FINALISTS], high[:FINALISTS], ids[:FINALISTS], rows[:FINALISTS]
        self.held[item] = [(low, high, ids, rows)]


CANDIDATES = "item int, low long, high long, doc_id long, row long, null_id boolean"
NULL_ID = np.iinfo(np.int64).max


def scan(batches: Iterator[pa.RecordBatch], index: Index, asked: Asked, tier: int, k: int) -> Iterator[pa.RecordBatch]:
    """CANDIDATES of one task's rows of the index (row, doc_id, the columns of tiers up to this one)."""
    left = index.left[tier]
    kept = Kept(asked.n, k, tier == len(index.left) - 1)
    for whole in batches:
        for begin in range(0, whole.num_rows, TALL):
            b = whole.slice(begin, TALL)
            ids, rows = b.column(1).fill_null(NULL_ID).to_numpy(), b.column(0).to_numpy()
            parts = [(*flat(b.column(2 + 2 * t)), flat(b.column(3 + 2 * t))[0]) for t in range(tier + 1)]
            tids, at, imps = (np.concatenate([p[j] for p in parts]) for j in range(3))
            for lo in range(0, asked.n, WIDE):
                hi = min(lo + WIDE, asked.n)
                low, seen = asked.scores(b.num_rows, tids, at, [imps, left[tids]], lo, hi)
                high = low + asked.rest[tier, lo:hi] - seen
                floor = kept.least[lo:hi]
                if b.num_rows >= k:
                    floor = np.maximum(floor, np.partition(low, b.num_rows - k, axis=0)[b.num_rows - k])
                doc, item = np.nonzero((high >= floor) & (low > 0))
                order = np.argsort(item, kind="stable")
                doc, item = doc[order], item[order]
                ends = np.searchsorted(item, np.arange(hi - lo + 1))
                for i in np.unique(item):
                    d = doc[ends[i] : ends[i + 1]]
                    kept.add(lo + i, low[d, i], high[d, i], ids[d], rows[d])
    out: list = []
    for i in range(asked.n):
        if kept.held[i]:
            kept.settle(i)
            out.append((np.full(len(kept.held[i][0][0]), i), *kept.held[i][0]))
        if kept.spilt[i]:
            out.append((np.array([i]), np.array([0]), kept.spilt[i : i + 1], np.array([-1]), np.array([-1])))
    if out:
        item, low, high, ids, rows = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(low), pa.array(high), pa.array(ids), pa.array(rows), pa.array(ids == NULL_ID)], ["item", "low", "high", "doc_id", "row", "null_id"])


def candidates(index: Index, asked: Asked, tier: int, k: int, rows: DataFrame | None = None) -> DataFrame:
    """CANDIDATES of the items by the tiers up to this one; of each task a row without a document holds what it left out."""
    columns = [f"{c}{t}" for t in range(tier + 1) for c in ("tids", "imps")]
    bounds = Index(None, index.docs, index.length, index.df, index.left)
    picked = (index.rows if rows is None else rows).select("row", F.col("doc_id").cast("long").alias("doc_id"), *columns)
    return picked.mapInArrow(lambda batches: scan(batches, bounds, asked, tier, k), CANDIDATES)


def top(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of exact candidates; equal scores by id, nulls last, then by row."""
    w = W.partitionBy("item").orderBy(F.desc("low"), "doc_id", "row")
    out = found.where("row >= 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("item", "rank", F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"), F.col("low").alias("score"))


def proven(found: DataFrame, asked: Asked, tier: int, k: int) -> dict[int, int]:
    """{item: its k-th lower bound} of the items whose finalists must hold the k best; 1 where fewer were found and no posting is left."""
    w = W.partitionBy("item").orderBy(F.desc("low"))
    bound = found.where("row >= 0").withColumn("k", F.row_number().over(w)).where(F.col("k") == k).select("item", F.col("low").alias("bound"))
    each = found.join(F.broadcast(bound), "item", "left").withColumn("bound", F.coalesce("bound", F.lit(1))).groupBy("item").agg(
        F.first("bound").alias("bound"), F.sum(F.when((F.col("row") >= 0) & (F.col("high") >= F.col("bound")), 1).otherwise(0)).alias("n"), F.max(F.when(F.col("row") < 0, F.col("high"))).alias("spilt")
    )
    # one row for each item of the load
    return {r["item"]: r["bound"] for r in each.collect() if r["n"] <= FINALISTS and (r["spilt"] or 0) < r["bound"] and asked.rest[tier, r["item"]] < r["bound"]}


def search_load(docs: DataFrame, texts: list[str | None], k: int, id_col: str, text_col: str, tiers: tuple = TIERS) -> tuple[list[DataFrame], list[int]]:
    """Results of the items by number, and how many items each tier settled."""
    counts = [Counter(terms(t)) for t in texts]
    names = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    index = build(docs, names, id_col, text_col, tiers) if names else None
    if index is None:
        return [], []
    asked, out, settled = Asked(counts, names, index), [], []
    open_ = np.unique(asked.items)
    for tier in range(len(tiers)):
        found = materialize(candidates(index, asked, tier, k), "candidates")
        done = proven(found, asked, tier, k)
        settled.append(len(done))
        if done:
            bounds = docs.sparkSession.createDataFrame(list(done.items()), "item int, bound long")
            # FINALISTS rows an item at most
            final = materialize(found.join(F.broadcast(bounds), "item").where("row >= 0 AND high >= bound").select("item", "row"), "finalists")
            rows = index.rows.join(F.broadcast(final.select("row").distinct()), "row", "left_semi")
            exact = Asked(counts, names, index)
            exact.only(np.array(sorted(done)))
            # a document is a finalist of some items, and may be no worse for others: all are scored, the best stay
            out.append(materialize(top(candidates(index, exact, len(tiers), k, rows), k), "ranked"))
            discard(final)
        discard(found)
        open_ = np.setdiff1d(open_, np.array(list(done), np.int64))
        asked.only(open_)
        if not len(open_):
            break
    if len(open_):
        settled.append(len(open_))
        out.append(materialize(top(candidates(index, asked, len(tiers), k), k), "ranked"))
    discard(index.rows)
    return out, settled


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", load: int = LOAD) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k best documents with a score above 0, fewer if there are no more.

    Every document is indexed and every item searched; items go in loads of bounded size, each of which reads the documents
    once. The document id is a whole number. Null and empty texts have no term: such documents are never found, such
    items get no rows. Rows of docs or items that repeat count each; null ids come last among equal scores. Texts of any
    length are read whole. Empty tables give an empty result. Columns beyond those named are not read.
    """
    spark, out = docs.sparkSession, []
    kind = items.schema[item_col].dataType.simpleString()

    def settle(held: list[Row]) -> None:
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(held)], f"item int, item_id {kind}")
        for found in search_load(docs, [r[1] for r in held], k, id_col, text_col)[0]:
            out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))

    held, size = [], 0
    for r in items.select(item_col, item_text).toLocalIterator():
        held.append(r)
        size += len(terms(r[1])) + 1
        if size >= load:
            settle(held)
            held, size = [], 0
    if held:
        settle(held)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all `documents` for every row of `benchmark`; nulls, ties, repeats, empty tables and other columns as in search."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op13_tiered_search": op13_tiered_search}
ORACLE = {
    "op13_tiered_search": r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
z AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM w),
p AS (SELECT rid, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM w),
f AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term),
i AS (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT iid, item_id, i.term, count(*)::BIGINT * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM i JOIN df ON df.term = i.term, z GROUP BY iid, item_id, i.term, nn, df),
s AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))))::BIGINT AS score FROM q JOIN f ON f.term = q.term, z GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
}
