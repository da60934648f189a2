"""Substring dedup by seed and extend over word sequences.

Seeds are winnowed 8-word anchors; documents are joined on seeds that occur twice. A seed match can reach a window of 20
words by any split of the 12 further words to its left and right. The splits that have the seed as their
canonical anchor form a stretch. Equal stretches match as wholes; unequal ones of a seed are extended to every split both
ways. Both are compared by 128-bit keys of the extended words with the earliest place of that key. Windows that match an
earlier place are merged into maximal runs, and their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.anchors import anchored, canonical, mixed, outcomes, powers
from loomspan.llm.common import materialize, read, slices, utf8

SEED = 8
WINDOW = 20
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def word_values(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def as_words(text: bytes) -> tuple[np.ndarray, int, str]:
    words = text.split()
    return word_values(words), len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def stretch_keys(values: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], with extra mixed in."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(len(values) + 1, which, True)[starts] ^ mixed(extra.astype(np.uint64)))


def stretches(text: bytes, places: list[int], seed: int, window: int) -> list[np.ndarray]:
    """(anchor hash, key, second key, first start, windows) of the stretch of windows of each anchor at one of the places."""
    words = text.split()
    values = word_values(words)
    at, first, hashes = canonical(values, seed, window)
    ends = np.append(first[1:], max(0, len(values) - window + 1))
    keep = np.isin(at, np.array(places))
    at, first, ends, hashes = at[keep], first[keep], ends[keep], hashes[keep]
    shape = (at - first) << 32 | (ends - first)
    keys = [stretch_keys(v, k, first, ends + window - 1, shape) for k, v in ((0, values), (1, word_values(words, 1)))]
    return [hashes, *keys, first, ends - first]


def window_keys(text: bytes, runs: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, key, second key) of the windows of runs (first start, windows)."""
    words = text.split()
    starts = np.concatenate([np.arange(r["s"], r["s"] + r["n"]) for r in runs])
    return starts, *(stretch_keys(word_values(words, k), k, starts, starts + window, np.zeros(len(starts), np.int64)) for k in (0, 1))


def removed(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Mask of the items under the runs of these starts and sizes."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + sizes, -1)
    return np.cumsum(edges)[:n] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, window: int = WINDOW, output: str = "digest") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept, the words joined by blanks, if output is "values").

    Order is by id, null ids last; different texts of one id go by their digest. Of equal texts the one with the
    least id is the original, and rows that repeat it share its result; the others lose all words if they have a
    window at all. A null text has no words. Texts of any length are read whole. An empty table gives an empty table. Only
    the two named columns are read, so other columns cannot clash.
    """
    facts, held = anchored(docs, id_col, text_col, as_words, seed, window, "substring")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = [stretches(t, p, seed, window) for t, p in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            h, a, b, s, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (h, a, b)), pc.fill_null(batch.column(1), LAST).take(of), batch.column(0).take(of), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "a", "b", "id", "digest", "s", "n"])

    found = materialize(held.mapInArrow(extend, "h long, a long, b long, id long, digest binary, s int, n int"), "substring-seeds", free=True)
    place = F.struct("id", "digest", "s")
    # equal stretches: all windows of the later ones start earlier, in the first
    first = materialize(found.groupBy("h", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("n").alias("n")), "substring-first", free=True)
    again = found.join(first.where("times > 1").select("a", "b", "first"), ["a", "b"]).where(place != F.col("first")).select("digest", "s", "n")
    # different stretches of one seed are extended to all windows both ways
    several = materialize(first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "substring-several")
    runs = first.join(several, "h").select("first.digest", "first.id", F.struct(F.col("first.s").alias("s"), "n").alias("run")).groupBy("digest", "id").agg(F.collect_list("run").alias("runs"))
    reach = held.select("digest", "text").join(runs.hint("shuffle_hash"), "digest")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = [window_keys(t, r, window) for t, r in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), strict=True)]
            starts, a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
            of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(2).take(of), batch.column(0).take(of), pa.array(starts.astype(np.int32))], ["a", "b", "id", "digest", "s"])

    each = materialize(reach.mapInArrow(windows, "a long, b long, id long, digest binary, s int"), "substring-windows", free=True)
    earliest = materialize(each.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "substring-earliest", free=True)
    late = each.join(earliest, ["a", "b"]).where(place != F.col("first")).select("digest", "s", F.lit(1).alias("n"))
    later = again.unionByName(late).groupBy("digest").agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    cut = held.select("digest", "text").join(later.hint("shuffle_hash"), "digest")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            gone, kept = [], []
            for t, s in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = t.split()
                mask = removed(np.array([x["s"] for x in s], np.int64), np.array([x["n"] for x in s], np.int64) + window - 1, len(words))
                gone.append(int(mask.sum()))
                kept.append(b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() if output == "values" else None for k in kept], pa.string())], ["digest", "gone", "cut_sha", "cut_text"])

    cuts = cut.mapInArrow(apply, "digest binary, gone long, cut_sha string, cut_text string")
    rows = outcomes(docs, id_col, text_col, facts.join(cuts, "digest", "left"))
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("items") >= window)
    out = rows.select(
        "doc_id",
        F.col("items").alias("n_words"),
        F.when(copy, F.col("items")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, EMPTY).otherwise(F.coalesce("cut_sha", "whole")).alias("kept_sha256"),
        "digest", copy.alias("copy"), "cut_text", F.col("gone").isNotNull().alias("was_cut"),
    )
    if output != "values":
        return out.drop("digest", "copy", "cut_text", "was_cut")
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("digest"), F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")).alias("all")).dropDuplicates(["digest"])
    kept = F.when(F.col("copy"), "").otherwise(F.when(F.col("was_cut"), F.col("cut_text")).otherwise(F.col("all")))
    return out.join(texts, "digest").select("doc_id", "n_words", "n_removed", "kept_sha256", kept.alias("kept"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in dedup."""
    return dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE = {
    "op8_substring_dedup": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM t, unnest(range(1, len(w) - 18)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, unnest(range(0, 20)) AS u(o)),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END AS kept
      FROM t LEFT JOIN x ON x.doc_id = t.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
}
