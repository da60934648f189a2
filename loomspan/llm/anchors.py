"""Winnowed anchors that find repeated passages: shared by suffix-array and substring dedup.

Every window of LENGTH items (bytes or words) has one canonical anchor: of the GRAM-item grams inside it, the one with
the least hash, the last of equals. Equal windows have equal anchors at equal places, so a window can only be repeated if
its anchor's hash occurs twice. Canonical anchors never move back as the window moves on, so the windows of one anchor
are a run of starts.

Equal texts are collapsed first: what their copies repeat is known without a search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import materialize, slices, utf8

BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Items that are hashed at once.
PIECE = 1 << 17
#: A number for each byte; texts of bytes are hashed through it, piece by piece.
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int, which: int = 0, inverse: bool = False, known: dict = {}) -> np.ndarray:  # noqa: B006
    """base**i modulo 2**64, or the inverse's powers."""
    if len(known.get((which, inverse), ())) < n:
        base = pow(BASE[which], -1, 1 << 64) if inverse else BASE[which]
        steps = np.full(max(n, PIECE + 4096), base, np.uint64)
        steps[0] = 1
        known[which, inverse] = np.multiply.accumulate(steps)
    return known[which, inverse][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def gram_hashes(values: np.ndarray, gram: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `gram` values: a polynomial modulo 2**64 by prefix sums, mixed."""
    n = len(values)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n, which), out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * powers(n - gram + 1, which, True))


def least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the least of `width` hashes, the last of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes), dtype=np.int64)

    def merge(a, pa_, b, pb):
        right = b <= a
        return np.where(right, b, a), np.where(right, pb, pa_)

    best, size = hashes, 1
    while size * 2 <= width:
        best, place = merge(best[:-size], place[:-size], best[size:], place[size:])
        size *= 2
    if size < width:
        gap = width - size
        best, place = merge(best[:n], place[:n], best[gap : gap + n], place[gap : gap + n])
    return place


def canonical(values: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, first window starts, hashes) of the canonical anchors of one document, in order. values: bytes, or hashes of words."""
    out: list[tuple] = []
    for begin in range(0, max(0, len(values) - length + 1), PIECE):
        part = values[begin : begin + PIECE + length - 1]
        hashes = gram_hashes(TABLE[part] if part.dtype == np.uint8 else part, gram)
        place = least(hashes, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((place[first] + begin, first + begin, hashes[place[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, starts, hashes = (np.concatenate(x) for x in zip(*out))
    fresh = np.concatenate([[True], places[1:] != places[:-1]])
    return places[fresh], starts[fresh], hashes[fresh]


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest binary, first_id long, copies long, text): one row per different text; a null text is empty."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    return own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("text").alias("text"))


def anchored(docs: DataFrame, id_col: str, text_col: str, read: Callable[[bytes], tuple[np.ndarray, int, str]], gram: int, length: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Facts of each distinct text, and the texts that hold anchors seen elsewhere too.

    read: bytes -> (values to hash, count of items, sha256 of the text when nothing is removed).
    Returns (digest, first_id, copies, items, whole) and (digest, first_id, text, places): places of anchors that
    occur twice or more over all distinct texts. Counting is a partial aggregation and a join that can split hot
    anchors; no anchor's rows need to meet in one task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = [read(t) for t in utf8(batch.column(3))]
            found = [canonical(v, gram, length) for v, *_ in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([n for _, n, _ in rows], pa.int64()), pa.array([s for *_, s in rows], pa.string()), pa.array([h.view(np.int64) for *_, h in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for p, *_ in found], pa.list_(pa.int32()))],
                ["digest", "first_id", "copies", "items", "whole", "h", "p"],
            )

    texts = distinct_texts(docs, id_col, text_col)
    scanned = materialize(texts.mapInArrow(scan, "digest binary, first_id long, copies long, items long, whole string, h array<long>, p array<int>"), f"{tag}-scan", free=True)
    anchors = scanned.select("digest", F.explode(F.arrays_zip("h", "p")).alias("a")).select("digest", F.col("a.h").alias("h"), F.col("a.p").alias("p"))
    # written, so that the join below is of two plain tables: hot anchors can be split, and each step's files can go
    twice = materialize(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), f"{tag}-twice", free=True)
    places = materialize(anchors.join(twice, "h").groupBy("digest").agg(F.collect_list("p").alias("places")), f"{tag}-places", free=True)
    # the texts are already dealt by digest, so only the places move
    held = texts.join(places.hint("shuffle_hash"), "digest").select("digest", "first_id", "text", "places")
    return scanned.drop("h", "p"), materialize(held, f"{tag}-held", free=True)


def outcomes(docs: DataFrame, id_col: str, text_col: str, verdicts: DataFrame) -> DataFrame:
    """(doc_id, then the verdicts' columns): verdicts by digest joined to every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    return own.join(verdicts, "digest")
