"""Suffix-array dedup by external induced sorting.

Windows of 200 bytes whose canonical anchor occurs twice are dealt into shards by anchor, so equal windows meet in one
shard. A shard's text is written to disk and its suffixes are sorted by recursive induction (see induced.py): priority
queues that go to disk beyond a bound carry the suffixes with the length of the prefix that each shares with the one before
it. Neighbours in the order that share 200 bytes are repeats; no bytes are compared again and none are hashed for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.anchors import anchored, canonical, outcomes
from loomspan.llm.common import materialize, read, slices, utf8
from loomspan.llm.induced import MEMORY, Spool, shared_prefixes
from loomspan.llm.substring import EMPTY

GRAM = 64
LENGTH = 200
#: Bytes of text that are sorted at once; a larger group of one anchor is sorted whole, through the disk.
SHARD = 1 << 20
#: Different snippets that one anchor may have in a shard. The windows of a commoner one are dealt by their own bytes instead.
CROWD = 8000
#: Bytes are 2 to 257 in a shard's text, 1 ends a piece, 0 ends the text.
SYMBOLS = 258


class Shard:
    """Pieces whose text is on disk; repeats() gives the windows that start elsewhere in it too."""

    def __init__(self, length: int = LENGTH, memory: int = MEMORY):
        self.text, self.ends, self.rows = Spool(np.uint16), [0], []
        self.length, self.memory = length, memory

    def add(self, piece: bytes, row: tuple = ()) -> None:
        symbols = np.full(len(piece) + 1, 1, np.uint16)
        symbols[:-1] = np.frombuffer(piece, np.uint8).astype(np.uint16) + 2
        self.text.append(symbols)
        self.ends.append(self.text.n)
        self.rows.append(row)

    def repeats(self) -> Iterator[np.ndarray]:
        """For each piece, the starts of its windows that start elsewhere in some piece too, in order."""
        n, ends = self.text.n, np.array(self.ends)
        self.text.append(np.zeros(1, np.uint16))
        hit = Spool(np.bool_)
        for begin in range(0, n + 1, MEMORY):
            hit.append(np.zeros(min(MEMORY, n + 1 - begin), np.bool_))
        marks, last = hit.array("r+"), None
        for pos, common in shared_prefixes(self.text.array(), SYMBOLS, self.length, self.memory):
            # what shares a whole window with one that ends inside its piece ends inside its own
            fits = pos + self.length < ends[np.minimum(np.searchsorted(ends, pos, "right"), len(ends) - 1)]
            same = fits & (common >= self.length)
            before = np.append(pos[:1] if last is None else last, pos[:-1])
            marks[pos[same]] = True
            marks[before[same]] = True
            last = pos[-1:]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield np.flatnonzero(marks[a:b])


def repeats(pieces: list[bytes], length: int = LENGTH, memory: int = MEMORY) -> list[np.ndarray]:
    """Shard.repeats of a list of pieces."""
    shard = Shard(length, memory)
    for p in pieces:
        shard.add(p)
    return list(shard.repeats())


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the union of spans, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > ends[:-1])[: len(starts)]
    return starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)]


def as_bytes(text: bytes) -> tuple[np.ndarray, int, str]:
    return np.frombuffer(text, np.uint8), len(text), hashlib.sha256(text).hexdigest()


def snippets(text: bytes, places: list[int], gram: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(first start, anchor's place in the snippet, bytes) for each repeated anchor: all windows whose anchor it is."""
    at, first, _ = canonical(as_bytes(text)[0], gram, length)
    ends = np.append(first[1:], max(0, len(text) - length + 1)) - 1  # last start
    known = np.isin(at, np.array(places))
    for p, a, b in zip(at[known].tolist(), first[known].tolist(), ends[known].tolist(), strict=True):
        yield a, p - a, text[a : b + length]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, output: str = "digest", crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, array of (start, end), if output is "values").

    Texts are UTF-8 bytes, a null text is empty. Equal texts of `length` bytes or more go wholly, whatever their ids;
    so do rows that repeat. Texts shorter than `length` stay. Texts of any length are read whole, hashed piece by piece.
    An empty table gives an empty table. Only the two named columns are read, so other columns cannot clash.
    memory: bytes of a queue that stay in memory; crowd: see CROWD.
    """
    facts, held = anchored(docs, id_col, text_col, as_bytes, gram, length, "suffix")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            rows = []
            for d, t, p in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                rows += [(hashlib.md5(b"%d " % o + s).digest(), hashlib.md5(s[o : o + gram]).digest(), d, a, s) for a, o, s in snippets(t, p, gram, length)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 5, (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["snippet", "anchor", "digest", "start", "bytes"])

    pieces = materialize(held.mapInArrow(cut, "snippet binary, anchor binary, digest binary, start int, bytes binary"), "suffix-snippets", free=True)
    crowded = materialize(pieces.groupBy("snippet").agg(F.first("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "suffix-crowded")
    contents = lambda p: p.groupBy("snippet").agg(F.first("anchor").alias("anchor"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    shards = contents(pieces.join(crowded, "anchor", "left_anti")).repartition("anchor").sortWithinPartitions("anchor").select("anchor", "snippet", "n", "bytes")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor: whole groups are gathered into a shard until it is large enough to be sorted."""
        shard, alone, anchor, many = Shard(length, memory), [], None, False
        first: tuple = ()

        def settled() -> None:
            # a group of one content that is found twice: nothing else can hold a part of it
            if anchor is not None and not many and first[1] > 1:
                alone.append((first[0], 0, len(first[2])))

        for batch in slices(batches, "bytes", 1 << 20):
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != anchor:
                    settled()
                    if shard.text.n >= SHARD:
                        yield spans_of(shard, alone)
                        shard, alone = Shard(length, memory), []
                    anchor, many, first = key, False, tuple(row)
                    continue
                if not many:
                    shard.add(first[2], (first[0], first[1], len(first[2])))
                    many = True
                shard.add(row[2], (row[0], row[1], len(row[2])))
        settled()
        yield spans_of(shard, alone)

    def spans_of(shard: Shard, alone: list[tuple]) -> pa.RecordBatch:
        out = list(alone)
        for (name, n, size), starts in zip(shard.rows, shard.repeats() if shard.rows else (), strict=True):
            if n > 1:
                out.append((name, 0, size))
            elif len(starts):
                out += zip([name] * len(starts), *(x.tolist() for x in merged(starts, starts + length)), strict=False)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["snippet", "s", "e"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            texts = batch.column(2).to_pylist()
            counts = [len(t) - length + 1 for t in texts]
            of = pa.array(np.repeat(np.arange(len(texts)), counts))
            starts = np.concatenate([np.arange(n) for n in counts]).astype(np.int32)
            keys = [hashlib.md5(t[s : s + length]).digest() for t, n in zip(texts, counts, strict=True) for s in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(starts), pa.array(keys, pa.binary())], ["snippet", "n", "s", "key"])

    # a window of a crowded anchor is a shard of its own: no task holds what one anchor gathers
    single = materialize(contents(pieces.join(crowded, "anchor", "left_semi")).select("snippet", "n", "bytes").mapInArrow(windows, "snippet binary, n long, s int, key binary"), "suffix-windows")
    twice = single.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1").select("key")
    alone = single.join(twice, "key").select("snippet", "s", (F.col("s") + length).alias("e"))
    repeated = shards.mapInArrow(sort, "snippet binary, s int, e int").unionByName(alone)
    spans = pieces.select("snippet", "digest", "start").join(repeated, "snippet").select("digest", F.struct((F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e")).alias("x")).groupBy("digest").agg(F.collect_list("x").alias("spans"))
    marked = held.select("digest", "text").join(spans.hint("shuffle_hash"), "digest")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for t, s in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                starts, ends = merged(*(s.values.field(k).to_numpy().astype(np.int64) for k in ("s", "e")))
                digest = hashlib.sha256()
                for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(t)], strict=True):
                    digest.update(t[a:b])
                runs = np.stack([starts, ends], 1).tolist() if output == "values" else None
                out.append((int((ends - starts).sum()), len(starts), digest.hexdigest(), runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True))], ["digest", "gone", "cut_spans", "cut_sha", "runs"])

    cuts = marked.mapInArrow(apply, "digest binary, gone long, cut_spans long, cut_sha string, runs array<array<long>>")
    rows = outcomes(docs, id_col, text_col, facts.join(cuts, "digest", "left"))
    copy = (F.col("copies") > 1) & (F.col("items") >= length)
    out = rows.select(
        "doc_id",
        F.col("items").alias("n_bytes"),
        F.when(copy, F.col("items")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, EMPTY).otherwise(F.coalesce("cut_sha", "whole")).alias("kept_sha256"),
        F.when(copy, F.array(F.array(F.lit(0), F.col("items")).cast("array<long>"))).otherwise(F.coalesce("runs", F.array().cast("array<array<long>>"))).alias("spans"),
    )
    return out if output == "values" else out.drop("spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in dedup."""
    return dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE: dict[str, str] = {}
