"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A profile lists the most frequent n-grams (1 to 3 characters of lower-cased words, a blank at each end) of a
language in order of count, ties by code. A document's own list is held against each profile: every n-gram costs
the difference of its two ranks, or the profile's length where the profile lacks it. The least sum wins, ties by
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import bucket, labelled, read, slices

TOP = 300
#: Bound of the sample that profiles are fitted on: documents a language, chosen by a hash of the id.
SAMPLE = 2000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}']+")


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the words of a text; each code holds up to three code points."""
    points = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    inner = points[1:-1] != 32  # no gram spans a blank inside
    return np.concatenate([points[points != 32], two[(points[:-1] != 32) | (points[1:] != 32)], three[inner]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The `top` most frequent codes, most frequent first, ties by code."""
    values, counts = counted(codes)
    if len(values) > top:  # what may be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))][:top]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles of the languages of labelled rows: counts over a bounded hash sample, `top` grams a language.

    Rows of null text, or whose label is null, teach nothing. Every other label is learned; the driver holds one number
    and one profile for each.
    """
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.map_from_arrays(F.lit(list(sizes)), F.lit([min(1.0, sample / n) for n in sizes.values()]))
    # a hash below the language's share of all hashes: about `sample` rows, whatever the table's size
    chosen = rows.where((F.pmod("h", F.lit(1 << 40)) / float(1 << 40)) < F.coalesce(share[F.col("l")], F.lit(0.0))).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2 << 20):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                values, counts = counted(np.concatenate([gram_codes(t) for x, t in zip(langs, texts, strict=True) if x == lang]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts.astype(np.int64))], ["l", "g", "n"])

    grams = chosen.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = grams.groupBy("l").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "g"))), 1, top)["g"].alias("g"))
    return {r["l"]: np.array(r["g"], np.int64) for r in best.collect() if r["g"]}


def predict(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """All columns of docs plus lang_pred and lang_score (columns of those names, in any case, are replaced).

    lang_pred is `und`, with score 0, where the text is null or has no letter, or no profile is known. The score is
    1 less the mean cost of a gram as a share of the worst cost. Languages that tie are taken by name. Texts of any
    length are read whole, rows that repeat get the same label, an empty table gives an empty table; all other columns
    are passed through, whatever their names.
    """
    names = sorted(known)
    table = sorted({int(g) for p in known.values() for g in p[:top]})
    keys = np.array(table, np.int64)
    ranks = np.full((len(names), len(keys) + 1), -1, np.int64)
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(keys, known[name][:top])] = np.arange(len(known[name][:top]))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not names or not LETTER.search(text):
            return UNKNOWN, 0.0
        own = ranked(gram_codes(text), top)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(keys, own)
        at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] != own)] = len(keys)
        there = ranks[:, at]
        cost = np.where(there < 0, top, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(np.argmin(cost))
        return names[best], float(1 - cost[best] / (top * len(own)))

    def run(texts: pa.Array) -> list[pa.Array]:
        out = [one(t) for t in texts.to_pylist()]
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]

    return labelled(docs, text_col, [("lang_pred", T.StringType()), ("lang_score", T.DoubleType())], run)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows of docs that are not held out and labels them all: docs plus held_out, lang_pred, lang_score."""
    held = docs.withColumn("held_out", bucket(id_col, 4) == 2)
    return predict(held, profiles(held.where("not held_out"), id_col, text_col, lang_col), id_col, text_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in profiles and predict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = profiles(docs.where(bucket("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", "text", (bucket("doc_id", 4) == 2).alias("held_out")), known)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
