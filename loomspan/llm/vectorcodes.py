"""Product codes of vectors: a codebook for each part of the components, fitted by Lloyd's rounds on whole numbers.

Assignment is by Exponion search. A part starts at its entry of the round before, at squared distance d. An entry that is
as near or nearer lies, by the triangle inequality, within sqrt(d) + sqrt(d) of that entry, so its list of the other entries
sorted by distance is scanned only inside this radius, which shrinks to sqrt(d) + sqrt(best) as better entries are met. All
distances are whole numbers; the radius is compared without roots, so no tie is lost and the least index wins.

Rows stay where they are read: codebooks go out with the tasks, sums of parts by entry come back through a small
aggregation. Each round finds the entries of the rounds before again, from the first codebooks on, which is one scan each
and cheap next to writing all rows between rounds; so R rounds read the rows R + 1 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import keyed, materialize, read

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bound of a whole component: squared distances of a vector of up to 64 components stay below 2^62.
MOST = 1 << 27
#: Vectors that are searched together.
HELD = 4096


class Book:
    """Codebooks of all parts as one list of entries: entry e of part p is row p * k + e."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.k, self.m = entries.shape
        self.flat = entries.reshape(-1, self.m)
        gaps = np.array([((c[:, None] - c[None, :]) ** 2).sum(2) for c in entries]).reshape(-1, self.k)
        #: the other entries of each entry's part by distance, itself first
        gaps[np.arange(len(gaps)), np.arange(len(gaps)) % self.k] = -1
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.maximum(np.take_along_axis(gaps, self.order, 1), 0)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part (n, parts, m), searched from the entries `start` (n, parts)."""
        shape, x = start.shape, x.reshape(-1, self.m)
        first = np.broadcast_to(np.arange(self.parts) * self.k, shape).reshape(-1)
        at = first + start.reshape(-1)
        best = start.reshape(-1).copy()
        d0 = ((x - self.flat[at]) ** 2).sum(1)
        least = d0.copy()
        live = np.arange(len(x))
        for step in range(1, self.k):
            # gap <= (sqrt(d0) + sqrt(least))^2, in whole numbers: the excess squared against 4 * d0 * least
            excess = self.gaps[at[live], step] - d0[live] - least[live]
            live = live[(excess <= 0) | inside(excess, d0[live], least[live])]
            if not len(live):
                break
            entry = self.order[at[live], step]
            d = ((x[live] - self.flat[first[live] + entry]) ** 2).sum(1)
            better = (d < least[live]) | ((d == least[live]) & (entry < best[live]))
            best[live[better]], least[live[better]] = entry[better], d[better]
        return best.reshape(shape), least.reshape(shape)


def inside(excess: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """excess^2 <= 4ab for whole numbers; in doubles with a margin towards yes, since a wider radius loses nothing."""
    return excess.astype(np.float64) ** 2 <= 4.0 * a * b.astype(np.float64) * (1 + 1e-9) + 1


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The column v of a batch as a matrix of whole numbers."""
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def pieces(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple]:
    """(batch, parts, entries, squared distances) by the last of the books, each searched from the entries of the one before."""
    chain = [Book(b) for b in books]
    for batch in batches:
        for i in range(0, batch.num_rows, HELD):
            cut = batch.slice(i, HELD)
            x = whole(cut).reshape(cut.num_rows, chain[0].parts, -1)
            entry = np.zeros(x.shape[:2], np.int64)
            for book in chain:
                entry, d = book.nearest(x, entry)
            yield cut, x, entry, d


def sums(rows: DataFrame, books: list[np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sum) of the parts of each entry; a task gives one row for each entry it met."""
    parts, k, m = books[-1].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, m), np.int64)
        for _, x, entry, _ in pieces(batches, books):
            at = (entry + np.arange(parts) * k).reshape(-1)
            np.add.at(n, at, 1)
            np.add.at(total, at, x.reshape(-1, m))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["entry", "n", "total"])

    met = rows.select("v").mapInArrow(add, "entry long, n long, total array<long>")
    out = met.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(j))) for j in range(m))).alias("total"))
    # bounded by the codebooks: parts x entries rows
    return {r["entry"]: (r["n"], r["total"]) for r in out.collect()}


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, v) with whole components floor(scale * x); rows with a null or non-finite component or a null vector are left out."""
    x = F.col(vec_col).cast("array<double>")
    # NaN and infinities differ from themselves less themselves
    clean = F.col(vec_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ((c - c) == 0)), F.lit(False))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(clean).select(F.col(id_col).alias("id"), label.alias("label"), x.alias("x")).select("id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks before and after each round, as arrays (parts, entries, components of a part).

    They start as the parts of the least ids (nulls last, ties by components) and get the floored mean of their parts;
    an entry that no part takes stays. Vectors that are fewer than the entries give so many entries. Raises if vectors are
    not all of one length that the parts divide, if a component is MOST or more, or if an entry's number would need more
    than two digits. No rows give no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        return []
    n = len(start[0]["v"])
    odd = rows.where((F.size("v") != n) | F.exists("v", lambda c: F.abs(c) >= MOST)).select(F.size("v")).first()
    if odd is not None or n % parts or not n:
        raise ValueError(f"vectors need one length that {parts} divides, and whole components below {MOST}")
    books = [np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()]
    for _ in range(rounds):
        book = books[-1].copy()
        for at, (count, total) in sums(rows, books).items():
            book[divmod(at, book.shape[1])] = [t // count for t in total]
        books.append(book)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error): entries in part order, two hexadecimal digits each, and the squared distance of the whole vector."""
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, _, entry, d in pieces(batches, books):
            codes = pa.array([bytes(r).hex() for r in entry.astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), codes, pa.array(d.sum(1))], ["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind[0]}, label {kind[1]}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(id, v): the entries that a code names, in the scale of the vectors (the middle of a floor's range)."""
    book = books[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([list(bytes.fromhex(c)) for c in b.column(1).to_pylist()], np.int64).reshape(-1, book.shape[0])
            v = (book[np.arange(book.shape[0]), at].reshape(len(at), -1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    return codes.select("id", "code").mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, v array<double>")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `embeddings` whose vector is whole and finite, in 16 parts with 64 entries each after two rounds.

    Rows that repeat are coded each; nulls, ties, lengths, few rows and empty tables as in quantized and fit. Errors are
    summed by label before rows are joined to them, and hot labels are broadcast, so no task holds a label's rows.
    """
    rows = quantized(read(spark, sf_dir, "embeddings"))
    books = fit(rows)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books[-1].reshape(-1).tolist())).encode()).hexdigest()
    # a null label reads as a key of its own
    of = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = materialize(encode(rows, books).select(F.col("id").alias("vec_id"), of.alias("of"), "code", "error"), "codes")
    labels = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return keyed(coded, labels, "of").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


NEAR = "SELECT rid, part, e, dist FROM (SELECT x.rid, x.part, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN {c} c ON c.part = x.part) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY dist, e) = 1"
MEANS = "SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (SELECT a.part, a.e, j, sum(x.v[j])::BIGINT AS s, count(*)::BIGINT AS n FROM {a} a JOIN x ON x.rid = a.rid AND x.part = a.part, unnest(range(1, len(x.v) + 1)) r(j) GROUP BY ALL) GROUP BY ALL) m ON m.part = c.part AND m.e = c.e"
QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {
    "op12_vector_codes": f"""
WITH r AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM r),
x AS (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM k, range(16) p(part)),
c0 AS (SELECT part, rid AS e, v FROM x WHERE rid < 64),
a0 AS ({NEAR.format(c="c0")}), c1 AS ({MEANS.format(c="c0", a="a0")}),
a1 AS ({NEAR.format(c="c1")}), c2 AS ({MEANS.format(c="c1", a="a1")}),
a2 AS ({NEAR.format(c="c2")}),
o AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o ON o.rid = k.rid, h""",
}
