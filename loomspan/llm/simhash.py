"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification.

A fingerprint's 64 bits are cut into segments; the vector of segment popcounts embeds it so that the Manhattan distance
of two vectors never exceeds the Hamming distance of the fingerprints. The vectors are laid in grids: the segments form
groups, and every grid keeps all groups but as many as bits may differ. Vectors within that Manhattan distance differ in
at most so many groups and so share a cell of some grid. Pairs of a cell pass the Manhattan bound first and the exact
Hamming distance second.

Grids come in three steps of fineness. The members of a cell of more than CELL fingerprints are not paired there but laid
in the next finer grids, all of them together: two that are within the distance share a cell at each step. In the last,
whose segments are single bits in groups of one, a cell has 2**distance members at most. So every pair is found by the
same bound and check, and no cell is paired that is larger than CELL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm.common import keyed, materialize, named, read, slices, utf8
from loomspan.llm.graph import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: (bits in a segment, groups of segments) of each step of the grids.
STEPS = ((2, 5), (2, 16), (1, 64))
#: Fingerprints of a cell that are paired; the members of a larger one go to the next step.
CELL = 48


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: majority bits over XXH64 of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.concatenate([bits[i : i + 255].sum(0, dtype=np.uint8)[None] for i in range(0, n, 255)]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp long): one row per row of docs; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(text_col).alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp, bits: int = 2):
    """Thermometer code of the popcounts of segments of one or two bits: the Manhattan distance of two vectors is bit_count(a ^ b)."""
    if bits == 1:
        return fp
    even = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(even)
    full = fp.bitwiseAND(high).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(full, 1))


def grids(distance: int = DISTANCE, bits: int = 2, groups: int = 5) -> list[int]:
    """Masks over the thermometer code, one per grid: every choice of the groups that are left out."""
    n = 64 // bits
    cuts = np.linspace(0, n, groups + 1).round().astype(int)
    group = [sum(((1 << bits) - 1) << bits * s for s in range(cuts[g], cuts[g + 1])) for g in range(groups)]
    return [signed((1 << 64) - 1 - sum(group[g] for g in out)) for out in combinations(range(groups), distance)]


def links(fps: DataFrame, distance: int = DISTANCE, steps: tuple = STEPS, cell: int = CELL) -> DataFrame:
    """(src, dst), src < dst: all pairs of distinct fingerprints (column fp) within `distance` bits, each once."""
    found = []
    for k, (bits, groups) in enumerate(steps):
        spread = fps.select("fp", embedding(F.col("fp"), bits).alias("vec")).select("fp", "vec", F.posexplode(F.lit(grids(distance, bits, groups))).alias("grid", "mask"))
        laid = spread.select("fp", "vec", F.xxhash64("grid", F.col("vec").bitwiseAND(F.col("mask"))).alias("cell"))
        counts = laid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        kept = materialize(laid.join(counts, "cell"), "simhash-cells")
        last = k == len(steps) - 1
        members = kept.where(F.lit(last) | (F.col("n") <= cell)).groupBy("cell").agg(F.collect_list(F.struct("fp", "vec")).alias("m"))

        def partners(a):
            near = lambda b: (b["fp"] > a["fp"]) & (F.bit_count(a["vec"].bitwiseXOR(b["vec"])) <= distance) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= distance)
            return F.transform(F.filter("m", near), lambda b: F.struct(a["fp"].alias("src"), b["fp"].alias("dst")))

        found.append(members.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.src", "e.dst"))
        crowd = kept.where(F.col("n") > cell)
        if last or crowd.isEmpty():
            break
        fps = crowd.select("fp").distinct()
    return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, kept): one row per row of docs.

    component_id is the least id reachable over fingerprints within `distance` bits. kept is true where the row's id
    is that least id, so rows that repeat it are kept alike (see representatives). Null and empty texts share
    fingerprint 0; texts of any length are read whole. A row with a null id belongs to the component of its fingerprint
    but never names it; a component of null ids alone has a null component_id and keeps its rows. An empty table gives
    an empty table. Only the two named columns are read, so other columns cannot clash. A fingerprint that many rows
    have is joined back by broadcast (see common.keyed).
    """
    each = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    joined = connected_components(links(distinct.select("fp"), distance), "simhash")
    classes = materialize(distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root")), "simhash-classes")
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "root").select("fp", "n", "component_id")
    return keyed(each, named, "fp").select("doc_id", "text_hash", "fp", "component_id", (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay: one of each component. Of rows that repeat an id and a text one stays.

    Rows of null ids in a component that has an id go; a component of null ids alone keeps one row of each text. Columns
    of any names are passed through.
    """
    kept = near_duplicates(docs, id_col, text_col, shingle, distance).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_text")).distinct()
    own = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("text"))
    own = own.join(kept, F.col("own").eqNullSafe(F.col("kept_id")) & (F.col("text") == F.col("kept_text")), "left_semi")
    place = F.row_number().over(W.partitionBy("own", "text").orderBy(F.lit(0)))
    return own.withColumn("place", place).where("place = 1").select("row.*")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id, kept for all of `documents`; nulls, empty and long texts, ties, repeats, empty tables and other columns as in near_duplicates."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "kept")


QUERIES = {"op3_simhash_neardup": op3_simhash_neardup}
ORACLE: dict[str, str] = {}
