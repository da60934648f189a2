"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that an Arrow batch carries to a Python worker, about; the default of 64 MB would be held several times over by each of an executor's workers.
BATCH = "4194304b"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. Also bounds the session's Arrow batches, where they are at Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session without one (tests, a laptop) gets a folder of its own; on a cluster the setting must be there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    The files outlive any executor, so a lost one costs a re-read, not a recomputation. free: lets Spark's cleaner
    drop the shuffle files of the step that has ended, which it does when the driver collects its garbage. The folder
    stays until discard() is called on the result, or whoever owns the shared folder cleans it.
    """
    path = f"{shared_dir(df.sparkSession)}/loomspan/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no table still to be computed reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(conf).delete(path, True)


def keyed(rows: DataFrame, table: DataFrame, key: str, hot: int = 1024) -> DataFrame:
    """Inner join of rows to a table with one row a key, whose column n counts the rows of that key; n is left out.

    Keys that hold more than one in `hot` of all rows are fewer than `hot`, so their rows of the table are broadcast and
    the rows of a hot key stay where they are; the others are shuffled by the key. Rows of a null key are lost.
    """
    held = [c for c in table.columns if c not in (key, "n")]
    total = table.agg(F.sum("n")).first()[0] or 0
    warm = table.where(F.col("n") > max(total // hot, 1000)).select(F.col(key), F.struct(F.lit(True).alias("hit_"), *held).alias("hot_"))
    if warm.isEmpty():
        return rows.join(table.drop("n"), key)
    both = rows.join(F.broadcast(warm), key, "left")
    own = [F.col(key), *(F.col(c) for c in rows.columns if c != key)]
    fast = both.where("hot_.hit_").select(*own, *(F.col(f"hot_.{c}").alias(c) for c in held))
    slow = both.where("hot_.hit_ is null").drop("hot_").join(table.drop("n"), key)
    return fast.unionByName(slow.select(*own, *held))


def named(column: str):
    """A column by its very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows <= 1 or column.nbytes <= most:
            yield batch
            continue
        sizes = column.cast(pa.large_binary()).to_pylist()
        begin, held = 0, 0
        for i, x in enumerate(sizes):
            held += len(x or b"")
            if held >= most:
                yield batch.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def labelled(docs: DataFrame, text_col: str, kinds: list[tuple], run) -> DataFrame:
    """docs plus the columns `kinds` (name, type), which run(texts) gives as Arrow arrays for an Arrow column of texts.

    Columns that have a new name, in any case, are replaced; the others go through the workers under plain names of their
    own, so theirs may hold dots, backticks or anything else.
    """
    gone = {n.lower() for n, _ in kinds}
    kept = [c for c in docs.columns if c.lower() not in gone]
    rest = {c: f"c{i}" for i, c in enumerate(kept) if c != text_col}
    flat = docs.select(F.struct(F.lit(0).alias("none"), *(named(c).alias(x) for c, x in rest.items())).alias("row_"), named(text_col).alias("text_"))
    new = [f"n{i}" for i in range(len(kinds))]
    schema = T.StructType([*flat.schema.fields, *(T.StructField(x, k) for x, (_, k) in zip(new, kinds, strict=True))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_"):
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch.column(1))], ["row_", "text_", *new])

    back = [(F.col("text_") if c == text_col else F.col(f"row_.{rest[c]}")).alias(c) for c in kept]
    return flat.mapInArrow(each, schema).select(*back, *(F.col(x).alias(n) for x, (n, _) in zip(new, kinds, strict=True)))


def words(text: str = "text"):
    """The words of a text as an array column; null text has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")


def bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n: the split that the contracts fix. A null id falls in bucket 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))
