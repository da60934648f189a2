"""Trees of small files that tasks write, walk and read: the driver sees the names of a tree's first level and no more.

Paths go through Arrow's file systems, as those of matrices do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.matrix import store

#: Tasks for each core over which the entries of a tree's first level are dealt, and paths that a task gives at once.
TASKS, GIVEN = 4, 10_000
#: Names that begin so are not of the tree, as for Spark's readers.
HIDDEN = ("_", ".")


@lru_cache(8)
def opened(root: str) -> tuple[fs.FileSystem, str]:
    at, top = store(root)
    return at, top.rstrip("/")


def put(rows: DataFrame, root: str) -> None:
    """Writes each row (path, text) as a file under root, by the task that holds the row.

    Paths are relative to root and differ. A file is moved to its name when it is whole, so a repeated task puts the same
    files over those of the first. Rows of one folder next to each other spare a task from asking for that folder again.
    """

    def write(part: Iterator[Row]) -> None:
        at, top = opened(root)
        own, last = f"{top}/_temporary/{uuid.uuid4().hex}", None
        at.create_dir(own)
        for path, text in part:
            folder = path.rpartition("/")[0]
            if folder and folder != last:
                at.create_dir(f"{top}/{folder}")
                last = folder
            with at.open_output_stream(f"{own}/part", compression=None) as out:
                out.write((text or "").encode())
            at.move(f"{own}/part", f"{top}/{path}")
        at.delete_dir(own)

    at, top = opened(root)
    at.create_dir(f"{top}/_temporary")
    rows.select("path", "text").foreachPartition(write)
    at.delete_dir(f"{top}/_temporary")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path): every file under root, relative to it. The first level is listed now and dealt to tasks, which list what is below when the rows are asked for."""
    at, top = opened(root)
    first = sorted(f.base_name for f in at.get_file_info(fs.FileSelector(top)) if not f.base_name.startswith(HIDDEN))

    def below(name: str) -> Iterator[str]:
        at, top = opened(root)
        left = [f"{top}/{name}"]
        while left:
            here = at.get_file_info(left.pop())
            for f in at.get_file_info(fs.FileSelector(here.path)) if here.type == fs.FileType.Directory else [here]:
                if f.type == fs.FileType.Directory and not f.base_name.startswith(HIDDEN):
                    left.append(f.path)
                elif f.type == fs.FileType.File and not f.base_name.startswith(HIDDEN):
                    yield f.path.removeprefix(f"{top}/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for path in below(first[i]):
                    held.append(path)
                    if len(held) == GIVEN:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])
                        held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])

    return spark.range(0, len(first), 1, max(1, min(len(first), TASKS * spark.sparkContext.defaultParallelism))).mapInArrow(listed, "path string")


def text(root: str, path: str = "path") -> Column:
    """What the file at a path of `walk` holds. Filters on paths go before it, and a task holds a hundred files at once, not an Arrow batch of them."""

    @F.udf("string", useArrow=False)
    def read(p: str) -> str:
        at, top = opened(root)
        with at.open_input_stream(f"{top}/{p}", compression=None) as f:
            return f.read().decode(errors="replace")

    return read(path)
