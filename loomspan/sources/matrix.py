"""A Spark data source for `.npy` matrices: `spark.read.format("matrix").load(path)` and `df.write.format("matrix").save(path)`.

Rows are (identifier, pos, v). A file is planned as several partitions by row range: the planner reads its header only, and a
task seeks to its rows. Ranges of rows and of columns, given as options or as filters on pos, decide which bytes are read. A
matrix that is written by several tasks is a folder `<identifier>.npy` of parts named by their first row; one that fits a part is
a plain file, as NumPy would save it.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "identifier string, pos long, v array<double>"
#: Bytes of a matrix that a task reads, and holds at once, about.
SPLIT, CHUNK = 64 << 20, 4 << 20
#: Tasks over which ranges are dealt, where there are more ranges; a task holds SPLIT bytes of them or so even then.
TASKS = 256
#: Rows of a part that is written.
PART_ROWS = 65_536
ENDLESS = 1 << 62


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, whatever store Arrow knows, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Header:
    """Where the numbers of a matrix begin, and how they lie."""

    offset: int
    rows: int
    width: int
    dtype: np.dtype
    by_column: bool


def header(f: BinaryIO) -> Header:
    """Reads the header of a matrix and nothing beyond. A vector counts as a matrix of one column."""
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or len(shape) not in (1, 2):
        raise ValueError(f"no matrix of numbers: {dtype} {shape}")
    return Header(f.tell(), shape[0], shape[1] if len(shape) == 2 else 1, dtype, by_column)


def rows_of(f: BinaryIO, h: Header, lo: int, hi: int, left: int, right: int) -> np.ndarray:
    """Rows [lo, hi) and columns [left, right): of a matrix by rows the bytes of the rows, of one by columns those of the columns' parts."""
    size = h.dtype.itemsize
    if h.by_column:
        out = np.empty((hi - lo, right - left), h.dtype)
        for c in range(left, right):
            f.seek(h.offset + (c * h.rows + lo) * size)
            out[:, c - left] = np.frombuffer(f.read((hi - lo) * size), h.dtype)
        return out
    f.seek(h.offset + lo * h.width * size)
    return np.frombuffer(f.read((hi - lo) * h.width * size), h.dtype).reshape(-1, h.width)[:, left:right]


@dataclass
class Part(InputPartition):
    """Rows [lo, hi) of a file, whose first row is row `base` of the matrix."""

    path: str
    identifier: str
    base: int
    head: Header
    lo: int
    hi: int


@dataclass
class Load(InputPartition):
    """What one task reads, part after part."""

    parts: list[Part]


def loads(parts: list[Part], split: int = SPLIT) -> list[Load]:
    """Neighbouring parts dealt to tasks: each its own task while they are few; small ones together, so that tasks grow with the bytes and not with the files."""
    total = sum((p.hi - p.lo) * p.head.width * p.head.dtype.itemsize for p in parts)
    n = min(len(parts), max(TASKS, -(-total // max(split, SPLIT))))
    return [Load(parts[i * len(parts) // n : (i + 1) * len(parts) // n]) for i in range(n)]


def found(path: str) -> list[tuple[str, str, int]]:
    """(file, identifier, first row) of every matrix file under a path."""
    at, root = store(path)
    files = at.get_file_info(fs.FileSelector(root, recursive=True)) if at.get_file_info(root).type == fs.FileType.Directory else [at.get_file_info(root)]
    out = []
    for f in files:
        steps = f.path.removeprefix(root).strip("/").split("/") if f.path != root else [f.base_name]
        if f.type != fs.FileType.File or not f.base_name.endswith(".npy") or any(s.startswith("_") for s in steps):
            continue
        parted = len(steps) > 1 and steps[-2].endswith(".npy")
        name = unquote(steps[-2 if parted else -1].removesuffix(".npy"))
        out.append((f.path, name, int(f.base_name.removesuffix(".npy")) if parted else 0))
    return sorted(out)


def span(text: str | None, most: int) -> tuple[int, int]:
    lo, _, hi = (text or ":").partition(":")
    return int(lo or 0), min(int(hi or most), most)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.columns, self.split = options["path"], options.get("columns"), int(options.get("split", SPLIT))
        self.lo, self.hi = int(options.get("start", 0)), int(options.get("end", ENDLESS))
        self.names: set | None = None
        self.bounds = {k: tuple(v) for k, v in json.loads(options.get("bounds", "{}")).items()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on pos narrow the range of rows, those on identifier the files; all others go back to Spark."""
        for f in filters:
            column, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if column == "identifier" and isinstance(f, (EqualTo, In)) and value is not None:
                names = set(value if isinstance(f, In) else [value])
                self.names = names if self.names is None else self.names & names
            elif column == "pos" and value is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value + isinstance(f, GreaterThan))
                self.hi = min(self.hi, value + 1) if isinstance(f, EqualTo) else self.hi
            elif column == "pos" and value is not None and isinstance(f, (LessThan, LessThanOrEqual)):
                self.hi = min(self.hi, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Load]:
        at, _ = store(self.path)
        wanted = [x for x in found(self.path) if (self.names is None or x[1] in self.names) and (not self.bounds or x[1] in self.bounds)]

        def plan(x: tuple) -> list[Part]:
            path, name, base = x
            with at.open_input_file(path) as f:
                h = header(f)
            first, last = self.bounds.get(name, (0, ENDLESS))
            lo, hi = max(0, self.lo - base, first - base), min(h.rows, self.hi - base, last - base)
            step = max(1, self.split // max(1, h.width * h.dtype.itemsize))
            return [Part(path, name, base, h, i, min(i + step, hi)) for i in range(lo, hi, step)]

        with ThreadPoolExecutor(16) as pool:
            return loads([p for parts in pool.map(plan, wanted) for p in parts], self.split)

    def read(self, partition: Load) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if partition is not None else []:  # None: nothing was planned
            yield from self.rows(part)

    def rows(self, partition: Part) -> Iterator[pa.RecordBatch]:
        at, _ = store(self.path)
        h = partition.head
        left, right = span(self.columns, h.width)
        step = max(1, CHUNK // max(1, h.width * 8))
        with at.open_input_file(partition.path) as f:
            for lo in range(partition.lo, partition.hi, step):
                x = rows_of(f, h, lo, min(lo + step, partition.hi), left, right).astype(np.float64)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                pos = pa.array(np.arange(lo, lo + len(x)) + partition.base)
                yield pa.RecordBatch.from_arrays([pa.array([partition.identifier] * len(x)), pos, pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["identifier", "pos", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class MatrixWriter(DataSourceArrowWriter):
    """Tasks write parts under `_temporary`; the commit moves them to their names, so a failed or repeated task leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", PART_ROWS)), overwrite
        self.run = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a matrix come by pos without a gap; parts begin at whole multiples of `rows`, and a task may hold any of them."""
        at, root = store(self.path)
        at.create_dir(f"{root}/{self.run}")
        files, held, name, start = [], [], None, 0

        def flush() -> None:
            if held:
                if len({len(v) for v in held}) > 1:
                    raise ValueError(f"rows of {name} differ in length")
                content, path = io.BytesIO(), f"{root}/{self.run}/{uuid.uuid4().hex}.npy"
                np.save(content, np.array(held, np.float64))
                with at.open_output_stream(path) as out:
                    out.write(content.getvalue())
                files.append((name, start, path))
                held.clear()

        for batch in iterator:
            for identifier, pos, v in zip(*(batch.column(c).to_pylist() for c in ("identifier", "pos", "v")), strict=True):
                if identifier != name or len(held) >= self.rows or pos != start + len(held):
                    if identifier == name and pos != start + len(held) and pos % self.rows:
                        raise ValueError(f"rows of {name} have a gap at {pos}")
                    flush()
                    name, start = identifier, pos
                held.append(v)
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        at, root = store(self.path)
        parts: dict = {}
        for m in messages:
            for name, start, path in m.files if m else []:
                parts.setdefault(quote(name or "", safe=""), []).append((start, path))
        if self.overwrite:
            for f in at.get_file_info(fs.FileSelector(root)):
                if f.base_name.endswith(".npy"):
                    (at.delete_dir if f.type == fs.FileType.Directory else at.delete_file)(f.path)

        def place(x: tuple) -> None:
            name, own = x
            if len(own) == 1 and own[0][0] == 0:
                at.move(own[0][1], f"{root}/{name}.npy")
                return
            at.create_dir(f"{root}/{name}.npy")
            for start, path in own:
                at.move(path, f"{root}/{name}.npy/{start:015d}.npy")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, parts.items()))
        at.delete_dir(f"{root}/{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        at, root = store(self.path)
        if at.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/{self.run}")


class MatrixSource(DataSource):
    """Options of the reader: start and end (rows of every matrix), bounds (JSON, rows by identifier; others are left out), columns ("lo:hi"), split (bytes of a partition); of the writer: rows (of a part)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> MatrixReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source `matrix`, and with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    return spark


def matrices(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(identifier, pos, v) of every matrix under a path; options as MatrixSource states them."""
    return registered(spark).read.format("matrix").options(**options).load(path)


def save_matrices(df: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    """Writes (identifier, pos, v) as a matrix for each identifier over what is there, rows by pos from its first one.

    A matrix of more than `rows` rows is dealt to several tasks and written as parts, so no task holds more than that.
    """
    first = df.groupBy("identifier").agg(F.min("pos").alias("first_"))
    based = df.join(first, "identifier").select("identifier", (F.col("pos") - F.col("first_")).alias("pos"), "v")
    part = F.floor(F.col("pos") / rows)
    dealt = based.repartition(F.col("identifier"), part).sortWithinPartitions("identifier", "pos")
    registered(df.sparkSession)
    dealt.write.format("matrix").option("rows", rows).mode("overwrite").save(path)


def items(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """meta (identifier, s, e, …) with each recording's inputs, rows [s, e) in order, and the first row's number: what a loader iterates over.

    Only the rows inside the bounds are read; the bounds, two numbers for each matrix that is there and asked for, go to the
    planner, which lists the matrices. Recordings without a matrix, or without a row inside their bounds, are left out.
    """
    there = spark.createDataFrame([(n,) for n in sorted({n for _, n, _ in found(path)})], "identifier string")
    bounds = {r["identifier"]: (r["s"], r["e"]) for r in meta.select("identifier", "s", "e").join(there, "identifier", "left_semi").collect()}
    rows = matrices(spark, path, bounds=json.dumps(bounds)) if bounds else matrices(spark, path, end=0)
    whole = rows.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("rows_"))
    return whole.join(meta, "identifier").select(*meta.columns, F.col("rows_")["v"].alias("inputs"), F.col("rows_")[0]["pos"].alias("first"))
