"""Stream forms of the batch operators. Each takes a streaming or a batch DataFrame of events (ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema=None, files: int | None = 1) -> DataFrame:
    """A stream over a folder of Parquet files with event times as TIMESTAMP. files: so many in a micro-batch; None: all that are new."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    out = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows, or sliding ones with a step; rows later than the watermark are dropped."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key inside the watermark; a batch keeps one row of each key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def running_runs(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n): runs of equal symbols of each user, given out when they end. State: the open run.

    Rows of a user must come in order over the micro-batches; inside one they are sorted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, n = state.get if state.exists else (None, 0)
        out = []
        for t in pd.concat(list(frames)).sort_values(["ts", "event_id"])["event_type"]:
            if t == kind:
                n += 1
                continue
            if kind is not None:
                out.append((key[0], kind, n))
            kind, n = t, 1
        state.update((kind, n))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "n"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, n long", "kind string, n long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that its source holds into a memory table (tests and small results)."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return df.sparkSession.table(name)


def write_once(df: DataFrame, path: str, checkpoint: str, fail: Callable[[int], bool] = lambda n: False) -> None:
    """A sink that a retried batch does not double: each batch overwrites its own folder.

    Runs over all that the source holds, from where the checkpoint ends. fail: whether to fail after batch n was written and
    before it is committed, which is the worst moment (tests).
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if fail(n):
            raise RuntimeError(f"batch {n} fails after it was written")

    df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def replayed(arrivals: list[DataFrame], step: Callable[[DataFrame], DataFrame], root: str, fail: Callable[[int], bool] = lambda n: False) -> DataFrame:
    """What a stream gives for rows that come in these arrivals, in append mode.

    The rows of an arrival are added to the source's folder; then the query starts again from its checkpoint, reads what is
    new and ends. So state, watermark and sink are taken over from one run to the next as after a crash or a new release. A
    run that fails is started once more. Rows that no window or timer has given out after the last arrival are still state.
    """
    spark = arrivals[0].sparkSession
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{root}/in")
        run = lambda how: write_once(step(source(spark, f"{root}/in", arrivals[0].schema, None)), f"{root}/out", f"{root}/checkpoint", how)
        try:
            run(fail)
        except StreamingQueryException:
            run(lambda n: False)
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
