"""Readers: driver tables, event sequences, files of the domain, and a registry of named datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Symbols of event sequences; a symbol's code is its place.
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, label, sym, value, ts, event_id): events of a user in order, positions from 0."""
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    label = F.array_position(F.array(*map(F.lit, SYMBOLS)), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), pos.cast("long").alias("pos"), label.cast("long").alias("label"), F.col("event_type").alias("sym"), "value", "ts", "event_id")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, label, v): embedding blocks, 50 in a recording."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("id"), F.col("vec_id").alias("pos"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, with only the columns asked for."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema)
    return df.select(*columns) if columns else df


def eye_tracker(spark: SparkSession, path: str, columns: list[str]) -> dict[str, DataFrame]:
    """A tab-separated export with decimal commas, as one table for each value of `sensor`.

    Every column of `columns` must be there; values that are no number read as null.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in ("sensor", "time", *columns) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.regexp_replace(c, ",", ".").try_cast("double").alias(c)
    typed = raw.select("sensor", number("time"), *(number(c) for c in columns))
    names = [r["sensor"] for r in typed.select("sensor").distinct().orderBy("sensor").collect()]
    return {s: typed.where(F.col("sensor").eqNullSafe(s)).drop("sensor") for s in names}


def artifact_tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(task_name, participant_id, modality, file_name, file_path) of root/task/participant/modality/file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    part = F.split("path", "/")
    return files.select(*(F.element_at(part, -k).alias(n) for k, n in ((4, "task_name"), (3, "participant_id"), (2, "modality"), (1, "file_name"))), F.col("path").alias("file_path"))


HAND = "array<struct<x:double,y:double,z:double,visibility:double,presence:double>>"
HANDS = f"frames array<struct<handedness:array<array<struct<category_name:string,display_name:string,score:double>>>,hand_landmarks:array<{HAND}>>>"


def hand_frames(raw: DataFrame) -> DataFrame:
    """(identifier, frame, side, detected, score, points): both sides of every frame; points are null where a side is absent.

    raw: (identifier, frames) in the schema HANDS. The first hand of a side counts.
    """
    frames = raw.select("identifier", F.posexplode("frames").alias("frame", "f")).withColumn("side", F.explode(F.array(F.lit("Left"), F.lit("Right"))))
    hands = F.arrays_zip(F.col("f.handedness").alias("h"), F.col("f.hand_landmarks").alias("p"))
    first = F.try_element_at(F.filter(hands, lambda x: x["h"][0]["category_name"] == F.col("side")), F.lit(1))
    points = F.transform(first["p"], lambda q: F.array(q["x"], q["y"], q["z"]))
    return frames.withColumn("one", first).select("identifier", F.col("frame").cast("long").alias("frame"), "side", F.col("one").isNotNull().alias("detected"), F.col("one.h")[0]["score"].alias("score"), points.alias("points"))


SPEECH = "struct<segments:array<struct<text:string,start:double,end:double,words:array<struct<score:double,speaker:string>>>>>"


def speech_segments(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(identifier, seg, text, start, end, scores, speakers); keys that are missing read as null."""
    parsed = raw.select("identifier", F.from_json(json_col, SPEECH).alias("j"))
    out = parsed.select("identifier", F.posexplode("j.segments").alias("seg", "s"))
    return out.select("identifier", F.col("seg").cast("long").alias("seg"), "s.text", "s.start", "s.end", F.col("s.words.score").alias("scores"), F.col("s.words.speaker").alias("speakers"))


def paired_events(events: DataFrame, state: str = "state") -> DataFrame:
    """(identifier, category, start, stop, kind): starts and stops of state events paired in order of occurrence, point events kept.

    events: (identifier, category, time, kind). A start without a stop has a null stop.
    """
    w = W.partitionBy("identifier", "category").orderBy("time")
    states = events.where(F.col("kind") == state).withColumn("n", F.row_number().over(w)).withColumn("stop", F.lead("time").over(w)).where("n % 2 = 1")
    points = events.where(F.col("kind") != state)
    return states.select("identifier", "category", F.col("time").alias("start"), "stop", "kind").unionByName(points.select("identifier", "category", F.col("time").alias("start"), F.col("time").alias("stop"), "kind"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sequences": sequences, "blocks": blocks}


def dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dataset by name: a registered one, or a table of the folder."""
    return REGISTRY[name](spark, path) if name in REGISTRY else table(spark, path, name)


def filesystem(spark: SparkSession, path: str):
    """Spark's own view of a path, whatever store it is in: (file system, path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def save(df: DataFrame, path: str, by: str | None = None, form: str = "parquet", dated: str | None = None) -> None:
    """Writes a table over what is there. dated: a stamp; what is there is kept beside it under a name with that stamp."""
    if dated:
        store, at = filesystem(df.sparkSession, path)
        if store.exists(at):
            store.rename(at, df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_{dated}"))
    writer = df.write.mode("overwrite").options(**({"header": True} if form == "csv" else {}))
    (writer.partitionBy(by) if by else writer).format(form).save(path)
