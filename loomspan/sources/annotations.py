"""Annotation files of two tools as one interval table, and names that carry keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of the interval table, after the identifier.
COLUMNS = ("scene", "start_frame", "start", "end_frame", "end", "length_frames", "length", "color", "label", "semantic", "code", "category", "category_label", "description", "type", "fps", "t_duration", "n_frames")
#: The label whose rows also count under a second one, and that one's label, code and colour.
TWICE, ALSO, ALSO_CODE, ALSO_COLOR = "A2", "C1", 25, 0
VIDAT = "struct<config:struct<actionLabelData:array<struct<id:int,name:string,color:string>>>,annotation:struct<video:struct<fps:double,frames:long>,actionAnnotationList:array<struct<start:double,end:double,action:int,description:string>>>>"
BORIS = "struct<observations:map<string,struct<events:array<array<string>>,media_info:struct<fps:map<string,double>,length:map<string,double>>>>,behaviors_conf:map<string,struct<type:string,code:string>>>"


def standard(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Intervals (identifier, scene, start, end, label, description, type, fps, n_frames) with frames, lengths and codes, in COLUMNS.

    codes: (label, semantic, code, color, category_label), a coding scheme, which is broadcast. Labels that it lacks keep
    their row without a code. Frames round half to even. Rows of TWICE are there a second time as ALSO.
    """
    frames = lambda t: F.rint(t * F.col("fps")).cast("long")
    note = F.when(F.length("description") > 0, F.col("description")).otherwise("None")
    out = rows.join(F.broadcast(codes), "label", "left").withColumn("category", F.substring("label", 1, 1))
    length = F.col("end") - F.col("start")
    out = out.select("identifier", "scene", frames(F.col("start")).alias("start_frame"), "start", frames(F.col("end")).alias("end_frame"), "end", frames(length).alias("length_frames"), length.alias("length"), "color", "label", "semantic", "code", "category", "category_label", note.alias("description"), "type", "fps", (F.col("n_frames") / F.col("fps") / 60).alias("t_duration"), "n_frames")
    # a row counts twice in place: a union with itself would read the files once more
    other = codes.where(F.col("label") == ALSO).select(F.col("category_label").alias("other_"), F.lit(True).alias("again_"))
    again = F.when(F.col("label") == TWICE, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = out.withColumn("again_", F.explode(again)).join(F.broadcast(other), "again_", "left")
    for c, also in (("label", F.lit(ALSO)), ("color", F.lit(ALSO_COLOR)), ("code", F.lit(ALSO_CODE)), ("category", F.lit(ALSO[0])), ("category_label", F.col("other_"))):
        out = out.withColumn(c, F.when(F.col("again_"), also).otherwise(F.col(c)))
    return out.select("identifier", *COLUMNS)


def vidat(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """The interval table of files (identifier, json) whose actions are named by a list in each file; an action that is not listed has a null label."""
    parsed = raw.select("identifier", F.from_json("json", VIDAT).alias("j"))
    names = F.map_from_arrays(F.col("j.config.actionLabelData.id"), F.col("j.config.actionLabelData.name"))
    rows = parsed.select("identifier", names.alias("names"), F.col("j.annotation.video").alias("video"), F.posexplode("j.annotation.actionAnnotationList").alias("scene", "a"))
    label = F.try_element_at("names", F.col("a.action")).alias("label")
    return standard(rows.select("identifier", "scene", "a.start", "a.end", label, "a.description", F.lit("interval").alias("type"), "video.fps", F.col("video.frames").alias("n_frames")), codes)


def boris(raw: DataFrame, labels: DataFrame, codes: DataFrame, observation: str | None = None) -> DataFrame:
    """The interval table of files (identifier, json) with events of five or six fields.

    Of the observations of a file the named one counts, or the first. Events of a behaviour that is a state are its starts
    and stops in turn, in the order of the list; a start without a stop is left out. Point events have no end. labels:
    (behaviour, label), the names of behaviours in the coding scheme, broadcast.
    """
    parsed = raw.select("identifier", F.from_json("json", BORIS).alias("j"))
    chosen = F.try_element_at(F.map_values("j.observations"), F.lit(1)) if observation is None else F.try_element_at("j.observations", F.lit(observation))
    file = parsed.select("identifier", chosen.alias("o"), F.transform(F.filter(F.map_values("j.behaviors_conf"), lambda b: b["type"] == "State event"), lambda b: b["code"]).alias("states"))
    media = lambda k: F.try_element_at(F.map_values(f"o.media_info.{k}"), F.lit(1))
    events = file.select("identifier", "states", media("fps").alias("fps"), F.round(media("length") * media("fps")).cast("long").alias("n_frames"), F.posexplode("o.events").alias("at", "e"))
    events = events.select("identifier", "fps", "n_frames", "at", F.array_contains("states", F.get("e", F.lit(2))).alias("state"), F.get("e", F.lit(0)).cast("double").alias("time"), F.get("e", F.lit(2)).alias("behaviour"), F.get("e", F.lit(4)).alias("description"))
    # states are paired, and points kept, in one pass over the files
    w = W.partitionBy("identifier", "behaviour", "fps", "n_frames", "state").orderBy("at")
    turns = events.where("state IS NOT NULL").withColumn("n_", F.row_number().over(w)).withColumn("stop_", F.lead(F.struct("time")).over(w))
    rows = turns.where("NOT state OR n_ % 2 = 1 AND stop_ IS NOT NULL").select("identifier", "behaviour", F.col("time").alias("start"), F.when(F.col("state"), F.col("stop_.time")).alias("end"), "description", F.when(F.col("state"), "interval").otherwise("point").alias("type"), "fps", "n_frames")
    out = rows.join(F.broadcast(labels), "behaviour", "left").drop("behaviour")
    return standard(out.withColumn("scene", F.lit(None).cast("int")), codes)


#: The camera names, and the one participant whose second name is missing.
MODALITIES = ("GoPro1", "GoPro2", "GoPro3", "Tobii")
UNNAMED = "SC_L171_PXX_240823"


def participant(name: str) -> Column:
    """(task, diagnosis, trigram, date) of a participant's name; its layout goes by the number of parts, null if that is none of 4 to 7."""
    p = F.split(name, "_")
    n, part = F.size(p), lambda k: F.get(p, F.lit(k))
    low = lambda k: F.lower(F.trim(part(k)))
    made = lambda *c: F.struct(*(x.cast("string").alias(k) for k, x in zip(("task", "diagnosis", "trigram", "date"), c, strict=True)))
    none = F.lit(None)
    return (
        F.when(F.col(name) == UNNAMED, made(F.lit("L171"), F.lit("PXX"), F.lit("xxxxxx"), F.lit("240823")))
        .when(n == 6, made(part(0), part(1), low(2), F.substring(part(5), 1, 6)))
        .when((n == 5) & (part(0) == "SC"), made(part(1), part(2), low(3), part(4)))
        .when(n == 4, made(part(0), part(1), low(2), part(3)))
        .when(n == 7, made(part(0), part(3), part(1), part(6)))
        .otherwise(made(none, none, none, none))
    )


def identifier(name: str, strict: bool = True) -> Column:
    """(task_name, participant_id, modality, video_name) of an identifier; a leading SC_ is left out.

    strict: a modality that is none of MODALITIES is an error; else it is null.
    """
    p = F.split(F.regexp_replace(name, "^SC_", ""), "_")
    modality = F.get(p, F.lit(5))
    wrong = F.raise_error(F.concat(F.lit("invalid modality: "), F.coalesce(modality, F.lit("none")))).cast("string") if strict else F.lit(None).cast("string")
    known = F.when(modality.isin(*MODALITIES), modality).otherwise(wrong)
    return F.struct(F.get(p, F.lit(4)).alias("task_name"), F.array_join(F.slice(p, 1, 4), "_").alias("participant_id"), known.alias("modality"), F.array_join(F.slice(p, 7, 1 << 20), "_").alias("video_name"))


def shapes(df: DataFrame, column: str) -> DataFrame:
    """df plus n and dims: the length of a sequence and of its elements (1 for plain symbols).

    The column must be an array of numbers or of arrays of numbers; in one sequence all elements must be of one length.
    """
    kind = df.schema[column].dataType.simpleString()
    inner = kind.removeprefix("array<").removesuffix(">")
    deep = inner.startswith("array<")
    number = inner.removeprefix("array<").removesuffix(">").split("(")[0]
    if not kind.startswith("array<") or number not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        raise TypeError(f"{column} is {kind}; a sequence is an array of numbers, or of arrays of them")
    if not deep:
        return df.withColumn("n", F.size(column)).withColumn("dims", F.lit(1))
    sizes = F.array_distinct(F.transform(column, F.size))
    dims = F.when(F.size(sizes) <= 1, F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))).otherwise(F.raise_error(F.lit("elements of different lengths")).cast("int"))
    return df.withColumn("n", F.size(column)).withColumn("dims", dims)
