"""Recordings corrected by visual inspection, and annotation files of many hands made one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.sources import annotations as N

KEYS = ("task_name", "participant_id", "modality")
#: Defects that mean a failed collection.
DEFECTS = ("GP2_is_wrong_buttress", "GP2_above", "GoPro1_is_wrong_buttress", "is_middle_range")
#: The label that annotators gave to what belongs to another category, and what becomes of it.
MOVED, BECOMES = "E1", {"label": "A10", "category": "A", "category_label": "Etapes de la tache"}


def apply_inspection(rows: DataFrame, results: DataFrame, features: dict[str, tuple[str, tuple[str, ...]]], swap: bool = True) -> DataFrame:
    """Recordings (KEYS, video_name, identifier, paths) as inspection leaves them, plus folder_modality, audio_modality, inspected and a flag for each feature.

    results: (task_name, participant_id, folder_modality, true_modality, is_swapped_modality, DEFECTS), a row for each
    camera that was looked at; recordings without one stay and are not `inspected`. Failed collections go. A swapped camera
    gets its true modality and an identifier made of it (swap=False leaves both and only flags by the true one). features:
    flag name to (path column, modalities): success where there is a path, else disabled for other modalities and unprocessed for
    these; flags of speech are disabled for all but the participant's audio camera.
    """
    seen = results.select(*(F.col(c).alias(f"{c}_r") for c in results.columns))
    on = [F.col(k) == F.col("folder_modality_r" if k == "modality" else f"{k}_r") for k in KEYS]
    # results may be derived from a small file that grows by explosions which no estimate sees: they are sorted, not gathered on the driver
    met = rows.join(seen.hint("merge"), on, "left").withColumn("inspected", F.col("participant_id_r").isNotNull()).withColumn("folder_modality", F.coalesce("folder_modality_r", "modality"))
    for c in DEFECTS:
        met = met.where(F.coalesce(F.col(f"{c}_r"), F.lit(0)) != 1)
    swapped = F.coalesce(F.col("is_swapped_modality_r"), F.lit(False))
    true = F.coalesce("true_modality_r", "modality")
    if swap:
        met = met.withColumn("modality", F.when(swapped, F.col("true_modality_r")).otherwise(F.col("modality")))
        named = F.concat_ws("_", "participant_id", "task_name", "true_modality_r", "video_name")
        met = met.withColumn("identifier", F.when(swapped, named).otherwise(F.col("identifier")))
        true = F.col("modality")
    # a participant's cameras are few: which of two there are is one aggregate, joined back by a window of these rows
    has = lambda m: F.max(F.col("modality") == m).over(W.partitionBy("participant_id"))
    met = met.withColumn("audio_modality", F.when(has("GoPro2"), "GoPro1").when(has("GoPro3"), "GoPro3"))
    for flag, (path, modalities) in features.items():
        state = F.when(F.col(path).isNotNull(), "success").when(true.isin(*modalities), "unprocessed").otherwise("disabled")
        met = met.withColumn(flag, F.when(F.lit("speech" not in flag) | (F.col("modality") == F.col("audio_modality")), state).otherwise("disabled"))
    return met.drop(*(f"{c}_r" for c in results.columns))


def ingest(files: DataFrame, codes: DataFrame, behaviours: DataFrame, excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejected) of annotation files (identifier, path, json): one interval table, and the files that gave it nothing.

    A path that ends in .boris is read as of one tool, in .json as of the other; other files, and those named in
    `excluded`, are not looked at. Of the files of one identifier that with the most entries counts, the last by path of equals.
    """
    wanted = files.where(F.col("path").rlike(r"\.(boris|json)$") & ~F.regexp_extract("path", "[^/]*$", 0).isin(*excluded))
    one = wanted.select(F.struct("identifier", "path").alias("identifier"), "json")
    of = lambda end: one.where(F.col("identifier.path").endswith(end))
    table = N.vidat(of(".json"), codes).unionByName(N.boris(of(".boris"), behaviours, codes)).select("identifier.identifier", "identifier.path", *N.COLUMNS)
    sizes = table.groupBy("identifier", "path").agg(F.count("*").alias("n"))
    best = sizes.groupBy("identifier").agg(F.max(F.struct("n", "path"))["path"].alias("path"))
    # the entries of an identifier are few: they are sent once and settled by windows, so that files are read and parsed once
    n = F.count("*").over(W.partitionBy("identifier", "path"))
    counted = table.where("identifier IS NOT NULL").repartition("identifier").withColumn("n_", n)
    kept = counted.withColumn("best_", F.max(F.struct("n_", "path")).over(W.partitionBy("identifier"))["path"]).where("path = best_")
    moved = F.col("label") == MOVED
    for c in ("category", "category_label", "label"):
        kept = kept.withColumn(c, F.when(moved, BECOMES[c]).otherwise(F.col(c)))
    return kept.select("identifier", "path", *N.COLUMNS), wanted.select("identifier", "path").join(best, ["identifier", "path"], "left_anti")
