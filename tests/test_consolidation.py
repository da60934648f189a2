"""Inspection and annotation files, case by case."""

from pyspark.sql import functions as F

from loomspan.operators import consolidation as O

RESULTS = "participant_id string, task_name string, folder_modality string, true_modality string, is_swapped_modality boolean, GP2_above int, is_middle_range int, GP2_is_wrong_buttress int, GoPro1_is_wrong_buttress int"


def test_inspection(spark):
    rows = spark.createDataFrame(
        [("p", "t", "GoPro1", "v1", "old1", None, "x"), ("p", "t", "GoPro2", "v2", "old2", "x", None), ("p", "t", "Tobii", "v3", "old3", None, None), ("q", "t", "GoPro2", "v4", "old4", None, None), ("r", "t", "GoPro3", "v5", "old5", None, None), (None, "t", "GoPro1", "v6", "old6", None, None)],
        "participant_id string, task_name string, modality string, video_name string, identifier string, hand string, speech string",
    )
    seen = spark.createDataFrame([("p", "t", "GoPro2", "GoPro3", True, 0, 0, 0, 0), ("p", "t", "Tobii", "Tobii", False, None, None, 0, 0), ("q", "t", "GoPro2", "GoPro2", False, 1, 0, 0, 0), ("z", "t", "GoPro2", None, None, 0, 0, 0, 0)], RESULTS)
    features = {"flag_hand": ("hand", ("GoPro3",)), "flag_speech": ("speech", ("GoPro1", "GoPro3"))}
    got = {r.video_name: r for r in O.apply_inspection(rows, seen, features).collect()}
    assert set(got) == {"v1", "v2", "v3", "v5", "v6"}  # the failed camera went, rows that nobody looked at stay
    assert (got["v2"].modality, got["v2"].folder_modality, got["v2"].identifier, got["v2"].inspected) == ("GoPro3", "GoPro2", "p_t_GoPro3_v2", True)
    assert (got["v1"].identifier, got["v1"].inspected, got["v1"].audio_modality) == ("old1", False, "GoPro3")  # GoPro2 is none any more
    assert [got[v].flag_hand for v in ("v1", "v2", "v3", "v5")] == ["disabled", "success", "disabled", "unprocessed"]
    assert [got[v].flag_speech for v in ("v1", "v2", "v3", "v5", "v6")] == ["disabled", "unprocessed", "disabled", "unprocessed", "disabled"]
    kept = {r.video_name: r for r in O.apply_inspection(rows, seen, features, swap=False).collect()}
    assert (kept["v2"].modality, kept["v2"].identifier, kept["v2"].flag_hand) == ("GoPro2", "old2", "success") and kept["v1"].audio_modality == "GoPro1"


def test_ingest(spark):
    codes = spark.createDataFrame([("B1", "slip", 1, 1, "errors"), ("E1", "step", 2, 2, "other")], "label string, semantic string, code int, color int, category_label string")
    names = spark.createDataFrame([("fall", "B1")], "behaviour string, label string")
    vidat = lambda *actions: '{"config":{"actionLabelData":[{"id":1,"name":"B1"},{"id":2,"name":"E1"}]},"annotation":{"video":{"fps":10,"frames":100},"actionAnnotationList":[' + ",".join(f'{{"start":{s},"end":{s + 1},"action":{a},"description":""}}' for s, a in actions) + "]}}"
    boris = lambda *times: '{"observations":{"o":{"events":[' + ",".join(f'["{t}","","fall","",""]' for t in times) + ']}},"behaviors_conf":{"0":{"type":"Point event","code":"fall"}}}'
    files = spark.createDataFrame([("p", "a/1.json", vidat((0, 1), (2, 2))), ("p", "a/2.boris", boris(1)), ("q", "a/3.json", vidat((0, 1))), ("q", "b/4.boris", boris(5)), ("r", "a/5.json", "not json"), ("s", "a/notes.txt", "x"), ("t", "a/config.json", vidat((0, 1)))], "identifier string, path string, json string")
    kept, rejected = O.ingest(files, codes, names, ("config.json",))
    got = sorted((r.identifier, r.path, r.start, r.label, r.category, r.category_label) for r in kept.collect())
    assert got == [("p", "a/1.json", 0.0, "B1", "B", "errors"), ("p", "a/1.json", 2.0, "A10", "A", "Etapes de la tache"), ("q", "b/4.boris", 5.0, "B1", "B", "errors")]
    assert {r.path for r in rejected.collect()} == {"a/2.boris", "a/3.json", "a/5.json"}
    assert kept.where(F.col("type") == "point").count() == 1 and O.ingest(files.limit(0), codes, names)[0].count() == 0


def test_inspection_is_not_gathered_on_the_driver(spark):
    rows = spark.createDataFrame([("lego", "7", "Tobii", "a", "7_a", "x")], "task_name string, participant_id string, modality string, video_name string, identifier string, path string")
    cols = ["task_name string", "participant_id string", "folder_modality string", "true_modality string", "is_swapped_modality boolean", *(f"{c} int" for c in O.DEFECTS)]
    seen = spark.createDataFrame([("lego", "7", "Tobii", "Tobii", False, 0, 0, 0, 0)], ", ".join(cols))
    plan = O.apply_inspection(rows, seen, {"flag": ("path", ("Tobii",))})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
