"""Trees of small files, written, walked and read by tasks."""

from pyspark.sql import functions as F

from loomspan.operators import consolidation as O
from loomspan.plans import readers
from loomspan.sources import files as X


def test_put_walk_text(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    rows = [("a/1/x.json", "é\n\"1\""), ("a/1/y.boris", ""), ("a/b c/d=e/z.txt", None), ("top.json", "t" * 70_000), *((f"m/{i}/0.json", str(i)) for i in range(300))]
    df = spark.createDataFrame(rows, "path string, text string").repartition(5)
    X.put(df, root)
    X.put(df, root)  # a repeated task puts the same files over those of the first
    (tmp_path / "tree" / "a" / ".hidden").write_text("no")
    (tmp_path / "tree" / "_temporary" / "left").mkdir(parents=True)
    (tmp_path / "tree" / "_temporary" / "left" / "part").write_text("no")
    (tmp_path / "tree" / "a" / "none").mkdir()
    found = X.walk(spark, root)
    got = {r.path: r.text for r in found.withColumn("text", X.text(root)).collect()}
    assert got == {p: t or "" for p, t in rows}
    assert found.count() == len(rows)
    some = found.where("path LIKE '%.boris'").select(X.text(root).alias("t"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BatchEvalPython") < plan.index("Filter") < plan.index("MapInArrow") and [r.t for r in some.collect()] == [""]
    X.put(df.limit(0), f"{root}-none")
    assert X.walk(spark, f"{root}-none").count() == 0


def test_the_driver_lists_the_first_level_only(spark, tmp_path):
    """Before, Spark's file index held every file on the driver, and each file system call went through it."""
    root = str(tmp_path / "tree")
    X.put(spark.range(400).select(F.concat((F.col("id") % 4).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit("/0.json")).alias("path"), F.lit("x").alias("text")), root)
    found = X.walk(spark, root)
    assert found.rdd.getNumPartitions() == 4 and not found.inputFiles() and found.count() == 400


def test_ingest_reads_each_file_once(spark, tmp_path):
    codes = spark.createDataFrame([("B1", "slip", 1, 1, "errors"), ("C1", "look", 25, 0, "info"), ("A2", "read", 2, 2, "reading")], "label string, semantic string, code int, color int, category_label string")
    names = spark.createDataFrame([("fall", "B1"), ("read", "A2")], "behaviour string, label string")
    events = ",".join(f'["{t}","","{b}","",""]' for t, b in ((1, "read"), (2, "fall"), (3, "read"), (4, "fall"), (5, "read")))
    boris = f'{{"observations":{{"o":{{"events":[{events}]}}}},"behaviors_conf":{{"0":{{"type":"State event","code":"read"}},"1":{{"type":"Point event","code":"fall"}}}}}}'
    vidat = '{"config":{"actionLabelData":[{"id":1,"name":"A2"}]},"annotation":{"video":{"fps":10,"frames":100},"actionAnnotationList":[{"start":0,"end":1,"action":1,"description":""}]}}'
    spark.createDataFrame([("p", "p/1.boris", boris), ("p", "p/0.json", vidat), ("q", "q/0.json", vidat), (None, "r/0.json", vidat)], "identifier string, path string, json string").write.parquet(str(tmp_path / "f"))
    kept, rejected = O.ingest(spark.read.parquet(str(tmp_path / "f")), codes, names)
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2  # one for each tool
    got = sorted((r.identifier, r.path, r.start, r.end or -1.0, r.label, r.category_label, r.type) for r in kept.collect())
    both = lambda *x: [(*x[:4], label, c, x[4]) for label, c in (("A2", "reading"), ("C1", "info"))]
    assert got == sorted([*both("p", "p/1.boris", 1.0, 3.0, "interval"), *both("q", "q/0.json", 0.0, 1.0, "interval"), *(("p", "p/1.boris", t, -1.0, "B1", "errors", "point") for t in (2.0, 4.0))])
    assert {r.path for r in rejected.collect()} == {"p/0.json", "r/0.json"}


def test_artifact_tree_is_put_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(1, 5), (1, 5), (4, 5), (2, 5), (1, 6), (None, 6)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(readers, "folder", lambda spark, name: f"file://{tmp_path}/{name}")
    got = sorted((r.task_name, r.participant_id, r.modality, r.files) for r in readers.scan_artifact_tree(spark, str(tmp_path)).collect())
    assert got == [("cooking", "5", "1", 3), ("cooking", "5", "2", 1), ("cooking", "6", "1", 1), ("cooking", "6", "__HIVE_DEFAULT_PARTITION__", 1)]
    at = tmp_path / "tree" / "t=cooking" / "p=5" / "m=1"
    assert {f.name: f.read_text() for f in at.iterdir()} == {"part-1-1": "1\n", "part-1-2": "1\n", "part-4-1": "4\n"}  # before, names and moves were Spark's writer's
