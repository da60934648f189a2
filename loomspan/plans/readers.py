"""Files of the domain, written from the driver tables and read back, and the names and shapes they carry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.plans.inventory import folder
from loomspan.plans.registry import query
from loomspan.plans.relational import SEQ
from loomspan.sources import annotations as N
from loomspan.sources import files as X
from loomspan.sources import matrix as M
from loomspan.sources import tables as T
from loomspan.sources.tables import blocks, sequences, table

#: A coding scheme: symbol, label, semantic, code, colour, name of the category.
SCHEME = (("click", "A2", "read", 2, 5, "reading"), ("error", "B1", "slip", 11, 6, "errors"), ("purchase", "C1", "look", 25, 7, "information"), ("signup", "D1", "ask", 31, 8, "questions"))
CODES = "codes AS (SELECT * FROM (VALUES " + ", ".join(map(str, SCHEME)) + ") AS c(sym, label, semantic, code, color, category_label))"
SHOWN = "start_frame, end_frame, length_frames, color, label, semantic, code, category, category_label, description, type, fps, round(t_duration, 6) AS t_duration, n_frames"
STANDARD = "f AS (SELECT i.*, c.color, c.label, c.semantic, c.code, c.label[1] AS category, c.category_label, round_even(i.start * fps, 0)::BIGINT AS start_frame, round_even(i.end * fps, 0)::BIGINT AS end_frame, round_even((i.end - i.start) * fps, 0)::BIGINT AS length_frames, n_frames / fps / 60 AS t_duration FROM i LEFT JOIN codes c ON c.sym = i.sym), o AS (SELECT * FROM f UNION ALL SELECT * REPLACE ('C1' AS label, 0 AS color, 25 AS code, 'C' AS category, 'information' AS category_label) FROM f WHERE label = 'A2')"


def scheme(spark):
    return spark.createDataFrame([r[1:] for r in SCHEME], "label string, semantic string, code int, color int, category_label string")


def shown(df):
    return df.select(F.col("identifier").cast("long").alias("id"), "scene", "start", "end", *(c for c in N.COLUMNS if c not in ("scene", "start", "end", "length", "t_duration")), F.round("t_duration", 6).alias("t_duration"))


@query(f"WITH {SEQ}, {CODES}, i AS (SELECT id, pos AS scene, pos::DOUBLE AS start, pos + (event_id % 5 + 1) * 0.5e0 AS end, sym, CASE WHEN event_id % 2 = 0 THEN 'None' ELSE 'n' || event_id END AS description, 'interval' AS type, 25e0 AS fps, count(*) OVER (PARTITION BY id) * 25 AS n_frames FROM s), {STANDARD} SELECT id, scene, start, o.end, {SHOWN} FROM o")
def scan_vidat_json(spark, d):
    """One file a recording, with its own list of actions; one action in five is not in the coding scheme."""
    s = sequences(spark, d)
    note = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string")))
    one = F.struct(F.col("pos").cast("double").alias("start"), (F.col("pos") + (F.col("event_id") % 5 + 1) * 0.5).alias("end"), F.col("label").cast("int").alias("action"), note.alias("description"))
    names = [*(r[:2] for r in SCHEME), ("view", None)]
    listed = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(label).alias("name"), F.lit("#000").alias("color")) for i, (_, label) in enumerate(names)))
    g = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("a"))))["a"].alias("list"), F.count("*").alias("n"))
    video = F.struct(F.lit(25.0).alias("fps"), (F.col("n") * 25).alias("frames"))
    doc = F.struct(F.struct(listed.alias("actionLabelData")).alias("config"), F.struct(video.alias("video"), F.col("list").alias("actionAnnotationList")).alias("annotation"))
    raw = g.select(F.col("id").cast("string").alias("identifier"), F.to_json(doc).alias("json"))
    return shown(N.vidat(raw, scheme(spark))).withColumn("scene", F.col("scene").cast("long"))


@query(f"WITH {SEQ}, {CODES}, q AS (SELECT *, row_number() OVER w AS k, lead(pos) OVER w AS stop FROM s WHERE sym IN ('click', 'signup') WINDOW w AS (PARTITION BY id, sym ORDER BY pos)), e AS (SELECT id, pos::DOUBLE AS start, stop::DOUBLE AS end, sym, 'interval' AS type, event_id FROM q WHERE k % 2 = 1 AND stop IS NOT NULL UNION ALL SELECT id, pos, NULL, sym, 'point', event_id FROM s WHERE sym NOT IN ('click', 'signup')), i AS (SELECT e.id, NULL::INTEGER AS scene, start, e.end, sym, CASE WHEN event_id % 2 = 0 THEN 'None' ELSE 'n' || event_id END AS description, type, 25e0 AS fps, n.n * 25 AS n_frames FROM e JOIN (SELECT id, count(*) AS n FROM s GROUP BY id) n ON n.id = e.id), {STANDARD} SELECT id, scene, start, o.end, {SHOWN} FROM o")
def scan_boris_json(spark, d):
    """One file a recording; odd ones have events of six fields and a second observation that is not read."""
    s = sequences(spark, d)
    note = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string")))
    five = [F.col("pos").cast("string"), F.lit("subject"), F.col("sym"), F.lit(""), note]
    event = F.when(F.col("id") % 2 == 0, F.array(*five)).otherwise(F.array(*five, F.lit("ok")))
    g = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", event.alias("e"))))["e"].alias("events"), F.count("*").cast("double").alias("n"))
    media = F.struct(F.create_map(F.lit("a.mp4"), F.lit(25.0)).alias("fps"), F.create_map(F.lit("a.mp4"), F.col("n")).alias("length"))
    observed, empty = F.struct("events", media.alias("media_info")), F.struct(F.array().cast("array<array<string>>").alias("events"), media.alias("media_info"))
    every = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("first"), observed)).otherwise(F.create_map(F.lit("first"), observed, F.lit("second"), empty))
    kinds = [x for i, sym in enumerate(T.SYMBOLS) for x in (F.lit(str(i)), F.struct(F.lit("State event" if sym in ("click", "signup") else "Point event").alias("type"), F.lit(sym).alias("code")))]
    raw = g.select(F.col("id").cast("string").alias("identifier"), F.to_json(F.struct(every.alias("observations"), F.create_map(*kinds).alias("behaviors_conf"))).alias("json"))
    labels = spark.createDataFrame([r[:2] for r in SCHEME], "behaviour string, label string")
    return shown(N.boris(raw, labels, scheme(spark)))


PARTS = "CASE c_custkey % 6 WHEN 0 THEN 'T1_D2_ABc_2401' WHEN 1 THEN 'SC_T1_D' || c_nationkey || '_ABc_2402' WHEN 2 THEN 'T1_D2_ Xy _P_V_240301xx' WHEN 3 THEN 'T' || c_custkey || '_Tri_x_D9_y_z_2404' WHEN 4 THEN 'SC_L171_PXX_240823' ELSE 'one_two' END"


@query(f"WITH n AS (SELECT c_custkey, c_custkey % 6 AS k, string_split({PARTS}, '_') AS p FROM customer) SELECT c_custkey, CASE k WHEN 1 THEN p[2] WHEN 4 THEN 'L171' WHEN 5 THEN NULL ELSE p[1] END AS task, CASE k WHEN 1 THEN p[3] WHEN 3 THEN p[4] WHEN 4 THEN 'PXX' WHEN 5 THEN NULL ELSE p[2] END AS diagnosis, CASE k WHEN 1 THEN lower(p[4]) WHEN 3 THEN p[2] WHEN 4 THEN 'xxxxxx' WHEN 5 THEN NULL ELSE trim(lower(p[3])) END AS trigram, CASE k WHEN 0 THEN p[4] WHEN 1 THEN p[5] WHEN 2 THEN p[6][1:6] WHEN 3 THEN p[7] WHEN 4 THEN '240823' END AS date FROM n")
def str_parse_participant_id(spark, d):
    """Names of four, five, six and seven parts, the one without a trigram, and one that has no layout."""
    return table(spark, d, "customer").select("c_custkey", F.expr(PARTS).alias("name")).select("c_custkey", N.participant("name").alias("p")).select("c_custkey", "p.*")


IDENTIFIER = "CASE WHEN c_custkey % 2 = 0 THEN 'SC_' ELSE '' END || 'G_P' || c_custkey || '_Tri_2401_cooking_' || CASE c_custkey % 5 WHEN 0 THEN 'GoPro1' WHEN 1 THEN 'GoPro2' WHEN 2 THEN 'GoPro3' WHEN 3 THEN 'Tobii' ELSE 'Phone' END || '_merged_' || c_nationkey"


@query("SELECT c_custkey, 'cooking' AS task_name, 'G_P' || c_custkey || '_Tri_2401' AS participant_id, CASE c_custkey % 5 WHEN 0 THEN 'GoPro1' WHEN 1 THEN 'GoPro2' WHEN 2 THEN 'GoPro3' WHEN 3 THEN 'Tobii' END AS modality, 'merged_' || c_nationkey AS video_name FROM customer")
def str_parse_identifier(spark, d):
    """Keys of an identifier; here an unknown camera is null (it is an error where the parser is strict)."""
    return table(spark, d, "customer").select("c_custkey", F.expr(IDENTIFIER).alias("name")).select("c_custkey", N.identifier("name", strict=False).alias("p")).select("c_custkey", "p.*")


@query(f"WITH {SEQ}, n AS (SELECT id, count(*)::INTEGER AS n FROM s GROUP BY id) SELECT id, n, 1 AS dims FROM n UNION ALL SELECT id, n, 2 FROM n")
def dist_input_shapes(spark, d):
    """Sequences of symbols, and of pairs of numbers, checked and measured."""
    s = sequences(spark, d)
    one = s.groupBy("id").agg(F.collect_list("label").alias("q"))
    two = s.groupBy("id").agg(F.collect_list(F.array(F.col("label").cast("double"), F.col("value"))).alias("q"))
    return N.shapes(one, "q").select("id", "n", "dims").unionByName(N.shapes(two, "q").select("id", "n", "dims"))


@query("SELECT event_type AS sensor, event_id::DOUBLE AS time, floor(value) + 0.5 AS x FROM events")
def scan_tsv_gaze(spark, d):
    """An export with tabs and decimal commas, read as one table for each sensor; all of them."""
    at = folder(spark, "tsv")
    e = table(spark, d, "events").select(F.col("event_type").alias("sensor"), F.col("event_id").cast("string").alias("time"), F.concat(F.floor("value").cast("string"), F.lit(",5")).alias("x"))
    e.write.csv(at, sep="\t", header=True)
    out = None
    for sensor, df in T.eye_tracker(spark, at, ["x"]).items():
        df = df.select(F.lit(sensor).alias("sensor"), "time", "x")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT 'cooking' AS task_name, s_nationkey::VARCHAR AS participant_id, (s_suppkey % 3)::VARCHAR AS modality, count(*) AS files FROM supplier GROUP BY ALL")
def scan_artifact_tree(spark, d):
    """A folder tree of one file a supplier, by task, participant and modality: the files found are counted; only their names are read."""
    at = folder(spark, "tree")
    part = lambda c: F.coalesce(c.cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    n = F.row_number().over(W.partitionBy("s_nationkey", "s_suppkey").orderBy("s_suppkey"))  # keys that repeat are files of their own
    c = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", n.alias("n"))
    name = F.concat(F.lit("t=cooking/p="), part(F.col("s_nationkey")), F.lit("/m="), part(F.col("s_suppkey") % 3), F.lit("/part-"), part(F.col("s_suppkey")), F.lit("-"), F.col("n").cast("string"))
    # a row becomes a file, so rows are dealt to tasks by their number
    X.put(c.select(name.alias("path"), F.concat(part(F.col("s_suppkey")), F.lit("\n")).alias("text")).repartition(64), at)
    value = lambda c: F.element_at(F.split(c, "="), 2).alias(c)
    tree = T.artifact_tree(spark, at, "part-*").select(value("task_name"), value("participant_id"), value("modality"))
    return tree.groupBy("task_name", "participant_id", "modality").agg(F.count("*").alias("files"))


KINDS = {"text": ("documents", "doc_id"), "label": ("labels", "doc_id"), "page": ("pages", "page_id"), "unit": ("benchmark", "item_id"), "talk": ("conversations", "conv_id"), "vector": ("embeddings", "vec_id")}


@query("WITH a AS (" + " UNION ALL ".join(f"SELECT DISTINCT {k}::VARCHAR AS item, '{n}' AS t, '{n}/' || {k} AS p FROM {t}" for n, (t, k) in KINDS.items()) + ") SELECT item, " + ", ".join(f"max(p) FILTER (t = '{n}') AS {n}_path" for n in KINDS) + " FROM a GROUP BY item")
def scan_collect_paths(spark, d):
    """scan.collect_*: six kinds of output, each a column of its item, which is made where it is missing: one shuffle for all."""
    out = None
    for name, (t, k) in KINDS.items():
        item = F.col(k).cast("string")
        one = table(spark, d, t).select(item.alias("item"), F.lit(name).alias("t"), F.concat(F.lit(f"{name}/"), item).alias("p")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.groupBy("item").pivot("t", list(KINDS)).agg(F.max("p")).withColumnsRenamed({n: f"{n}_path" for n in KINDS})


def recordings(spark, d):
    """The blocks of the table as a folder of matrices, one for each recording, written in parts of 32 rows."""
    at = folder(spark, "npy")
    M.save_matrices(blocks(spark, d).select(F.col("id").cast("string").alias("identifier"), "pos", "v"), at, 32)
    return at


def total(v="v"):
    return F.round(F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)), 5).alias("total")


@query("SELECT vec_id // 50 AS id, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total, max(vec_id % 50)::BIGINT AS last FROM embeddings GROUP BY ALL")
def scan_npy_matrix(spark, d):
    """sink.npy and scan.npy_matrix: a matrix for each recording, written by the tasks that hold its rows and read back."""
    m = M.matrices(spark, recordings(spark, d))
    return m.groupBy(F.col("identifier").cast("long").alias("id")).agg(F.count("*").alias("n"), total(), F.max("pos").alias("last"))


@query("SELECT vec_id // 50 AS id, vec_id % 50 AS pos, round(list_sum(embedding[9:24]::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id % 50 >= 5 AND vec_id % 50 < 41 AND vec_id // 50 <> 3")
def scan_npy_range(spark, d):
    """Rows by a filter on the position that the source takes over, columns 8 to 23, partitions of eight rows; a part is opened only if its rows are asked for."""
    m = M.matrices(spark, recordings(spark, d), columns="8:24", split=8 * 64 * 8).where("pos >= 5 AND pos < 41 AND identifier <> '3'")
    return m.select(F.col("identifier").cast("long").alias("id"), "pos", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("WITH m AS (SELECT c_custkey AS id, c_custkey % 7 AS s, 20 + c_custkey % 25 AS e, c_mktsegment AS g FROM customer WHERE c_acctbal > 0) SELECT m.id, m.g AS label, count(*) AS n, min(vec_id % 50) AS first, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total FROM embeddings JOIN m ON m.id = vec_id // 50 AND vec_id % 50 >= m.s AND vec_id % 50 < m.e GROUP BY m.id, m.g")
def source_dataset_items(spark, d):
    """Items of a dataset, as a loader gives them: the inputs of a recording, cropped to its own test bounds while they are read, its label and its id."""
    at = recordings(spark, d)
    meta = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 7).alias("s"), (20 + F.col("c_custkey") % 25).alias("e"))
    items = M.items(spark, at, meta.withColumn("identifier", F.col("id").cast("string")))
    return items.select("id", "label", F.size("inputs").cast("long").alias("n"), "first", F.round(F.aggregate("inputs", F.lit(0.0), lambda s, r: s + F.aggregate(r, F.lit(0.0), lambda a, x: a + x)), 5).alias("total"))


def saved_twice(spark, d, form):
    """A table saved over another, which is kept beside it under a dated name; both read back."""
    at = folder(spark, "dated")
    n = table(spark, d, "nation")
    T.save(n.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")), at, form=form, dated="20240101")
    T.save(n.select("n_nationkey", "n_name"), at, form=form, dated="20240102")
    read = lambda path, v: getattr(spark.read.schema("n_nationkey long, n_name string").options(header=True), form)(path).select(F.lit(v).alias("version"), "n_nationkey", "n_name")
    return read(at, "now").unionByName(read(f"{at}_20240102", "before"))


SAVED = "SELECT 'now' AS version, n_nationkey, n_name FROM nation UNION ALL SELECT 'before', n_nationkey, upper(n_name) || '!' FROM nation WHERE n_nationkey % 2 = 0"


@query(SAVED)
def sink_csv_dated(spark, d):
    """sink.csv: delimited files with a header."""
    return saved_twice(spark, d, "csv")


@query(SAVED)
def sink_json_dated(spark, d):
    """sink.json: one object a line."""
    return saved_twice(spark, d, "json")
