"""Domain files, hands, projections, baselines and pipeline state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import consolidation as O
from loomspan.operators import detection as D
from loomspan.operators import joins as J
from loomspan.operators import sequences as S
from loomspan.functions import vectors as V
from loomspan.plans.inventory import folder
from loomspan.plans.measures import greedy_sql
from loomspan.plans.registry import query
from loomspan.plans.relational import RUN, SEQ, rnd
from loomspan.plans.vector import KK, VEC, kk, prototypes
from loomspan.sources import files as X
from loomspan.sources import tables as T
from loomspan.sources.tables import blocks, sequences, table


@dataclass(frozen=True)
class Settings:
    """Constants of the domain; asdict and the constructor are the JSON round trip."""

    block_length: int = 16
    block_step: int = 8
    noise: int = -1
    edge: int = -2
    unmapped: int = -3
    dimensions: int = 1408

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in asdict(self).items()], "name string, value string")


@query("SELECT 'block_length' AS name, '16' AS value UNION ALL SELECT 'block_step', '8' UNION ALL SELECT 'noise', '-1' UNION ALL SELECT 'edge', '-2' UNION ALL SELECT 'unmapped', '-3' UNION ALL SELECT 'dimensions', '1408'")
def registry_config(spark, d):
    return Settings(**asdict(Settings())).row(spark)


@query("SELECT conv_id::VARCHAR AS identifier, turn::BIGINT AS seg, text, turn::DOUBLE AS start, role AS speaker FROM conversations")
def scan_json_speech(spark, d):
    """Conversations written as speech JSON and read back: one row for each segment."""
    seg = F.struct("text", F.col("turn").cast("double").alias("start"), F.array(F.struct(F.col("role").alias("speaker"))).alias("words"))
    raw = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s"))))["s"].alias("segments"))
    out = T.speech_segments(raw.select(F.col("conv_id").cast("string").alias("identifier"), F.to_json(F.struct("segments")).alias("json")))
    return out.select("identifier", F.col("start").cast("long").alias("seg"), "text", "start", F.col("speakers")[0].alias("speaker"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unprocessed' WHEN l.quality = 1 THEN 'success' WHEN l.quality = 0 THEN 'failure' ELSE 'disabled' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def scan_state_flags(spark, d):
    out = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", F.when(F.col("there").isNull(), "unprocessed").when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure").otherwise("disabled").alias("state"))


@query("SELECT p_brand AS config, p_type AS cluster_type, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS clusters FROM part GROUP BY ALL")
def scan_pigeon_annotations(spark, d):
    out = table(spark, d, "part").groupBy(F.col("p_brand").alias("config"), F.col("p_type").alias("cluster_type")).agg(F.array_sort(F.collect_list("p_partkey")).alias("c"))
    return out.select("config", "cluster_type", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("clusters"))


HANDS = "h AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label % 2 = 0 THEN 'Left' ELSE 'Right' END AS side FROM embeddings), q AS (SELECT vec_id, side, generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM h)"


@query(f"WITH {HANDS} SELECT vec_id, side, round(avg(x) FILTER (k % 3 = 0), 6) AS x, round(avg(x) FILTER (k % 3 = 1), 6) AS y, round(avg(x) FILTER (k % 3 = 2), 6) AS z FROM q WHERE k < 63 GROUP BY ALL")
def agg_hand_barycenter(spark, d):
    """scan.json_landmarks and agg.hand_barycenter: 63 components as the 21 points of a hand."""
    point = lambda i: F.struct(*(F.get("v", i * 3 + k).alias(n) for k, n in enumerate("xyz")))
    hand = F.array(F.transform(F.sequence(F.lit(0), F.lit(20)), point))
    side = F.array(F.array(F.struct(F.when(F.col("label") % 2 == 0, "Left").otherwise("Right").alias("category_name"), F.lit("").alias("display_name"), F.lit(1.0).alias("score"))))
    raw = blocks(spark, d).select(F.col("pos").cast("string").alias("identifier"), F.array(F.struct(side.alias("handedness"), hand.alias("hand_landmarks"))).alias("frames"))
    out = T.hand_frames(raw).where("detected")
    mean = lambda k: rnd(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[k]) / F.size("points"))
    return out.select(F.col("identifier").cast("long").alias("vec_id"), "side", mean(0).alias("x"), mean(1).alias("y"), mean(2).alias("z"))


@query(f"WITH {RUN} SELECT r.id, r.s, r.e - 1 AS last, round(max(CASE WHEN s.pos = r.s THEN s.value END), 4) AS score FROM r JOIN s ON s.id = r.id AND s.pos >= r.s AND s.pos < r.e WHERE r.label IN (0, 4) GROUP BY r.id, r.s, r.e")
def win_hand_segments_scored(spark, d):
    """Islands with the score at their start."""
    new = F.when(F.col("label") == F.lag("label").over(S.by()), 0).otherwise(1)
    g = sequences(spark, d).withColumn("new", new).withColumn("seg", F.sum("new").over(S.by())).where("label IN (0, 4)")
    return g.groupBy("id", "seg").agg(F.min("pos").alias("s"), F.max("pos").alias("last"), rnd(F.min_by("value", "pos"), 4).alias("score")).drop("seg")


@query(f"WITH {SEQ}, a AS (SELECT id, pos, label, value, CASE WHEN label = 4 AND lag(label) OVER w = 4 THEN 1 ELSE 0 END AS two, lag(value) OVER w AS before FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id, pos, CASE WHEN two = 1 AND value < before THEN 3 ELSE label END AS label FROM a")
def win_handedness_switch(spark, d):
    """Of two neighbours of one side the lower score is relabelled."""
    same = (F.col("label") == 4) & (F.lag("label").over(S.by()) == 4) & (F.col("value") < F.lag("value").over(S.by()))
    return sequences(spark, d).select("id", "pos", F.when(same, 3).otherwise(F.col("label")).cast("long").alias("label"))


@query()
def sample_random_pairs(spark, d):
    """Median cosine distance of blocks paired by a seeded shuffle."""
    b = blocks(spark, d).select("pos", "v").withColumn("h", F.xxhash64("pos", F.lit(47)))
    w = W.partitionBy(F.pmod("h", F.lit(64))).orderBy("h")
    p = b.withColumn("u", F.lead("v").over(w)).where("u IS NOT NULL")
    return p.agg(F.median(1 - V.cosine("v", "u")).alias("median"))


@query(f"WITH {VEC}, k AS (SELECT b.pos, p.proto, exp(list_cosine_similarity(b.v, p.c) / 0.5e0) AS w FROM b, p) SELECT pos, proto, round(w / sum(w) OVER (PARTITION BY pos), 6) AS share FROM k")
def dist_projection(spark, d):
    """Kernel weights of each block on all prototypes, normalised in place: the codebook is one row beside each block, nothing is shuffled."""
    both = blocks(spark, d).select("pos", "v").crossJoin(J.codebook(prototypes(spark, d)))
    w = both.select("pos", F.transform("book", lambda p: F.struct(p["proto"].alias("proto"), F.exp(V.cosine("v", p["c"]) / 0.5).alias("w"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["w"])
    return w.select("pos", total.alias("total"), F.explode("w").alias("w")).select("pos", "w.proto", rnd(F.col("w.w") / F.col("total")).alias("share"))


@query(f"WITH {VEC}, k AS (SELECT b.pos, p.proto, abs(list_cosine_similarity(b.v, p.c)) AS w FROM b, p), n AS (SELECT pos, proto, w / sqrt(sum(w * w) OVER (PARTITION BY pos)) AS u FROM k), m AS (SELECT proto, sqrt(sum(u * u)) AS l FROM n GROUP BY proto) SELECT n.pos, n.proto, round(u / l, 6) AS x FROM n JOIN m ON m.proto = n.proto")
def dist_projection_conormal(spark, d):
    """Projections made of unit length over the prototypes of a block, then over the blocks of a prototype."""
    both = blocks(spark, d).select("pos", "v").crossJoin(J.codebook(prototypes(spark, d)))
    w = both.select("pos", F.transform("book", lambda p: F.struct(p["proto"].alias("proto"), F.abs(V.cosine("v", p["c"])).alias("w"))).alias("w"))
    size = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    u = w.select("pos", size.alias("size"), F.explode("w").alias("w")).select("pos", "w.proto", (F.col("w.w") / F.col("size")).alias("u"))
    m = u.groupBy("proto").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("l"))
    return u.join(F.broadcast(m), "proto").select("pos", "proto", rnd(F.col("u") / F.col("l")).alias("x"))


@query()
def dist_projection_orthonormal(spark, d):
    """Coordinates of blocks on the prototypes after QR; the K x D basis goes with the function."""
    q, _ = np.linalg.qr(np.stack([np.asarray(r["c"]) for r in prototypes(spark, d).orderBy("proto").collect()]).T)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"]) @ q if len(f) else np.zeros((0, q.shape[1]))
            yield pd.DataFrame({"pos": f["pos"], "z": list(x), "proto": np.abs(x).argmax(1)})

    return blocks(spark, d).select("pos", "v").mapInPandas(run, "pos long, z array<double>, proto long")


#: Runs of two classes of labels as truths; of each a detection that ends late, and of every second one that begins early.
DETECTED = SEQ + ", h0 AS (SELECT id, pos, label // 3 AS label, CASE WHEN label // 3 = lag(label // 3) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM s), h1 AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS seg FROM h0), g AS (SELECT id, seg, min(label) AS label, min(pos) AS s, max(pos) + 1 AS e FROM h1 GROUP BY id, seg), p AS (SELECT id, label, 2 * seg AS seg, s, e + 1 AS e, (e - s)::DOUBLE / (e - s + 1 + seg % 3) AS score FROM g UNION ALL SELECT id, label, 2 * seg + 1, s - 1, e, (e - s)::DOUBLE / (e - s + seg % 5) FROM g WHERE seg % 2 = 0)"


@query(f"WITH RECURSIVE {DETECTED}, {greedy_sql('p', 'g', 'label')} SELECT label, least, truths, detections, tp, round(ap, 6) AS ap FROM ap")
def eval_map(spark, d):
    """eval.tiou and mAP: average precision of a label at ten overlaps; detections in order of confidence lock the truths they take."""
    g = S.runs(sequences(spark, d).withColumn("label", F.floor(F.col("label") / 3)))
    n = F.col("e") - F.col("s")
    late = g.select("id", "label", (2 * F.col("seg")).alias("seg"), "s", (F.col("e") + 1).alias("e"), (n / (n + 1 + F.col("seg") % 3)).alias("score"))
    early = g.where("seg % 2 = 0").select("id", "label", (2 * F.col("seg") + 1).alias("seg"), (F.col("s") - 1).alias("s"), "e", (n / (n + F.col("seg") % 5)).alias("score"))
    return D.average_precision(late.unionByName(early), g, ["id", "label"], 4, ["label"]).select("label", "least", "truths", "detections", "tp", rnd("ap").alias("ap"))


@query(f"WITH {SEQ}, c AS (SELECT c_mktsegment AS g, pos, label, count(*) AS n FROM s JOIN customer ON c_custkey = id GROUP BY ALL) SELECT g, pos, label, n FROM c QUALIFY row_number() OVER (PARTITION BY g, pos ORDER BY n DESC, label) = 1")
def baseline_majority_lockstep(spark, d):
    """The commonest symbol at each place of a group."""
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    c = sequences(spark, d).join(seg, "id").groupBy("g", "pos", "label").agg(F.count("*").alias("n"))
    return c.groupBy("g", "pos").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("g", "pos", (-F.col("b.l")).alias("label"), "b.n")


@query()
def baseline_medoid(spark, d):
    """The member of least total warping distance in each group."""
    from loomspan.operators.alignment import totals
    from loomspan.plans.kernels import COSTS, cohort

    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    total = totals(cohort(spark, d).join(seg, "id").select("g", "id", "q"), COSTS)
    return total.groupBy("g").agg(F.min(F.struct(F.round("total", 6).alias("total"), "a")).alias("b")).select("g", F.col("b.a").alias("medoid"), "b.total")


@query(f"WITH {SEQ}, w AS (SELECT c_mktsegment AS g, id, label, avg(pos) AS m, count(*) AS n FROM s JOIN customer ON c_custkey = id GROUP BY ALL) SELECT g, label, round(avg(m), 5) AS centre, round(avg(n), 5) AS mass FROM w GROUP BY ALL")
def baseline_wasserstein_barycenter(spark, d):
    """Barycentre of one-dimensional time distributions: means of means and masses of each symbol."""
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    w = sequences(spark, d).join(seg, "id").groupBy("g", "id", "label").agg(F.avg("pos").alias("m"), F.count("*").alias("n"))
    return w.groupBy("g", "label").agg(rnd(F.avg("m"), 5).alias("centre"), rnd(F.avg("n"), 5).alias("mass"))


CAMERAS = "['GoPro1', 'GoPro2', 'GoPro3', 'Tobii']"
RECORDED = f"o AS (SELECT o_custkey AS c, o_custkey::VARCHAR AS participant_id, CASE WHEN o_orderpriority < '3' THEN 'cuisine' ELSE 'lego' END AS task_name, {CAMERAS}[o_orderkey % 4 + 1] AS modality, o_orderkey::VARCHAR AS video_name, CASE WHEN o_orderstatus = 'F' THEN 'hand/' || o_orderkey END AS hand_path, CASE WHEN o_orderkey % 5 = 0 THEN 'speech/' || o_orderkey END AS speech_path FROM orders), rec AS (SELECT *, participant_id || '_' || task_name || '_' || modality || '_' || video_name AS identifier FROM o), res AS (SELECT c_custkey::VARCHAR AS participant_id, t.task_name, {CAMERAS}[m + 1] AS folder_modality, {CAMERAS}[CASE WHEN c_custkey % 5 = 0 THEN (m + 1) % 4 ELSE m END + 1] AS true_modality, c_custkey % 5 = 0 AS swapped, (c_custkey % 11 = 0 AND m = 1) OR (c_custkey % 13 = 0 AND m = 2) AS failed FROM customer, range(4) r(m), (VALUES ('cuisine'), ('lego')) t(task_name) WHERE (c_custkey + m) % 3 <> 0)"


def recorded(spark, d):
    """(recordings, inspection results): orders as videos of customers by four cameras, two thirds of the cameras looked at."""
    names = F.array(*map(F.lit, ("GoPro1", "GoPro2", "GoPro3", "Tobii")))
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("participant_id"), F.when(F.col("o_orderpriority") < "3", "cuisine").otherwise("lego").alias("task_name"), F.get(names, (key % 4).cast("int")).alias("modality"), key.cast("string").alias("video_name"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("hand/"), key.cast("string"))).alias("hand_path"), F.when(key % 5 == 0, F.concat(F.lit("speech/"), key.cast("string"))).alias("speech_path"),
    )
    rows = rows.withColumn("identifier", F.concat_ws("_", "participant_id", "task_name", "modality", "video_name"))
    c, m = F.col("c_custkey"), F.col("m")
    seen = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).where((c + m) % 3 != 0).withColumn("task_name", F.explode(F.array(F.lit("cuisine"), F.lit("lego"))))
    flag = lambda x, name: F.when(x, 1).otherwise(0).alias(name)
    results = seen.select(
        c.cast("string").alias("participant_id"), "task_name", F.get(names, m).alias("folder_modality"), F.get(names, F.when(c % 5 == 0, (m + 1) % 4).otherwise(m)).alias("true_modality"), (c % 5 == 0).alias("is_swapped_modality"),
        flag((c % 11 == 0) & (m == 1), "GP2_above"), flag((c % 13 == 0) & (m == 2), "is_middle_range"), F.lit(0).alias("GP2_is_wrong_buttress"), F.lit(0).alias("GoPro1_is_wrong_buttress"),
    )
    return rows, results


FEATURES = {"flag_hand": ("hand_path", ("GoPro1", "GoPro3")), "flag_speech": ("speech_path", ("GoPro1", "GoPro2", "GoPro3"))}


@query(f"WITH {RECORDED}, m AS (SELECT rec.* REPLACE (CASE WHEN res.swapped THEN res.true_modality ELSE rec.modality END AS modality, CASE WHEN res.swapped THEN rec.participant_id || '_' || rec.task_name || '_' || res.true_modality || '_' || video_name ELSE identifier END AS identifier), rec.modality AS folder_modality, res.participant_id IS NOT NULL AS inspected FROM rec LEFT JOIN res ON res.participant_id = rec.participant_id AND res.task_name = rec.task_name AND res.folder_modality = rec.modality WHERE NOT coalesce(res.failed, false)), a AS (SELECT *, CASE WHEN max((modality = 'GoPro2')::INT) OVER w = 1 THEN 'GoPro1' WHEN max((modality = 'GoPro3')::INT) OVER w = 1 THEN 'GoPro3' END AS audio_modality FROM m WINDOW w AS (PARTITION BY participant_id)) SELECT identifier, modality, folder_modality, audio_modality, inspected, CASE WHEN hand_path IS NOT NULL THEN 'success' WHEN modality IN ('GoPro1', 'GoPro3') THEN 'unprocessed' ELSE 'disabled' END AS flag_hand, CASE WHEN modality = audio_modality THEN CASE WHEN speech_path IS NOT NULL THEN 'success' WHEN modality IN ('GoPro1', 'GoPro2', 'GoPro3') THEN 'unprocessed' ELSE 'disabled' END ELSE 'disabled' END AS flag_speech FROM a")
def ops_qc_apply(spark, d):
    """Inspection merged, failed collections dropped, swapped cameras renamed, flags and the audio camera set again."""
    out = O.apply_inspection(*recorded(spark, d), FEATURES)
    return out.select("identifier", "modality", "folder_modality", "audio_modality", "inspected", *FEATURES)


@query(f"WITH {SEQ}, v AS (SELECT id, unnest([0, 1, 2]) AS k FROM (SELECT DISTINCT id FROM s)), n AS (SELECT v.id, k, CASE WHEN k = 2 THEN '.boris' ELSE '.json' END AS tool, count(*) FILTER (CASE k WHEN 0 THEN true WHEN 1 THEN label <> v.id % 5 ELSE (pos + v.id) % 2 = 0 END) AS n FROM v JOIN s ON s.id = v.id WHERE k = 0 AND v.id % 3 <> 0 OR k = 1 AND v.id % 3 <> 1 OR k = 2 AND v.id % 4 <> 3 GROUP BY ALL HAVING n > 0), b AS (SELECT id, k, n FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, k DESC) = 1), l AS (SELECT b.id, b.k, s.label, s.pos FROM b JOIN s ON s.id = b.id AND CASE b.k WHEN 0 THEN true WHEN 1 THEN s.label <> b.id % 5 ELSE (s.pos + b.id) % 2 = 0 END) SELECT id, k AS file, CASE label WHEN 1 THEN 'A10' ELSE ['D1', 'E1', 'B1', 'C1', 'F1'][label + 1] END AS label, CASE label WHEN 1 THEN 'A' ELSE ['D', 'E', 'B', 'C', 'F'][label + 1] END AS category, count(*) AS n FROM l GROUP BY ALL")
def ops_annotation_ingest(spark, d):
    """Annotation files of two tools written for each recording by up to three hands, walked, parsed, chosen by their number of entries, corrected, saved and read back."""
    labels = ("D1", "E1", "B1", "C1", "F1")
    s = sequences(spark, d)
    codes = spark.createDataFrame([(x, x.lower(), i, i, f"category {x[0]}") for i, x in enumerate(labels)], "label string, semantic string, code int, color int, category_label string")
    names = spark.createDataFrame(list(zip(T.SYMBOLS, labels)), "behaviour string, label string")
    listed = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(x).alias("name"), F.lit("#000").alias("color")) for i, x in enumerate(labels)))
    action = F.struct(F.col("pos").cast("double").alias("start"), (F.col("pos") + 0.5).alias("end"), F.col("label").cast("int").alias("action"), F.lit("").alias("description"))
    event = F.array(F.col("pos").cast("string"), F.lit("subject"), F.col("sym"), F.lit(""), F.lit(""))
    kinds = [x for i, sym in enumerate(T.SYMBOLS) for x in (F.lit(str(i)), F.struct(F.lit("Point event").alias("type"), F.lit(sym).alias("code")))]
    media = F.struct(F.create_map(F.lit("a.mp4"), F.lit(25.0)).alias("fps"), F.create_map(F.lit("a.mp4"), F.lit(60.0)).alias("length"))
    entries = lambda k, hold, x: F.array_sort(F.collect_list(F.when(F.expr(hold), F.struct("pos", x.alias("x")))))["x"].alias(f"x{k}")
    lists = s.groupBy("id").agg(entries(0, "id % 3 <> 0", action), entries(1, "id % 3 <> 1 AND label <> id % 5", action), entries(2, "id % 4 <> 3 AND (pos + id) % 2 = 0", event))
    vidat = lambda x: F.to_json(F.struct(F.struct(listed.alias("actionLabelData")).alias("config"), F.struct(F.struct(F.lit(25.0).alias("fps"), F.lit(1500).alias("frames")).alias("video"), F.col(x).alias("actionAnnotationList")).alias("annotation")))
    boris = lambda x: F.to_json(F.struct(F.create_map(F.lit("first"), F.struct(F.col(x).alias("events"), media.alias("media_info"))).alias("observations"), F.create_map(*kinds).alias("behaviors_conf")))
    # a folder a recording, in 256 folders that the walk deals to tasks
    named = lambda k, end: F.concat(F.format_string("%03d/", F.pmod("id", F.lit(256))), F.col("id").cast("string"), F.lit(f"/{k}.{end}"))
    file = lambda k, end, form: F.when(F.size(f"x{k}") > 0, F.struct(named(k, end).alias("path"), form(f"x{k}").alias("text")))
    made = lists.select(F.explode(F.array(file(0, "json", vidat), file(1, "json", vidat), file(2, "boris", boris))).alias("f")).where("f IS NOT NULL")
    at = folder(spark, "annotations")
    X.put(made.select("f.path", "f.text"), at)
    steps = F.split("path", "/")
    files = X.walk(spark, at).select(F.element_at(steps, -2).alias("identifier"), F.array_join(F.slice(steps, -2, 2), "/").alias("path"), X.text(at).alias("json"))
    kept, _ = O.ingest(files, codes, names, ("0.boris",))
    T.save(kept, f"{at}-all")
    out = spark.read.parquet(f"{at}-all")
    return out.groupBy(F.col("identifier").cast("long").alias("id"), F.regexp_extract("path", "/([0-9])", 1).cast("int").alias("file"), "label", "category").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, 'events' AS origin, min(event_id) AS first FROM events GROUP BY user_id ORDER BY user_id")
def ops_state_load(spark, d):
    """State written and read back as Parquet, with where it came from."""
    import uuid

    e = T.dataset(spark, "events", d)
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/state-{uuid.uuid4().hex}"
    T.save(e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first")), folder)
    return spark.read.parquet(folder).withColumn("origin", F.lit("events")).select("user_id", "n", "origin", "first")


@query("SELECT event_id, value * 2 + 1 AS twice, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS side FROM events")
def udf_surface(spark, d):
    """udf.row_scalar and udf.row_multi as one Arrow function that returns a struct."""

    @F.pandas_udf("twice double, side string")
    def f(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"twice": v * 2 + 1, "side": np.where(v > 50, "high", "low")})

    return table(spark, d, "events").select("event_id", f("value").alias("r")).select("event_id", "r.*")


@query("SELECT user_id, round(sqrt(avg(value * value)), 5) AS rms FROM events GROUP BY user_id")
def udaf_group(spark, d):
    """udaf.dict_agg: an aggregate by name, stated natively."""
    how = {"rms": lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))}
    return table(spark, d, "events").groupBy("user_id").agg(*(rnd(f("value"), 5).alias(n) for n, f in how.items()))


@query("SELECT o_orderkey, unnest(range(3)) AS k, o_totalprice FROM orders")
def udtf_expand(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k"), "o_totalprice")
