"""Queries over catalogues: rows of the given tables stand for files and what their headers say, with the SQL that gives
the same sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, metrics, splits
from ..sources import corpora, readers
from .events_queries import _MANIFEST, _ROUND, _SUMMARY, _icc_sql, _manifest, _rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT 'COHFACE_' || o_custkey || '_' || s AS sid, o_custkey::VARCHAR AS subject, fps, n AS n_frames, round(n / fps, 6) AS duration_s, CASE WHEN s < 2 THEN 'lamp' ELSE 'natural' END AS illumination, hdf5 IS NOT NULL AS has_belt
    FROM (SELECT o_custkey, s, CASE WHEN abs(h - 20) < 0.5e0 THEN h ELSE 20e0 END AS fps, n, hdf5 FROM (SELECT o_custkey, o_orderkey % 4 AS s, max(20 + (o_custkey % 5) * 0.2e0) AS h, max(o_orderkey % 500) AS n, max(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS hdf5 FROM orders GROUP BY 1, 2)) WHERE n >= 2""")
def cohface_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat_ws("/", F.lit("/data"), F.col("o_custkey"), F.col("o_orderkey") % 4)
    rows = table(spark, sf_dir, "orders").withColumn("folder", folder)
    videos = rows.select(F.concat("folder", F.lit("/data.avi")).alias("path")).distinct()
    belts = rows.where("o_orderstatus = 'F'").select(F.concat("folder", F.lit("/data.hdf5")).alias("path")).distinct()
    other = rows.select(F.concat(F.lit("/data/notes/"), "o_custkey", F.lit("/data.avi")).alias("path")).distinct()
    probes = rows.groupBy(F.concat("folder", F.lit("/data.avi")).alias("path")).agg(F.max(F.col("o_orderkey") % 500).alias("n_frames"), F.max(20 + (F.col("o_custkey") % 5) * 0.2).alias("fps"))
    out = corpora.cohface(videos.unionByName(belts).unionByName(other), probes)
    return out.select("sid", "subject", "fps", "n_frames", F.round("duration_s", 6).alias("duration_s"), "illumination", F.col("hdf5").isNotNull().alias("has_belt"))


@query("""SELECT 'MAHNOB_' || (o_custkey % 30 + 1) || '_' || o_orderkey AS sid, kind AS trial, round(rate / 2, 6) AS fps, n_src AS n_src_frames, ceil(n_src / 2)::BIGINT AS n_frames, round(span, 6) AS stim_span_s, e AS n_trigger
    FROM (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS kind, rate, span, floor(span * rate)::BIGINT AS n_src, e FROM (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN 60.9708e0 ELSE 50 + o_custkey % 7 END AS rate, o_totalprice / 1000 AS span, o_orderkey % 6 + 2 AS e FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P'))
    WHERE kind IS NOT NULL AND ceil(n_src / 2) >= 2""")
def mahnob_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("folder", F.concat(F.lit("/data/Sessions/"), key))
    kind = F.when(key % 3 == 0, "S").when(key % 3 == 1, "N").otherwise("X")
    bdf = F.concat("folder", F.lit("/Part_1_"), kind, F.lit("_Trial.bdf"))
    videos = F.when(key % 5 == 0, F.array(F.lit("a C1 trigger.avi"), F.lit("b C1 trigger.avi"))).otherwise(F.array(F.lit("a C1 trigger.avi"), F.lit("a BW1.avi")))
    listing = rows.select(F.explode(F.concat(F.transform(videos, lambda v: F.concat("folder", F.lit("/"), v)), F.array(bdf, F.concat("folder", F.lit("/session.xml"))))).alias("path"))
    rate = F.when(F.col("o_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" vidRate='"), (50 + F.col("o_custkey") % 7).cast("string"), F.lit("'")))
    xml = F.concat(F.lit("<session"), rate, F.lit("><subject id='"), (F.col("o_custkey") % 30 + 1).cast("string"), F.lit("'/></session>"))
    people = corpora.parse_session_xml(rows.select("folder", xml.alias("xml")))
    belts = rows.where("o_orderstatus <> 'P'").select(bdf.alias("path"), F.lit(256.0).alias("belt_fs"))
    stimuli = rows.select(bdf.alias("path"), F.lit(0.0).alias("start_s"), (F.col("o_totalprice") / 1000).alias("end_s"), (key % 6 + 2).alias("n_edges"))
    out = corpora.mahnob(listing, people, belts, stimuli)
    return out.select("sid", "trial", F.round("fps", 6).alias("fps"), "n_src_frames", "n_frames", F.round("stim_span_s", 6).alias("stim_span_s"), "n_trigger")


@query("""SELECT 'PURE_' || subject || '_' || task AS sid, n AS n_frames, round(span / 1e6, 6) AS duration_s, round((n - 1) / (span / 1e6), 9) AS fps,
    CASE task WHEN '01' THEN 'steady' WHEN '02' THEN 'talking' WHEN '03' THEN 'slow_translation' WHEN '04' THEN 'fast_translation' WHEN '05' THEN 'small_head_rotation' WHEN '06' THEN 'medium_head_rotation' ELSE 'unknown' END AS task_name, task IN ('03', '04', '05', '06') AS head_motion
    FROM (SELECT lpad((user_id % 100)::VARCHAR, 2, '0') AS subject, lpad((event_id % 9)::VARCHAR, 2, '0') AS task, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events WHERE event_type <> 'error' GROUP BY 1, 2) WHERE n >= 2 AND span > 0""")
def pure_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pure(spark, sf_dir).select("sid", "n_frames", F.round("duration_s", 6).alias("duration_s"), F.round("fps", 9).alias("fps"), "task_name", "head_motion")


def _pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat_ws("-", F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 9).cast("string"), 2, "0"))
    stamp = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    name = F.when(F.col("event_type") == "error", "thumbs.db").otherwise(F.concat(F.lit("Image"), stamp, F.lit(".png")))
    listing = table(spark, sf_dir, "events").select(F.concat_ws("/", F.lit("/data"), folder, folder, name).alias("path"))
    return corpora.pure(listing)


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'DATASET_1' ELSE 'DATASET_2' END AS part, c_custkey % 1500 AS found, c_custkey % 1500 + CASE WHEN c_custkey % 9 = 0 THEN 863 ELSE 0 END AS declared FROM customer)
    SELECT 'UBFC_' || subject || '_' || session AS sid, part, subject, session, found AS n_frames, declared AS n_frames_header, found <> declared AS truncated, round(found / 30e0, 6) AS duration_s
    FROM (SELECT *, CASE WHEN part = 'DATASET_2' THEN 'b' || c_custkey WHEN c_custkey IN (8, 10) THEN 'b42' ELSE 'a' || c_custkey END AS subject, CASE WHEN part = 'DATASET_2' THEN 'd2' WHEN c_custkey IN (8, 10) THEN 'd1gt' || c_custkey ELSE 'd1gt' END AS session FROM v) WHERE found >= 2""")
def ubfc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ubfc(spark, sf_dir).select("sid", "part", "subject", "session", "n_frames", "n_frames_header", "truncated", F.round("duration_s", 6).alias("duration_s"))


def _ubfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    folder = F.when(key % 2 == 0, F.concat(F.lit("/data/DATASET_1/"), key, F.lit("-gt"))).otherwise(F.concat(F.lit("/data/DATASET_2/subject"), key))
    rows = table(spark, sf_dir, "customer").withColumn("video", F.concat(folder, F.lit("/vid.avi")))
    listing = rows.select(F.explode(F.array("video", F.concat(folder, F.lit("/ground_truth.txt")), F.concat(F.lit("/data/DATASET_1/other"), key, F.lit("/vid.avi")))).alias("path"))
    found = key % 1500
    headers = rows.select(F.col("video").alias("path"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(30.0).alias("fps"), (found + F.when(key % 9 == 0, 863).otherwise(0)).alias("declared"), found.alias("found"), F.lit(True).alias("bottom_up"))
    return corpora.ubfc(listing, headers)


@query("""SELECT 'VV_g_' || p_partkey || '_' || p_size AS sid, 'g_' || p_partkey AS subject, p_size::VARCHAR AS session, CASE WHEN p_partkey % 2 = 0 THEN 'vv100' ELSE 'vv250' END AS subset, CASE WHEN p_size % 4 = 0 THEN 30e0 ELSE p_size % 4 * 12.5e0 END AS fps, p_partkey % 50 AS n_frames
    FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 50 >= 2""")
def vitalvideo_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    subset = F.when(key % 3 == 0, "other").when(key % 2 == 0, "vv100").otherwise("vv250")
    rows = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("/data/"), subset, F.lit("/g_"), key, F.lit("_"), F.col("p_size"), F.lit(".mp4")))
    probes = rows.select("path", (key % 50).alias("n_frames"), (F.col("p_size") % 4 * 12.5).alias("fps"))
    return corpora.vitalvideo(rows.select("path"), probes, ("vv100", "vv250")).select("sid", "subject", "session", "subset", "fps", "n_frames")


# ---- runs, evaluation sets and the manifest

_PREDS = """SELECT 'run' || (l_linenumber % 3) AS run, l_orderkey AS sid, CASE WHEN l_tax = 0 THEN 'NaN'::DOUBLE ELSE l_quantity + 100e0 * l_tax END AS bpm FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS p FROM lineitem) WHERE p = 1 AND l_orderkey % 11 <> 0"""
_RECORDS = """SELECT o_orderkey AS sid, CASE WHEN o_custkey % 2 = 0 THEN 'mahnob' ELSE 'pure' END AS dataset, o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' END AS trial, o_custkey % 4 > 1 AS head_motion, CASE WHEN o_totalprice > 50000 THEN o_totalprice / 10000 END AS gt_rr FROM orders WHERE o_orderkey % 13 <> 0"""
_SETS = """SELECT 'run' || r AS run, CASE WHEN o_custkey % 2 = 0 THEN 'mahnob' ELSE 'pure' END AS dataset, s AS subset, o_orderkey AS sid FROM orders, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest(['all', 'test']) AS s) WHERE s = 'all' OR o_custkey % 5 = 0
    UNION ALL SELECT 'run9', 'mahnob', 'all', -1"""
_JOINED = f"SELECT e.run, e.dataset, e.subset, m.dataset || ':' || m.subject AS person, CASE e.dataset WHEN 'mahnob' THEN trial WHEN 'pure' THEN head_motion::VARCHAR END AS grp, p.bpm AS pred, m.gt_rr AS ref FROM ({_SETS}) e JOIN ({_PREDS}) p USING (run, sid) JOIN ({_RECORDS}) m USING (sid) WHERE NOT isnan(p.bpm) AND m.gt_rr IS NOT NULL"


def _run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    run = F.concat(F.lit("run"), F.col("l_linenumber") % 3)
    first = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 <> 0").withColumn("place", first).where("place = 1")
    bpm = F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_quantity") + 100 * F.col("l_tax"))
    preds = lines.select(run.alias("run"), F.col("l_orderkey").alias("sid"), bpm.alias("bpm"))
    dataset = F.when(F.col("o_custkey") % 2 == 0, "mahnob").otherwise("pure")
    orders = table(spark, sf_dir, "orders").withColumn("dataset", dataset)
    trial = F.when(F.col("o_orderkey") % 3 == 0, "N").when(F.col("o_orderkey") % 3 == 1, "S")
    records = orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("sid"), "dataset", F.col("o_custkey").alias("subject"), trial.alias("trial"), (F.col("o_custkey") % 4 > 1).alias("head_motion"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice") / 10000).alias("gt_rr"))
    subset = F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("all"), F.lit("test"))).otherwise(F.array(F.lit("all")))
    runs = F.array(*[F.lit(f"run{k}") for k in range(3)])
    sets = orders.select(F.explode(runs).alias("run"), "dataset", "o_orderkey", subset.alias("subset")).select("run", "dataset", F.explode("subset").alias("subset"), F.col("o_orderkey").alias("sid"))
    nobody = orders.limit(1).select(F.lit("run9").alias("run"), F.lit("mahnob").alias("dataset"), F.lit("all").alias("subset"), F.lit(-1).cast("long").alias("sid"))
    return preds, sets.unionByName(nobody), records


@query(f"""WITH j AS ({_JOINED}), c AS (SELECT DISTINCT run, dataset, subset FROM ({_SETS})), s AS ({_SUMMARY.format(by="run, dataset, subset", source="SELECT * FROM j")}), i AS ({_icc_sql("SELECT * FROM j", "run, dataset, subset", "person", "pred")}), g AS ({_icc_sql("SELECT * FROM j", "run, dataset, subset", "person", "ref")})
    SELECT c.run, c.dataset, c.subset, coalesce(n, 0) AS n, coalesce(subjects, 0) AS subjects, {_ROUND}, round(coalesce(i.icc, 'NaN'::DOUBLE), 6) AS icc, round(coalesce(g.icc, 'NaN'::DOUBLE), 6) AS icc_ref
    FROM c LEFT JOIN s USING (run, dataset, subset) LEFT JOIN i USING (run, dataset, subset) LEFT JOIN g USING (run, dataset, subset)""")
def run_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_cells(*_run_tables(spark, sf_dir))
    return _rounded(out.withColumns({k: F.coalesce(k, F.lit(float("nan"))) for k in ("icc", "icc_ref")}), "mae rmse pearson mae_debiased rmse_debiased pred_mean pred_std ref_mean ref_std bias icc icc_ref")


@query(f"""WITH j AS ({_JOINED}), v AS (SELECT run, dataset, subset, count(DISTINCT CASE e.dataset WHEN 'mahnob' THEN trial WHEN 'pure' THEN head_motion::VARCHAR END) AS kinds FROM ({_SETS}) e JOIN (SELECT sid, trial, head_motion FROM ({_RECORDS})) USING (sid) GROUP BY 1, 2, 3)
    SELECT run, dataset, subset, CASE dataset WHEN 'mahnob' THEN 'trial=' ELSE 'head_motion=' END || grp AS grp, count(*) AS n, round(avg(abs(pred - ref)), 6) AS mae, round(avg(pred - ref), 6) AS bias FROM j JOIN v USING (run, dataset, subset) WHERE grp IS NOT NULL AND kinds >= 2 GROUP BY 1, 2, 3, 4""")
def run_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_subgroups(*_run_tables(spark, sf_dir))
    return _rounded(out.select("run", "dataset", "subset", "grp", "n", "mae", "bias"), "mae bias")


_WORK = """SELECT o_orderkey AS sid, o_orderkey % 7 = 0 AS stored, CASE WHEN o_orderkey % 11 = 0 THEN 'OSError: unreadable' END AS error, o_custkey % 40 AS n_frames, CASE WHEN o_custkey % 6 <> 0 THEN (o_custkey % 200)::INT END AS side, CASE WHEN o_custkey % 9 <> 0 THEN (o_orderkey % 400)::INT END AS "T" FROM orders"""


@query(f"""SELECT sid, CASE WHEN error IS NOT NULL AND NOT stored THEN 'error' WHEN stored THEN 'cached' WHEN n_frames < 2 OR side IS NULL OR side < 32 OR "T" IS NULL OR "T" < 150 THEN 'skip' ELSE 'ok' END AS status,
    CASE WHEN stored THEN NULL WHEN error IS NOT NULL THEN error WHEN n_frames < 2 THEN 'no_frames' WHEN side IS NULL THEN 'no_face' WHEN side < 32 THEN 'box_too_small' WHEN "T" IS NULL THEN 'no_flow' WHEN "T" < 150 THEN 'too_short' END AS reason FROM ({_WORK})""")
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("sid"), (key % 7 == 0).alias("stored"), F.when(key % 11 == 0, "OSError: unreadable").alias("error"), (person % 40).alias("n_frames"),
        F.when(person % 6 != 0, (person % 200).cast("int")).alias("side"), F.when(person % 9 != 0, (key % 400).cast("int")).alias("T"),
    )
    return catalog.with_status(rows).select("sid", "status", "reason")


_BUILT = f"SELECT *, dataset || ':' || subject AS person FROM ({_MANIFEST}) WHERE status IN ('ok', 'cached') AND NOT (dataset = 'mahnob' AND trial IS NOT DISTINCT FROM 'N')"


@query(f"""WITH u AS ({_BUILT}), r AS (SELECT subject, row_number() OVER (ORDER BY md5('42:' || subject), subject::VARCHAR) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM u WHERE dataset = 'mahnob')),
    t AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(0.2e0 * n, 0), n - 2)) ELSE 0 END AS test FROM r), p AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(0.1e0 * n, 0), n - test - 1)) ELSE 0 END AS val FROM t)
    SELECT dataset, 'all' AS part, count(*) AS sessions, count(DISTINCT subject) AS subjects, count(CASE WHEN dataset <> 'pure' THEN gt_rr END) AS n_with_gt, CASE WHEN dataset = 'pure' THEN 'training-only' ELSE 'labelled' END AS role FROM u GROUP BY 1
    UNION ALL SELECT 'mahnob', CASE WHEN place < test THEN 'test' WHEN place < test + val THEN 'val' ELSE 'train' END, count(*), count(DISTINCT subject), count(gt_rr), 'labelled' FROM u JOIN p USING (subject) WHERE dataset = 'mahnob' GROUP BY 2""")
def split_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir)
    return splits.build_report(splits.build(manifest, train_only=("pure",), variant="sonly"), manifest, ("pure",))


@query(f"""SELECT 'UBFC_' || CASE WHEN c_custkey % 2 = 1 THEN 'b' || c_custkey WHEN c_custkey IN (8, 10) THEN 'b42' ELSE 'a' || c_custkey END || '_' || CASE WHEN c_custkey % 2 = 1 THEN 'd2' WHEN c_custkey IN (8, 10) THEN 'd1gt' || c_custkey ELSE 'd1gt' END AS sid, 'ubfc' AS dataset, 30e0 AS fps_src, CASE WHEN c_custkey % 2 = 0 THEN 'DATASET_1' ELSE 'DATASET_2' END AS part, NULL::VARCHAR AS task_name, NULL::VARCHAR AS head_motion FROM customer WHERE c_custkey % 1500 >= 2
    UNION ALL SELECT 'PURE_' || subject || '_' || task, 'pure', round((n - 1) / (span / 1e6), 6), NULL, CASE task WHEN '01' THEN 'steady' WHEN '02' THEN 'talking' WHEN '03' THEN 'slow_translation' WHEN '04' THEN 'fast_translation' WHEN '05' THEN 'small_head_rotation' WHEN '06' THEN 'medium_head_rotation' ELSE 'unknown' END, (task IN ('03', '04', '05', '06'))::VARCHAR
    FROM (SELECT lpad((user_id % 100)::VARCHAR, 2, '0') AS subject, lpad((event_id % 9)::VARCHAR, 2, '0') AS task, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events WHERE event_type <> 'error' GROUP BY 1, 2) WHERE n >= 2 AND span > 0""")
def manifest_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.manifest_rows(_ubfc(spark, sf_dir)).unionByName(readers.manifest_rows(_pure(spark, sf_dir)))
    return rows.select("sid", "dataset", F.round("fps_src", 6).alias("fps_src"), "part", "task_name", F.col("head_motion").cast("string").alias("head_motion"))
