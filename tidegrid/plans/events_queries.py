"""Queries over events, orders and the other relational tables, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, maps, metrics, references, spectral, splits, timeseries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- predictions and references: line items stand for sessions, suppliers for persons


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("subset"), F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("trial"),
        (F.col("l_quantity") + 100 * F.col("l_tax")).alias("pred"), (F.col("l_quantity") + 100 * F.col("l_discount")).alias("ref"),
    )


_PAIRS = "SELECT l_returnflag AS dataset, l_linestatus AS subset, l_suppkey AS person, l_linenumber AS trial, l_quantity + 100e0 * l_tax AS pred, l_quantity + 100e0 * l_discount AS ref FROM lineitem"


def _rounded(rows: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns.split()})


def _icc_sql(source: str, by: str, person: str, value: str) -> str:
    return f"""SELECT {by}, (msb - msw) / (msb + (k0 - 1) * msw + 1e-12) AS icc FROM (
    SELECT {by}, any_value(k) AS n_k, any_value(ssb) / (any_value(k) - 1) AS msb, any_value(ssw) / (any_value(total) - any_value(k)) AS msw, (any_value(total) - any_value(sq) / any_value(total)) / (any_value(k) - 1) AS k0
    FROM (SELECT {by}, count(*) OVER g AS k, sum(n) OVER g AS total, sum(n * n) OVER g AS sq, sum(n * v) OVER g AS ssw, sum(n * (m - grand) * (m - grand)) OVER g AS ssb
        FROM (SELECT *, sum(n * m) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by}) AS grand FROM (
            SELECT {by}, {person}, count(*)::DOUBLE AS n, avg({value}) AS m, var_pop({value}) AS v FROM ({source}) GROUP BY {by}, {person} HAVING count(*) >= 2))
        WINDOW g AS (PARTITION BY {by})) GROUP BY {by}) WHERE n_k >= 2"""


_SUMMARY = """SELECT {by}, count(*) AS n, count(DISTINCT person) AS subjects, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
    CASE WHEN stddev_pop(pred) * stddev_pop(ref) > 0 THEN covar_pop(pred, ref) / (stddev_pop(pred) * stddev_pop(ref)) ELSE 'NaN'::DOUBLE END AS pearson,
    avg(abs(d)) AS mae_debiased, sqrt(avg(d * d)) AS rmse_debiased, avg(pred) AS pred_mean, stddev_pop(pred) AS pred_std, avg(ref) AS ref_mean, stddev_pop(ref) AS ref_std, avg(e) AS bias
    FROM (SELECT *, e - avg(e) OVER (PARTITION BY {by}) AS d FROM (SELECT *, pred - ref AS e FROM ({source}))) GROUP BY {by}"""
_METRICS = "mae rmse pearson mae_debiased rmse_debiased pred_mean pred_std ref_mean ref_std bias"
_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS.split())


@query(f"""SELECT s.dataset, s.subset, n, subjects, {_ROUND}, round(p.icc, 6) AS icc, round(r.icc, 6) AS icc_ref
FROM ({_SUMMARY.format(by="dataset, subset", source=_PAIRS)}) s
JOIN ({_icc_sql(_PAIRS, "dataset, subset", "person", "pred")}) p USING (dataset, subset) JOIN ({_icc_sql(_PAIRS, "dataset, subset", "person", "ref")}) r USING (dataset, subset)""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.evaluate(_pairs(spark, sf_dir), ["dataset", "subset"]), _METRICS + " icc icc_ref")


@query(f"SELECT dataset, round(pearson, 6) AS pearson, n FROM ({_SUMMARY.format(by='dataset', source=_PAIRS)})")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.eligible(_pairs(spark, sf_dir))
    return _rounded(rows.groupBy("dataset").agg(metrics.pearson("pred", "ref").alias("pearson"), F.count("*").alias("n")), "pearson")


@query(f"SELECT subset, round(mae_debiased, 6) AS mae_debiased, round(rmse_debiased, 6) AS rmse_debiased, round(bias, 6) AS bias FROM ({_SUMMARY.format(by='subset', source=_PAIRS)})")
def debiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summary(_pairs(spark, sf_dir), ["subset"], "person"), "mae_debiased rmse_debiased bias").select("subset", "mae_debiased", "rmse_debiased", "bias")


@query(f"SELECT event_type, round(icc, 6) AS icc FROM ({_icc_sql('SELECT * FROM events', 'event_type', 'user_id', 'value')})")
def icc11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.icc11(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value"), "icc")


@query(f"SELECT dataset, round(icc, 6) AS icc_ref FROM ({_icc_sql(_PAIRS, 'dataset', 'person', 'ref')})")
def icc_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.icc11(_pairs(spark, sf_dir), ["dataset"], "person", "ref").withColumnRenamed("icc", "icc_ref"), "icc_ref")


@query(f"""SELECT dataset, subset, trial, g.whole::INT AS whole, n, round(mae, 6) AS mae FROM (
    SELECT dataset, subset, trial, grouping(trial) AS whole, count(*) AS n, avg(abs(pred - ref)) AS mae FROM ({_PAIRS}) GROUP BY GROUPING SETS ((dataset, subset), (dataset, subset, trial))) g
    JOIN (SELECT dataset, subset, count(DISTINCT trial) AS kinds FROM ({_PAIRS}) GROUP BY ALL) k USING (dataset, subset) WHERE g.whole = 1 OR kinds >= 2""")
def cells_and_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.cells_and_subgroups(_pairs(spark, sf_dir), ["dataset", "subset"], "trial")
    return _rounded(rows.withColumn("whole", F.col("whole").cast("int")), "mae")


@query(f"SELECT dataset, subset, count(*) AS n, round(regr_slope(pred, ref), 6) AS slope, round(regr_intercept(pred, ref), 6) AS intercept FROM ({_PAIRS}) GROUP BY ALL HAVING count(*) > 1")
def scatter_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.line_fit(_pairs(spark, sf_dir), ["dataset", "subset"]), "slope intercept")


@query("SELECT o_orderpriority, count(*) AS n_seeds, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.seed_spread(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice"), "mean sd", 4)


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best_epoch, min(o_totalprice) AS best_loss FROM orders GROUP BY 1""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_checkpoint(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS mean_loss, count(*) AS steps FROM orders GROUP BY 1")
def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.epoch_means(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice"), "mean_loss")


@query(f"""SELECT dataset, subset, trial, coalesce(n, 0) AS n, coalesce(subjects, 0) AS subjects, round(mae, 6) AS mae FROM (SELECT DISTINCT dataset, subset, trial FROM ({_PAIRS}))
    LEFT JOIN (SELECT dataset, subset, trial, count(*) AS n, count(DISTINCT person) AS subjects, avg(abs(pred - ref)) AS mae FROM ({_PAIRS}) WHERE ref <= 50 GROUP BY ALL) USING (dataset, subset, trial)""")
def complete_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, by = _pairs(spark, sf_dir), ["dataset", "subset", "trial"]
    out = metrics.complete(metrics.summary(pairs.withColumn("ref", F.when(F.col("ref") <= 50, F.col("ref"))), by, "person"), pairs, by)
    return _rounded(out.select("dataset", "subset", "trial", "n", "subjects", "mae"), "mae")


# ---- catalogue and manifest: orders stand for manifest records


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "cached").otherwise("skip")
    trial = F.when(F.col("o_orderkey") % 3 == 0, "N").when(F.col("o_orderkey") % 3 == 1, "S")
    dataset = F.when(F.col("o_custkey") % 2 == 0, "mahnob").otherwise("pure")
    gt = F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), dataset.alias("dataset"), F.col("o_custkey").alias("subject"), status.alias("status"), trial.alias("trial"), gt.alias("gt_rr"), (F.col("o_orderkey") % 1000).cast("int").alias("T"))


_MANIFEST = """SELECT o_orderkey AS sid, CASE WHEN o_custkey % 2 = 0 THEN 'mahnob' ELSE 'pure' END AS dataset, o_custkey AS subject, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'cached' ELSE 'skip' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' END AS trial, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS gt_rr, (o_orderkey % 1000)::INT AS "T" FROM orders"""


@query(f"SELECT sid, dataset, subject FROM ({_MANIFEST}) WHERE status IN ('ok', 'cached') AND dataset = 'mahnob' AND gt_rr IS NOT NULL")
def usable_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.usable(_manifest(spark, sf_dir), "mahnob", True).select("sid", "dataset", "subject")


@query(f"SELECT sid, dataset, trial FROM ({_MANIFEST}) WHERE NOT (dataset = 'mahnob' AND trial IS NOT DISTINCT FROM 'N')")
def variant_sonly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).where(catalog.variant_keep("sonly")).select("sid", "dataset", "trial")


@query(f"SELECT sid, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sid) AS p FROM ({_MANIFEST})) WHERE p <= 25")
def top_n_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_per_group(_manifest(spark, sf_dir), "dataset", "sid", 25).select("sid", "dataset")


@query(f"SELECT sid, status FROM ({_MANIFEST}) WHERE status NOT IN ('ok', 'cached') OR trial IS NULL")
def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir)
    return catalog.retry_selection(rows, rows.where("trial is not null")).select("sid", "status")


@query(f"""SELECT sid, status, NULL::DOUBLE AS gt_rr, 'new' AS note FROM ({_MANIFEST}) WHERE sid % 5 = 0
    UNION ALL SELECT sid, status, gt_rr, NULL AS note FROM ({_MANIFEST}) WHERE sid % 5 <> 0""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir)
    new = rows.where("sid % 5 = 0").select("sid", "status", F.lit("new").alias("note"))
    return catalog.upsert(rows.select("sid", "status", "gt_rr"), new)


@query(f"SELECT status, count(*) AS n FROM ({_MANIFEST}) GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_histogram(_manifest(spark, sf_dir))


@query(f"""SELECT dataset, count(*) AS n, count(DISTINCT subject) AS subjects, count(gt_rr) AS with_gt, min("T") AS t_min, trunc(median("T"))::INT AS t_median, max("T") AS t_max FROM ({_MANIFEST}) GROUP BY 1""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.corpus_report(_manifest(spark, sf_dir))


@query(f"""SELECT sid, ceil("T" / 2)::BIGINT AS "T", CASE WHEN "T" IS NULL THEN 'missing' WHEN "T" < 370 THEN 'short:' || "T" WHEN ceil("T" / 2) < 370 THEN 'short:' || ceil("T" / 2)::BIGINT END AS reason
    FROM (SELECT sid FROM ({_MANIFEST})) LEFT JOIN (SELECT sid, "T" FROM ({_MANIFEST}) WHERE status <> 'skip') USING (sid)""")
def map_load_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir)
    return catalog.with_reasons(rows.select("sid"), rows.where("status <> 'skip'"), 370, 2)


@query(f"SELECT dataset, subject, array_to_string(list_sort(list(DISTINCT sid)), ',') AS sids FROM ({_MANIFEST}) GROUP BY 1, 2")
def sessions_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.gather(_manifest(spark, sf_dir), ["dataset", "subject"])
    return rows.withColumn("sids", F.array_join(F.col("sids").cast("array<string>"), ","))


@query("""SELECT user_id, count(*) AS n_frames, round(max(t) - min(t), 6) AS duration_s, round((count(*) - 1) / (max(t) - min(t)), 9) AS fps
    FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY 1 HAVING count(*) >= 2 AND max(t) > min(t)""")
def session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.session_rates(table(spark, sf_dir, "events"), "user_id", "ts")
    return rows.select("user_id", "n_frames", F.round("duration_s", 6).alias("duration_s"), F.round("fps", 9).alias("fps"))


@query("SELECT p_partkey, p_name, regexp_extract(p_brand, '^Brand#([0-9]+)$', 1)::INT AS brand FROM part WHERE regexp_matches(p_brand, '^Brand#[0-9]+$')")
def name_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[0-9]+$"))
    return rows.select("p_partkey", "p_name", F.regexp_extract("p_brand", "^Brand#([0-9]+)$", 1).cast("int").alias("brand"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(ns)), ',') AS stamps FROM (SELECT o_custkey, o_orderkey * 1000 AS ns FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY 1""")
def timestamp_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.names import image_timestamps

    name = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Thumbs.db")).otherwise(F.format_string("Image%d.png", F.col("o_orderkey") * 1000))
    rows = image_timestamps(table(spark, sf_dir, "orders").select("o_custkey", name.alias("name")), ["o_custkey"], "name")
    return rows.select("o_custkey", F.array_join(F.col("stamps").cast("array<string>"), ",").alias("stamps"))


@query("""SELECT s_suppkey, CASE s_nationkey WHEN 8 THEN 'b42' WHEN 10 THEN 'b42' ELSE 'a' || s_nationkey END AS person, CASE WHEN s_nationkey IN (8, 10) THEN 'd1gt' || s_nationkey ELSE 'd1gt' END AS session FROM supplier""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("number", F.col("s_nationkey").cast("string"))
    known = catalog.lookup(rows, "number", {"8": "b42", "10": "b42"}, "", "alias")
    return known.select("s_suppkey", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.concat(F.lit("a"), "number")).alias("person"), F.when(F.col("alias") != "", F.concat(F.lit("d1gt"), "number")).otherwise("d1gt").alias("session"))


@query("""SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'steady' WHEN 1 THEN 'talking' WHEN 2 THEN 'slow translation' ELSE 'unknown' END AS task_name FROM nation""")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.lookup(table(spark, sf_dir, "nation"), "n_regionkey", {0: "steady", 1: "talking", 2: "slow translation"}, "unknown", "task_name")
    return rows.select("n_nationkey", "n_name", "task_name")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'attr' WHEN user_id % 4 IN (0, 1) THEN 'lamp' ELSE 'natural' END AS illumination FROM events""")
def illumination_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("session", (F.col("user_id") % 4).cast("int"))
    rows = catalog.lookup(rows, "session", {0: "lamp", 1: "lamp", 2: "natural", 3: "natural"}, "natural", "mapped")
    return rows.select("event_id", F.coalesce(F.when(F.col("event_type") == "click", "attr"), "mapped").alias("illumination"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ---- splits: customers stand for subjects, nations for datasets


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    dataset = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    return rows.select(dataset.alias("dataset"), F.col("c_custkey").cast("string").alias("subject"), F.concat(dataset, F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("sid"))


_SESSIONS = "SELECT 'n' || c_nationkey AS dataset, c_custkey::VARCHAR AS subject, 'n' || c_nationkey || '_' || c_custkey || '_' || o_orderkey AS sid FROM orders JOIN customer ON o_custkey = c_custkey"
_PARTS = f"""SELECT dataset, subject, CASE WHEN place < test THEN 'test' WHEN place < test + val THEN 'val' ELSE 'train' END AS part FROM (
    SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(0.1e0 * n, 0), n - test - 1)) ELSE 0 END AS val FROM (
    SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(0.2e0 * n, 0), n - 2)) ELSE 0 END AS test FROM (
    SELECT dataset, subject, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || subject), subject) - 1 AS place, count(*) OVER (PARTITION BY dataset) AS n FROM (SELECT DISTINCT dataset, subject FROM ({_SESSIONS})))))"""
_VAL = f"""SELECT dataset, sid FROM ({_SESSIONS}) JOIN (SELECT dataset, subject FROM (SELECT dataset, subject, row_number() OVER (PARTITION BY dataset ORDER BY md5('20240501:' || subject), subject) AS place, count(*) OVER (PARTITION BY dataset) AS n
    FROM (SELECT DISTINCT dataset, subject FROM ({_SESSIONS}))) WHERE place <= greatest(1, round_even(n * 0.1e0, 0))) USING (dataset, subject)"""


@query(_PARTS)
def split_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hashed(_sessions(spark, sf_dir))


@query(f"""SELECT dataset, part, count(*) AS sessions, count(DISTINCT subject) AS subjects FROM (
    SELECT dataset, subject, sid, part FROM ({_SESSIONS}) JOIN ({_PARTS}) USING (dataset, subject) UNION ALL SELECT dataset, subject, sid, 'all' FROM ({_SESSIONS})) GROUP BY 1, 2""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    return splits.report(splits.members(sessions, splits.hashed(sessions)))


@query()
def split_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.permuted(_sessions(spark, sf_dir))


@query(_VAL)
def aux_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.aux_val(_sessions(spark, sf_dir))


@query(f"""WITH val AS ({_VAL}) SELECT sid, part FROM ({_SESSIONS}) JOIN ({_PARTS}) USING (dataset, subject) WHERE dataset IN ('n1', 'n2') AND part IN ('train', 'val')
    UNION SELECT sid, 'val' FROM val WHERE dataset = 'n3' UNION SELECT sid, 'train' FROM ({_SESSIONS}) WHERE dataset = 'n3' AND sid NOT IN (SELECT sid FROM val)""")
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    split = splits.members(sessions, splits.hashed(sessions).where("dataset <> 'n3'"))
    return splits.pool(split, sessions, ["n1", "n2", "n3"])


# ---- time: users' events stand for signals

_ORDERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n_all FROM events"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("i", (F.row_number().over(w) - 1).cast("long"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.to_series(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query(f"SELECT user_id, i FROM ({_ORDERED}) WHERE i % 5 = 0")
def stride_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.decimate(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", F.col("place").cast("long").alias("i"))


@query(f"""SELECT user_id, p[1]::INT AS first, p[2]::INT AS second, len(p)::INT AS n_edges FROM (SELECT user_id, list(i ORDER BY i) AS p FROM (
    SELECT user_id, i, event_type = 'error' AS o, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY i) AS b FROM ({_ORDERED})) WHERE o AND NOT b GROUP BY 1) WHERE len(p) >= 2""")
def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("on", F.col("event_type") == "error")
    return timeseries.rising_edges(rows, ["user_id"], ["ts", "event_id"], "on").select("user_id", *[F.col(c).cast("int").alias(c) for c in ("first", "second", "n_edges")])


@query(f"""SELECT user_id, i FROM (SELECT *, min(CASE WHEN event_type <> 'view' THEN i END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN event_type <> 'view' THEN i END) OVER (PARTITION BY user_id) AS z FROM ({_ORDERED})) WHERE i BETWEEN a AND z""")
def trim_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir).withColumn("level", F.when(F.col("event_type") == "view", 16).otherwise(0))
    return timeseries.trim_flat(rows, ["user_id"], "i", "level", 16).select("user_id", "i")


@query("""SELECT DISTINCT user_id, CASE WHEN m > 1 THEN floor(k * ((n - 1)::DOUBLE / (m - 1))) ELSE 0 END::BIGINT AS place FROM (
    SELECT user_id, count(*) AS n, least(24, count(*)) AS m, unnest(range(least(24, count(*)))) AS k FROM events GROUP BY 1)""")
def probe_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return timeseries.probe_places(rows, "n").select("user_id", "place")


@query(f"SELECT user_id, i, round(value - b, 6) AS change FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS b FROM ({_ORDERED})) WHERE b IS NOT NULL")
def prev_frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.previous_pairs(_long(spark, sf_dir), ["user_id"], ["i"], "value")
    return rows.select("user_id", "i", F.round(F.col("value") - F.col("before"), 6).alias("change"))


@query(f"""SELECT a.user_id, g.k AS i, round(a.value + CASE WHEN g.k * 1.6e0 > a.i THEN (g.k * 1.6e0 - a.i) * (b.value - a.value) ELSE 0 END, 6) AS value
    FROM ({_ORDERED}) a LEFT JOIN ({_ORDERED}) b ON b.user_id = a.user_id AND b.i = a.i + 1 JOIN (SELECT unnest(range(1000)) AS k) g ON floor(g.k * 1.6e0) = a.i AND g.k * 1.6e0 <= a.n_all - 1""")
def linear_resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeseries.resample_linear(_long(spark, sf_dir), ["user_id"], "i", "value", 16.0, 10.0), "value")


@query(f"""SELECT user_id, i, round(value - (CASE WHEN n_all > 1 THEN s * i + c ELSE m END), 5) AS detrended FROM (SELECT *, regr_slope(value, i) OVER u AS s, regr_intercept(value, i) OVER u AS c, avg(value) OVER u AS m FROM ({_ORDERED}) WINDOW u AS (PARTITION BY user_id))""")
def linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeseries.remove_line(_long(spark, sf_dir), ["user_id"], "i", "value").select("user_id", "i", "detrended"), "detrended", 5)


_WIDTH, _STEP, _NFFT, _FS = 32, 4, 64, 32.0
_BINS = [k for k in range(_NFFT // 2 + 1) if 1.5 <= k * _FS / _NFFT <= 10.5]
_STARTS = f"SELECT user_id, a.s FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u, LATERAL (SELECT unnest(range(0, n - least({_WIDTH}, n) + 1, {_STEP})) AS s) a"
_WINDOWED = f"SELECT w.user_id, w.s, e.i - w.s AS j, e.value - avg(e.value) OVER (PARTITION BY w.user_id, w.s) AS v FROM ({_STARTS}) w JOIN ({_ORDERED}) e ON e.user_id = w.user_id AND e.i >= w.s AND e.i < w.s + {_WIDTH}"
_POWER = f"SELECT user_id, s, k, pow(sum(v * cos(j::DOUBLE * (2 * pi() * k / {_NFFT}))), 2) + pow(sum(v * sin(j::DOUBLE * (2 * pi() * k / {_NFFT}))), 2) AS p FROM ({_WINDOWED}), (SELECT unnest(range({_BINS[0]}, {_BINS[-1] + 1})) AS k) GROUP BY 1, 2, 3"


def _window_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.window_powers(_series(spark, sf_dir), "x", _WIDTH, _STEP, spectral.band_bins(_FS, _NFFT, 1.5, 10.5), _NFFT)


@query(f"SELECT user_id, s::INT AS start, count(*)::INT AS size, round(avg(value), 7) AS mean FROM (SELECT w.user_id, w.s, e.value FROM ({_STARTS}) w JOIN ({_ORDERED}) e ON e.user_id = w.user_id AND e.i >= w.s AND e.i < w.s + {_WIDTH}) GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeseries.windows(_series(spark, sf_dir), "x", _WIDTH, _STEP)
    mean = F.aggregate("w", F.lit(0.0), lambda a, v: a + v) / F.size("w")
    return rows.select("user_id", "start", F.size("w").alias("size"), F.round(mean, 7).alias("mean"))


@query(f"SELECT user_id, s::INT AS start, k, round(p / (sum(p) OVER (PARTITION BY user_id, s) + 1e-12), 6) AS share FROM ({_POWER})")
def band_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _window_powers(spark, sf_dir).withColumn("share", spectral.normalised(F.col("p")))
    return rows.select("user_id", "start", F.posexplode("share").alias("k", "share")).select("user_id", "start", (F.col("k") + _BINS[0]).cast("long").alias("k"), F.round("share", 6).alias("share"))


@query(f"SELECT user_id, s::INT AS start, round(arg_max(k, (p, -k)) * {_FS}e0 / {_NFFT} * 60, 6) AS rate FROM ({_POWER}) GROUP BY 1, 2")
def peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_powers(spark, sf_dir).select("user_id", "start", F.round(spectral.peak_rate(F.col("p"), _FS, _NFFT, _BINS[0]), 6).alias("rate"))


@query(f"""WITH p AS ({_POWER}), w AS (SELECT user_id, s, arg_max(k, (p, -k)) * {_FS}e0 / {_NFFT} * 60 AS peak, max(p) / (median(p) + 1e-20) AS snr FROM p GROUP BY 1, 2),
    t AS (SELECT user_id, arg_max(k, (p, -k)) * {_FS}e0 / {_NFFT} * 60 AS psd_sum FROM (SELECT user_id, k, sum(p) AS p FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, count(*) AS n_windows, any_value(psd_sum) AS psd_sum, round(avg(peak), 6) AS mean, median(peak) AS median, round(sum(peak * snr) / (sum(snr) + 1e-20), 5) AS snr_mean FROM w JOIN t USING (user_id) GROUP BY 1""")
def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectral.readouts(_window_powers(spark, sf_dir), ["user_id"], "p", _FS, _NFFT, _BINS)
    return _rounded(_rounded(rows, "mean"), "snr_mean", 5)


_WIDE = [k for k in range(2049) if 0.1 <= k * 15.0 / 4096 <= 0.5]


@query(f"""WITH st AS (SELECT user_id, a.s, least(30, n) AS width FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u, LATERAL (SELECT unnest(range(0, n - least(30, n) + 1, 15)) AS s) a),
    w AS (SELECT st.user_id, s, e.i - s AS j, e.value - avg(e.value) OVER (PARTITION BY st.user_id, s) AS v FROM st JOIN ({_ORDERED}) e ON e.user_id = st.user_id AND e.i >= s AND e.i < s + width),
    p AS (SELECT user_id, s, k, pow(sum(v * cos(j::DOUBLE * (2 * pi() * k / 4096))), 2) + pow(sum(v * sin(j::DOUBLE * (2 * pi() * k / 4096))), 2) AS p FROM w, (SELECT unnest(range({_WIDE[0]}, {_WIDE[-1] + 1})) AS k) GROUP BY 1, 2, 3),
    x AS (SELECT user_id, s, arg_max(k, (p, -k)) * 15e0 / 4096 * 60 AS peak, max(p) / (median(p) + 1e-20) AS snr FROM p GROUP BY 1, 2),
    t AS (SELECT user_id, arg_max(k, (p, -k)) * 15e0 / 4096 * 60 AS psd_sum FROM (SELECT user_id, k, sum(p) AS p FROM p GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT user_id, any_value(psd_sum) AS psd_sum, avg(peak) AS mean, median(peak) AS median, sum(peak * snr) / (sum(snr) + 1e-20) AS snr_mean FROM x JOIN t USING (user_id) GROUP BY 1)
    SELECT user_id, readout, round(bpm, 4) AS bpm FROM (UNPIVOT r ON psd_sum, mean, median, snr_mean INTO NAME readout VALUE bpm)""")
def wave_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.wave_readouts(_series(spark, sf_dir), ["user_id"], "x", 15.0, 30), "bpm", 4)


@query()
def belt_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.belt_rate(_series(spark, sf_dir), "x", 2.0, 20).select("user_id", "gt_rr")


@query()
def bandpass_filtfilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import signal

    b, a = signal.butter_band(3, 0.1, 0.5, 2.0)
    rows = _series(spark, sf_dir).withColumn("y", spectral.per_array(lambda v: signal.filtfilt(b, a, signal.detrend(v)), "x", "array<double>"))
    return rows.select("user_id", F.posexplode("y").alias("i", "y")).withColumn("y", F.round("y", 6))


@query(f"""WITH n AS (SELECT user_id, count(*) AS n, greatest(2, round_even(count(*) / 256e0 * 240, 0))::BIGINT AS m FROM events GROUP BY 1),
    c AS (SELECT e.user_id, k, n, m, sum(value * cos(2 * pi() * k * e.i / n)) AS re, -sum(value * sin(2 * pi() * k * e.i / n)) AS im FROM ({_ORDERED}) e JOIN (SELECT user_id, n, m, unnest(range(0, least(n, m) // 2 + 1)) AS k FROM n) USING (user_id) GROUP BY 1, 2, 3, 4),
    h AS (SELECT user_id, k, n, m, re, CASE WHEN 2 * k = m OR k = 0 THEN 0 ELSE im END AS im, CASE WHEN k = 0 THEN 1 WHEN 2 * k = m AND m < n THEN 2 WHEN 2 * k = m THEN 1 WHEN 2 * k = n AND m > n THEN 1 ELSE 2 END AS times FROM c)
    SELECT user_id, i::INT AS i, round(sum(times * (re * cos(2 * pi() * k * i / m) - im * sin(2 * pi() * k * i / m))) / any_value(n), 5) AS y FROM h, LATERAL (SELECT unnest(range(0, m)) AS i) GROUP BY 1, 2""")
def fourier_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import signal

    rows = _series(spark, sf_dir).withColumn("y", spectral.per_array(lambda v: signal.fourier_resample(v, max(2, round(len(v) / 256 * 30 * 8))), "x", "array<double>"))
    return rows.select("user_id", F.posexplode("y").alias("i", "y")).withColumn("y", F.round("y", 5))


_TAPS = 41


def _fir_sql(q: int) -> str:
    n = 20 * q + 1
    tap = f"(CASE WHEN j = {10 * q} THEN 1e0 ELSE sin(pi() * (j - {10 * q}) / {q}e0) / (pi() * (j - {10 * q}) / {q}e0) END) * (0.54e0 - 0.46e0 * cos(2 * pi() * j / {n - 1}e0))"
    return f"""WITH t AS (SELECT j, {tap} AS h FROM (SELECT unnest(range({n})) AS j)), taps AS (SELECT j, h / (SELECT sum(h) FROM t) AS h FROM t), e AS ({_ORDERED})
    SELECT o.user_id, (o.i // {q})::INT AS i, round(sum(h * x.value), 6) AS y FROM (SELECT user_id, i FROM e WHERE i % {q} = 0) o, taps JOIN e x ON x.user_id = o.user_id AND x.i = o.i + {10 * q} - j GROUP BY 1, 2"""


@query(_fir_sql(2))
def fir_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import signal

    rows = _series(spark, sf_dir).withColumn("y", spectral.per_array(lambda v: signal.fir_decimate(v, 2), "x", "array<double>"))
    return rows.select("user_id", F.posexplode("y").alias("i", "y")).withColumn("y", F.round("y", 6))


@query(f"""WITH seg AS (SELECT w.user_id, w.s, e.i - w.s AS j, (e.value - avg(e.value) OVER (PARTITION BY w.user_id, w.s)) * (0.5e0 - 0.5e0 * cos(2 * pi() * (e.i - w.s) / 32e0)) AS v FROM
    (SELECT user_id, a.s FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 32) u, LATERAL (SELECT unnest(range(0, n - 31, 16)) AS s) a) w JOIN ({_ORDERED}) e ON e.user_id = w.user_id AND e.i >= w.s AND e.i < w.s + 32),
    p AS (SELECT user_id, k, sum(p) AS p FROM (SELECT user_id, s, k, pow(sum(v * cos(j::DOUBLE * (2 * pi() * k / 64))), 2) + pow(sum(v * sin(j::DOUBLE * (2 * pi() * k / 64))), 2) AS p FROM seg, (SELECT unnest(range(3, 22)) AS k) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT user_id, round(arg_max(k, (p, -k)) * 0.5e0, 6) AS peak_hz FROM p GROUP BY 1""")
def welch_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = list(range(3, 22))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    powers = spectral.window_powers(_series(spark, sf_dir).where(F.size("x") >= 32), "x", 32, 16, bins, 64, hann)
    total = powers.groupBy("user_id").agg(F.array(*[F.sum(F.col("p")[i]) for i in range(len(bins))]).alias("p"))
    return total.select("user_id", F.round((spectral.argmax(F.col("p")) + 3) * 0.5, 6).alias("peak_hz"))


_SNR = f"SELECT user_id, s, arg_max(k, (p, -k)) * {_FS}e0 / {_NFFT} * 60 AS peak, max(p) / (median(p) + 1e-20) AS snr FROM ({_POWER}) GROUP BY 1, 2"


@query(f"SELECT user_id % 10 AS session, round(sum(peak * snr) / (sum(snr) + 1e-20), 5) AS bpm, count(*) AS n_windows FROM ({_SNR}) GROUP BY 1")
def snr_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _window_powers(spark, sf_dir).withColumn("session", F.col("user_id") % 10)
    return _rounded(spectral.snr_weighted_rate(rows, ["session"], "p", _FS, _NFFT, _BINS[0], len(_BINS)), "bpm", 5)


@query(f"SELECT user_id, i - a AS i, round(value, 6) AS value FROM (SELECT *, round_even(least(n_all, user_id % 7) * 2.5e0, 0)::BIGINT AS a, round_even((n_all - user_id % 5) * 1.25e0, 0)::BIGINT AS z FROM ({_ORDERED})) WHERE i >= a AND i < z")
def time_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("x")
    part = references.clip_by_time(F.col("x"), 2.5, F.least(n, F.col("user_id") % 7).cast("double"), (n - F.col("user_id") % 5) / 2.0)
    return _series(spark, sf_dir).select("user_id", F.posexplode(part).alias("i", "value")).select("user_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


# ---- frames: events stand for frames of their user's video, errors for frames that could not be read


@query("""SELECT sid, frame, before FROM (SELECT user_id AS sid, event_id AS frame, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type <> 'error')
    WHERE before IS NOT NULL""")
def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("frame"), F.when(F.col("event_type") != "error", F.col("value").cast("string").cast("binary")).alias("grey"))
    order = Window.partitionBy("sid", "range").orderBy("frame")
    pairs = maps.with_halo(crops, 1000).withColumn("before", F.lag("frame").over(order)).where(~F.col("halo") & F.col("before").isNotNull())
    return pairs.select("sid", "frame", "before")
