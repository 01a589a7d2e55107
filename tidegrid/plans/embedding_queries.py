"""Queries over embeddings (as 8 x 8 maps, boxes and views) and over maps of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physnet
from ..operators import contrastive, geometry, scoring, timeseries
from .events_queries import _ORDERED, _series, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LONG = "SELECT vec_id, k - 1 AS k, embedding[k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return rows.withColumns({"k": F.col("k").cast("long"), "v": F.col("v").cast("double")})


@query(f"SELECT vec_id, k, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS z FROM ({_LONG}) WINDOW w AS (PARTITION BY vec_id)")
def zscore_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.standardise(_cells(spark, sf_dir), ["vec_id"], "v").select("vec_id", "k", F.round("z", 6).alias("z"))


def _u(key: str) -> str:
    return f"('0x' || left(md5({key}), 8))::BIGINT / 4294967296e0"


def _gauss(key: str) -> str:
    one, two = (_u(f"{key} || ':{c}'") for c in "ab")
    return f"sqrt(-2 * ln(1 - {one})) * cos(2 * pi() * {two})"


@query(f"""SELECT vec_id, view, count(*) AS n, round(sum(v + 0.05e0 * sd * {_gauss("'3:' || vec_id || ':' || roi || ':' || i")}), 6) AS total FROM (
    SELECT vec_id, view, roi, i, v, stddev_pop(v) OVER (PARTITION BY vec_id, view) + 1e-6 AS sd FROM (SELECT vec_id, k // 8 AS roi, k % 8 AS i, CASE WHEN (k // 8) % 2 = 0 THEN 'a' ELSE 'b' END AS view, v FROM ({_LONG}))) GROUP BY 1, 2""")
def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumns({"roi": F.floor(F.col("k") / 8), "i": F.col("k") % 8})
    rows = timeseries.two_views(cells, ["vec_id"], "roi", "i", "v", 0.05, 3)
    return rows.groupBy("vec_id", "view").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"""WITH d AS (SELECT vec_id AS draw, vec_id AS sid, 5 + floor({_u("'9:' || vec_id || ':' || vec_id || ':length'")} * 4)::INT AS len FROM embeddings), c AS (SELECT *, floor({_u("'9:' || draw || ':' || sid || ':start'")} * (8 - len + 1))::INT AS s FROM d WHERE len <= 8),
    g AS (SELECT draw, len, s, roi, i, i * (len - 1) / 5e0 AS x, embedding[roi * 8 + s + 1:roi * 8 + s + len]::DOUBLE[] AS w FROM c JOIN embeddings e ON e.vec_id = c.sid, (SELECT unnest(range(8)) AS roi), (SELECT unnest(range(6)) AS i)),
    v AS (SELECT draw, roi, i, CASE WHEN roi % 2 = 0 THEN 'a' ELSE 'b' END AS view, CASE WHEN len = 6 THEN w[i + 1] ELSE w[floor(x)::INT + 1] * (1 - (x - floor(x))) + w[least(floor(x)::INT + 2, len)] * (x - floor(x)) END AS x FROM g),
    n AS (SELECT draw, roi, i, view, x + 0.05e0 * (stddev_pop(x) OVER (PARTITION BY draw, view) + 1e-6) * {_gauss("'9:' || draw || ':' || roi || ':' || i")} AS x FROM v)
    SELECT draw, view, roi, i, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6), 5) AS z FROM n WINDOW w AS (PARTITION BY draw, view)""")
def training_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    channels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.struct(r.cast("long").alias("roi"), F.transform(F.slice("embedding", r * 8 + 1, 8), lambda v: v.cast("double")).alias("x")))
    maps = rows.select(F.col("vec_id").alias("sid"), F.explode(channels).alias("c")).select("sid", "c.roi", "c.x")
    out = timeseries.training_batch(maps, rows.select(F.col("vec_id").alias("draw"), F.col("vec_id").alias("sid")), "sid", 6, 1, 2, 0.05, 9)
    return out.select("draw", "view", "roi", F.col("i").cast("long").alias("i"), F.round("z", 5).alias("z"))


@query(f"SELECT vec_id, k, CASE WHEN v = 0 THEN 0e0 ELSE round_even(v / pow(2, e - 10), 0) * pow(2, e - 10) END AS stored FROM (SELECT *, CASE WHEN v = 0 THEN 0 ELSE greatest(floor(log2(abs(v))), -14) END AS e FROM ({_LONG}))")
def half_precision_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("vec_id", "k", timeseries.half_precision(F.col("v")).alias("stored"))


@query(f"SELECT vec_id, (k // 8) // 2 * 4 + (k % 8) // 2 AS roi, round(avg(v), 6) AS value FROM ({_LONG}) GROUP BY 1, 2")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).withColumns({"row": F.floor(F.col("k") / 8), "col": F.col("k") % 8})
    return timeseries.block_mean(rows, ["vec_id"], "row", "col", "v", 8, 4).withColumn("value", F.round("value", 6))


_VIEWS = """SELECT vec_id // 32 AS batch, vec_id AS i, list_transform(range(1, 65, 2), lambda k: embedding[k]::DOUBLE) AS a, list_transform(range(2, 65, 2), lambda k: embedding[k]::DOUBLE) AS b FROM embeddings"""
_POWERS = f"SELECT batch, i, list_transform(a, lambda x: x * x / (list_sum(list_transform(a, lambda y: y * y)) + 1e-12)) AS a, list_transform(b, lambda x: x * x / (list_sum(list_transform(b, lambda y: y * y)) + 1e-12)) AS b FROM ({_VIEWS})"


@query(f"""WITH p AS ({_POWERS}), v AS (SELECT batch, i, 'a' AS view, a AS p FROM p UNION ALL SELECT batch, i, 'b', b FROM p),
    s AS (SELECT x.batch, x.i, x.view, x.i = y.i AS own, -list_sum(list_transform(range(1, 33), lambda k: pow(x.p[k] - y.p[k], 2))) / 32 / 0.1e0 AS s FROM v x JOIN v y ON x.batch = y.batch AND (x.i <> y.i OR x.view <> y.view)),
    m AS (SELECT batch, i, view, max(s) FILTER (NOT own) AS top FROM s GROUP BY ALL)
    SELECT batch, round(avg(ln(rest) + top - pos), 6) AS loss, count(*) // 2 AS n FROM (SELECT batch, i, view, any_value(top) AS top, max(s) FILTER (own) AS pos, sum(exp(s - top)) FILTER (NOT own) AS rest FROM s JOIN m USING (batch, i, view) GROUP BY ALL) GROUP BY 1""")
def info_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double") * v.cast("double")))
    for name, parity in (("a", 0), ("b", 1)):
        half = F.filter("x", lambda v, k: k % 2 == parity)
        rows = rows.withColumn(f"sum_{name}", F.aggregate(half, F.lit(0.0), lambda s, v: s + v) + 1e-12).withColumn(name, F.transform(half, lambda v: v / F.col(f"sum_{name}")))
    rows = rows.select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", "a", "b")
    return contrastive.info_nce(rows, "batch", "vec_id", "a", "b").withColumn("loss", F.round("loss", 6))


_DETECTIONS = "SELECT label AS session, vec_id // 3 AS frame, round(200 + 400e0 * embedding[1]::DOUBLE, 0) AS x, round(150 + 300e0 * embedding[2]::DOUBLE, 0) AS y, round(60 + 100e0 * abs(embedding[3]::DOUBLE), 0) AS w, round(60 + 100e0 * abs(embedding[4]::DOUBLE), 0) AS h, embedding[5]::DOUBLE AS score FROM embeddings"
_MEDIAN = f"SELECT session, median(x) AS x, median(y) AS y, median(w) AS w, median(h) AS h, count(*) AS n_frames FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, frame ORDER BY score DESC, x, y, w, h) AS p FROM ({_DETECTIONS})) WHERE p = 1) GROUP BY 1"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("session"), F.floor(F.col("vec_id") / 3).alias("frame"), F.round(200 + 400 * e(0)).alias("x"), F.round(150 + 300 * e(1)).alias("y"),
        F.round(60 + 100 * F.abs(e(2))).alias("w"), F.round(60 + 100 * F.abs(e(3))).alias("h"), e(4).alias("score"),
    )


@query(_MEDIAN)
def median_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.median_box(_detections(spark, sf_dir), ["session"], "frame", ["x", "y", "w", "h"], "score")


@query(f"""SELECT session, frame, x, score, greatest(0, round_even(x + w / 2 - s / 2, 0))::INT AS x0, greatest(0, round_even(y + h / 2 - s / 2, 0))::INT AS y0, least(640, round_even(x + w / 2 + s / 2, 0))::INT AS x1, least(480, round_even(y + h / 2 + s / 2, 0))::INT AS y1
    FROM (SELECT *, greatest(w, h) * 1.5e0 AS s FROM ({_DETECTIONS}))""")
def expand_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    x0, y0, x1, y1 = geometry.expand_box(c("x"), c("y"), c("w"), c("h"), F.lit(640), F.lit(480))
    return _detections(spark, sf_dir).select("session", "frame", "x", "score", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query("SELECT label AS model, count(*) AS tensors, sum(len(embedding))::BIGINT AS n_parameters FROM embeddings GROUP BY 1")
def model_param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("model"), F.col("vec_id").alias("name"), "embedding")
    return scoring.parameter_counts(rows, "model", "embedding")


@query()
def batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = 16
    n = F.size("x") - channels + 1
    lagged = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(channels)), lambda r: F.slice("x", r, n)))
    maps = _series(spark, sf_dir).select("user_id", F.when(F.size("x") >= 2 * channels, lagged).alias("m"))
    return scoring.score_maps(maps, "user_id", "m", channels, physnet.weights(), 15.0, 30, 0.1, 0.5)


_CLIPS = f"""SELECT *, floor({_u("'42:' || user_id || ':start'")} * (n - len + 1))::INT AS s FROM (SELECT user_id, n, 27 + floor({_u("'42:' || user_id || ':length'")} * 10)::INT AS len FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) WHERE len <= n"""


@query(f"""SELECT user_id, len AS clip_length, s AS clip_start, i::INT AS i, round(CASE WHEN len = 30 THEN a ELSE a * (1 - (x - floor(x))) + b * (x - floor(x)) END, 6) AS value FROM (
    SELECT c.*, k AS i, k * (len - 1) / 29e0 AS x, e1.value AS a, e2.value AS b FROM ({_CLIPS}) c, (SELECT unnest(range(30)) AS k) g
    JOIN ({_ORDERED}) e1 ON e1.user_id = c.user_id AND e1.i = s + CASE WHEN len = 30 THEN k ELSE floor(k * (len - 1) / 29e0) END JOIN ({_ORDERED}) e2 ON e2.user_id = c.user_id AND e2.i = s + least(floor(k * (len - 1) / 29e0) + 1, len - 1))""")
def clip_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).withColumn("n", F.size("x"))
    drawn = timeseries.clip_draws(rows, "n", 30, 3, 6, 42, ("user_id",))
    part = F.slice("x", F.col("clip_start") + 1, F.col("clip_length"))
    return drawn.select("user_id", "clip_length", "clip_start", F.posexplode(timeseries.stretch(part, 30)).alias("i", "value")).withColumn("value", F.round("value", 6))


@query(f"""SELECT c_custkey, draw::INT AS draw FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) JOIN (SELECT d AS draw, least(floor({_u("'7:' || d")} * n), n - 1)::BIGINT AS place FROM (SELECT count(*) AS n FROM customer), LATERAL (SELECT unnest(range(4 * greatest(1, n // 8))) AS d)) USING (place)""")
def draw_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return timeseries.draw_with_replacement(rows, "c_custkey", 4 * max(1, rows.count() // 8), 7)
