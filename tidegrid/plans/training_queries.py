"""Queries of training and scoring: 32 embeddings of 64 entries, one after the other, stand for a session's map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, training
from ..operators.scratch import shared_folder

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CHANNELS, LENGTH = 32, 64
#: A small network and few, short clips at one sample a second; seeds of the grid.
SMALL = training.TrainConfig(epochs=2, steps=2, batch=4, val_batches=2, rate=3e-3, clip=40, warp_minus=4, warp_plus=8, slack=2, fs=1.0, stem=4, width=8)
SEEDS = (1, 2)
_PLACE = "SELECT vec_id // 32 AS k, vec_id % 32 AS roi, embedding FROM embeddings"
_WHOLE = f"SELECT k FROM ({_PLACE}) GROUP BY k HAVING count(*) = 32"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(f"vec_id div {CHANNELS}").alias("sid"), (F.col("vec_id") % CHANNELS).alias("roi"), "embedding")
    return training.flat_maps(rows, "sid", "roi", "embedding").where(F.col("channels") == CHANNELS).withColumn("sid", F.format_string("s%06d", "sid"))


def _members(maps: DataFrame) -> DataFrame:
    """Run ``all`` has every fourth session for validation; run ``odd`` trains on the odd ones and has none."""
    k = F.substring("sid", 2, 6).cast("int")
    whole = maps.select(F.lit("all").alias("run"), "sid", F.when(k % 4 == 3, "val").otherwise("train").alias("part"))
    return whole.unionByName(maps.where(k % 2 == 1).select(F.lit("odd").alias("run"), "sid", F.lit("train").alias("part")))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    maps, store = _maps(spark, sf_dir), shared_folder(spark, "trained")
    training.train_grid(maps, _members(maps), SEEDS, store, SMALL)
    return maps, store


@query(
    f"""SELECT run, part, k - 1 AS k, 's' || lpad(s::VARCHAR, 6, '0') AS sid FROM (SELECT *, row_number() OVER (PARTITION BY run, part ORDER BY s) AS k FROM (
    SELECT 'all' AS run, CASE WHEN k % 4 = 3 THEN 'val' ELSE 'train' END AS part, k AS s FROM ({_WHOLE}) UNION ALL SELECT 'odd', 'train', k FROM ({_WHOLE}) WHERE k % 2 = 1))"""
)
def training_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    return training.usable_sessions(maps, _members(maps), SMALL)


@query()
def train_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every epoch of the grid, and which epoch of a training is kept."""
    _, store = _trained(spark, sf_dir)
    best = training.best_epochs(spark, store).select("run", "seed", F.col("best_epoch").alias("epoch"), F.lit(True).alias("kept"))
    return training.losses(spark, store).join(best, ["run", "seed", "epoch"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query()
def trained_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all sessions by every kept network of the grid."""
    maps, store = _trained(spark, sf_dir)
    return scoring.predict_runs(maps, training.stored_weights(spark, store), SMALL.fs, SMALL.clip, SMALL.low, SMALL.high)


@query(
    f"""SELECT run || '_s' || seed AS model, 42::BIGINT AS tensors, (4 * 5 + 3 * 4 + (4 * 9 * 8 + 3 * 8) + 7 * (8 * 9 * 8 + 3 * 8) + (8 * 3 * 8 + 3 * 8) + 9)::BIGINT AS n_parameters
    FROM (SELECT DISTINCT run FROM (SELECT 'all' AS run FROM ({_WHOLE}) UNION ALL SELECT 'odd' FROM ({_WHOLE}) WHERE k % 2 = 1)), (SELECT unnest([1, 2]) AS seed)"""
)
def trained_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors and parameters of every trained network, from its checkpoint; running statistics are not parameters."""
    _, store = _trained(spark, sf_dir)
    rows = training.checkpoints(spark, store).where(~F.col("name").rlike("[.](mean|var)$"))
    return scoring.parameter_counts(rows.select(F.concat_ws("_s", "run", "seed").alias("model"), "values"), "model", "values")
