"""Training on a pool of corpora for several seeds, scoring of test sessions, and their metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.signal import fir_decimate
from . import metrics, scoring, splits, training
from .spectral import per_array

#: Fixed value: columns that a map needs to be scored.
LEAST_SCORED = 60


@dataclass(frozen=True)
class Experiment:
    losses: DataFrame
    best: DataFrame
    predictions: DataFrame
    cells: DataFrame


def run_name(tag: str, pool: Sequence[str]) -> str:
    return f"{tag}_{'+'.join(pool)}"


def train_and_score(
    maps: DataFrame, split: DataFrame, manifest: DataFrame, pool: Sequence[str], evaluated: Sequence[str], seeds: Sequence[int], store: str,
    tag: str = "run", readout: str = "psd_sum", source_fs: float = DEFAULT.fs, config: training.TrainConfig = training.TrainConfig(),
) -> Experiment:
    """Maps (sid, roi, x) are decimated to the rate of training; a run is named by its tag and pool, a prediction's also by its
    seed.  Metrics are of one readout, on the test part of each evaluated corpus."""
    spark, run = maps.sparkSession, run_name(tag, pool)
    q = round(source_fs / config.fs)
    rows = maps.withColumn("x", per_array(fir_decimate, "x", "array<double>", q=q)) if q > 1 else maps
    flat = training.flat_maps(rows)
    sessions = manifest.select("dataset", "sid")
    members = splits.pool(split, sessions, list(pool)).select(F.lit(run).alias("run"), "sid", "part")
    losses, _ = training.train_grid(flat, members, seeds, store, config)
    wanted = {f"{run}_s{s}" for s in seeds}
    weights = {k: v for k, v in training.stored_weights(spark, store).items() if k in wanted}
    test = split.where((F.col("part") == "test") & F.col("dataset").isin(list(evaluated))).select("dataset", "sid").distinct()
    scored = flat.join(test.select("sid").distinct(), "sid", "left_semi")
    predictions = scoring.predict_runs(scored, weights, config.fs, config.clip, config.low, config.high, LEAST_SCORED)
    sets = test.select(F.explode(F.array(*map(F.lit, sorted(wanted)))).alias("run"), "dataset", F.lit("test").alias("subset"), "sid")
    cells = metrics.run_cells(predictions.where(F.col("readout") == readout).drop("readout"), sets, manifest)
    own = F.col("run") == run
    return Experiment(losses.where(own), training.best_epochs(spark, store).where(own), predictions, cells)
