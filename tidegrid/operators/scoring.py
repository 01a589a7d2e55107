"""Batch scoring of maps with networks whose weights are broadcast (their size is fixed by their layers)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physnet, signal

READOUTS = ("psd_sum", "mean", "median", "snr_mean")


def parameter_counts(weights: DataFrame, model: str, values: str) -> DataFrame:
    """Tensors and parameters of each model from a table of its weights, one flat array a row."""
    return weights.groupBy(model).agg(F.count("*").alias("tensors"), F.sum(F.size(values)).cast("long").alias("n_parameters"))


def _rates(m: np.ndarray | None, found: physnet.Weights, fs: float, clip: int, low: float, high: float) -> list[float]:
    """The four rates of one map (channels, T); NaN without one that the network takes."""
    if m is None or m.shape[0] < physnet.LEAST_CHANNELS or m.shape[1] < 2:
        return [float("nan")] * len(READOUTS)
    wave = physnet.forward((m - m.mean()) / (m.std() + 1e-6), found)
    return signal.readouts(wave.astype(float), clip, fs, 1.0, 4096, low, high)


def _scored(rows: DataFrame, weights: Mapping[str, physnet.Weights], fs: float, clip: int, low: float, high: float) -> DataFrame:
    """(run, sid, readout, bpm) of rows (sid, channels, x); a rate that does not exist is NaN, not null."""
    shared = rows.sparkSession.sparkContext.broadcast({k: dict(v) for k, v in weights.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, runs, at, names, rates = batch.column("x"), [], [], [], []
            for k, channels in enumerate(batch.column("channels").to_pylist()):
                values = x[k].values
                n = 0 if values is None or not channels else len(values) // channels
                m = values.to_numpy(zero_copy_only=False)[: n * channels].astype(np.float32).reshape(channels, n) if n else None
                for name, found in shared.value.items():
                    runs, at = runs + [name] * len(READOUTS), at + [k] * len(READOUTS)
                    names, rates = names + list(READOUTS), rates + _rates(m, found, fs, clip, low, high)
            if runs:
                columns = [pa.array(runs), batch.column("sid").take(pa.array(at)), pa.array(names), pa.array(rates, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "sid", "readout", "bpm"])

    kind = rows.schema["sid"].dataType.simpleString()
    return rows.select("sid", "channels", "x").mapInArrow(score, f"run string, sid {kind}, readout string, bpm double")


def predict_runs(maps: DataFrame, weights: Mapping[str, physnet.Weights], fs: float, clip: int, low: float, high: float, least: int = 0) -> DataFrame:
    """Long form (run, sid, readout, bpm) of maps (sid, channels, x) by every network; maps of fewer than ``least`` columns are
    left out."""
    long = maps.where((F.col("channels") > 0) & (F.size("x") >= F.col("channels") * max(1, least)))
    return _scored(long, weights, fs, clip, low, high)


def score_maps(maps: DataFrame, sid: str, x: str, channels: int, weights: physnet.Weights, fs: float, clip: int, low: float, high: float) -> DataFrame:
    """Long form (sid, readout, bpm) of maps stored row after row in one array, by running statistics; too small maps get NaN."""
    rows = maps.select(F.col(sid).alias("sid"), F.lit(channels).alias("channels"), F.col(x).alias("x"))
    return _scored(rows, {"": weights}, fs, clip, low, high).select(F.col("sid").alias(sid), "readout", "bpm")
