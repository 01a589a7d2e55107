"""Spectra, peaks and rates.

Short transforms are sums of cosines and sines in Spark; long ones, recursive filters and resampling in the Fourier domain
are numpy functions over Arrow batches (see ``tidegrid.functions.signal``).  Bins are k * fs / n, limits of a band belong
to it, and the first of equal peaks counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import signal


def band_bins(fs: float, n: int, low: float, high: float) -> list[int]:
    return [k for k in range(n // 2 + 1) if low <= k * fs / n <= high]


def band_power(rows: DataFrame, by: Sequence[str], place: str, value: str, bins: Sequence[int], n: int, weight: Column | None = None) -> DataFrame:
    """p: squared magnitude of each bin of every series (long rows), mean-free, weighted if asked for, zero-padded to n.

    The mean is taken out of the sums afterwards, so one grouped aggregation with map-side sums does it all.
    """
    h, angle = F.lit(1.0) if weight is None else weight, lambda k: F.col(place).cast("double") * (2.0 * math.pi * k / n)
    sums = [F.avg(value).alias("_m")]
    for k in bins:
        for name, f in (("c", F.cos), ("s", F.sin)):
            sums += [F.sum(F.col(value) * h * f(angle(k))).alias(f"_{name}{k}"), F.sum(h * f(angle(k))).alias(f"_h{name}{k}")]
    part = lambda name, k: F.col(f"_{name}{k}") - F.col("_m") * F.col(f"_h{name}{k}")
    powers = [part("c", k) * part("c", k) + part("s", k) * part("s", k) for k in bins]
    return rows.groupBy(*by).agg(*sums).select(*by, F.array(*powers).alias("p"))


def window_powers(rows: DataFrame, x: str, width: int, step: int, bins: Sequence[int], n: int, taper: np.ndarray | None = None) -> DataFrame:
    """start and p (squared magnitude of each bin) of every window of an array, mean-free, tapered if asked for, zero-padded to n.

    Windows are cut and transformed where their series is, so nothing is shuffled.  A series shorter than the width is one
    window; an empty one has none.
    """

    @F.pandas_udf("array<struct<start:int,p:array<double>>>")
    def run(column: pd.Series) -> pd.Series:
        def each(v) -> list[dict]:
            if v is None or not len(v):
                return []
            v = np.asarray(v, float)
            own = min(width, len(v))
            parts = np.lib.stride_tricks.sliding_window_view(v, own)[:: max(1, step)]
            parts = parts - parts.mean(axis=1, keepdims=True)
            parts = parts if taper is None else parts * taper[:own]
            wave = np.exp(-2j * np.pi * np.outer(np.arange(own), bins) / n)
            return [{"start": k * max(1, step), "p": p} for k, p in enumerate(np.abs(parts @ wave) ** 2)]

        return column.map(each)

    kept = [c for c in rows.columns if c != x]
    return rows.select(*kept, F.explode(run(F.col(x))).alias("_w")).select(*kept, "_w.start", "_w.p")


def snr_weighted_rate(windows: DataFrame, by: Sequence[str], p: str, fs: float, n: int, first_bin: int, size: int) -> DataFrame:
    """Rate of a session without any training: the peaks of all its channels' windows, weighted by how far each stands out of
    its band."""
    peak, snr = peak_rate(F.col(p), fs, n, first_bin), F.array_max(p) / (median_of(F.col(p), size) + 1e-20)
    rows = windows.select(*by, peak.alias("_peak"), snr.alias("_snr"))
    return rows.groupBy(*by).agg((F.sum(F.col("_peak") * F.col("_snr")) / (F.sum("_snr") + 1e-20)).alias("bpm"), F.count("*").alias("n_windows"))


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v) + 1e-12
    return F.transform(p, lambda v: v / total)


def argmax(p: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def peak_rate(p: Column, fs: float, n: int, first_bin: int) -> Column:
    """Cycles a minute of the largest bin."""
    return (argmax(p) + first_bin) * fs / n * 60.0


def median_of(p: Column, size: int) -> Column:
    s = F.array_sort(p)
    return (s[(size - 1) // 2] + s[size // 2]) / 2.0


def readouts(windows: DataFrame, by: Sequence[str], p: str, fs: float, n: int, bins: list[int]) -> DataFrame:
    """psd_sum, mean, median and snr_mean of the windows of each series, from their band powers."""
    each = windows.select(*by, *[F.col(p)[i].alias(f"_p{i}") for i in range(len(bins))], peak_rate(F.col(p), fs, n, bins[0]).alias("peak"), (F.array_max(p) / (median_of(F.col(p), len(bins)) + 1e-20)).alias("snr"))
    sums = F.array(*[F.sum(f"_p{i}") for i in range(len(bins))]).alias("total")
    pooled = each.groupBy(*by).agg(sums, F.avg("peak").alias("mean"), F.median("peak").alias("median"), (F.sum(F.col("peak") * F.col("snr")) / (F.sum("snr") + 1e-20)).alias("snr_mean"), F.count("*").alias("n_windows"))
    return pooled.select(*by, "n_windows", peak_rate(F.col("total"), fs, n, bins[0]).alias("psd_sum"), "mean", "median", "snr_mean")


def per_array(name: Callable[..., np.ndarray], x: str, kind: str, **settings) -> Column:
    """A numpy function of one array, over Arrow batches; null for null arrays."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else name(np.asarray(v, float), **settings))

    return run(F.col(x))


def belt_rate(rows: DataFrame, x: str, fs: float, least_s: float, low: float = DEFAULT.low, high: float = DEFAULT.high) -> DataFrame:
    """Adds gt_rr, breaths a minute of a respiration recording; null if short, constant, not finite or without a band."""
    return rows.withColumn("gt_rr", per_array(signal.breathing_rate, x, "double", fs=fs, low=low, high=high, least=int(least_s * fs)))


def wave_readouts(rows: DataFrame, by: Sequence[str], x: str, fs: float, width: int, step_s: float = 1.0, nfft: int = 4096, low: float = DEFAULT.low, high: float = DEFAULT.high) -> DataFrame:
    """Long form (series, readout, bpm) with zero-padded transforms; NaN where a series has no window."""
    names = ("psd_sum", "mean", "median", "snr_mean")

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: signal.readouts(np.asarray([] if v is None else v, float), width, fs, step_s, nfft, low, high))

    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("readout"), run(F.col(x)).alias("bpm"))
    return rows.select(*by, F.explode(pairs).alias("r")).select(*by, "r.readout", F.coalesce("r.bpm", F.lit(float("nan"))).alias("bpm"))
