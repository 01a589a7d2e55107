"""Reference rates of the corpora from their respiration recordings; null where a recording cannot tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import signal
from .spectral import belt_rate, per_array

# The belt's idle level, seconds that a recording must have, and the stride that undoes a zero-order hold.
IDLE, LEAST_BELT_S, LEAST_S, HOLD = 16, 10.0, 20.0, 8


def clip_by_time(x: Column, fs: Column | float, start_s: Column, end_s: Column) -> Column:
    """The samples from start to before end, both rounded half to even to places; nothing outside of the series."""
    place = lambda t: F.greatest(F.lit(0), F.bround(t * fs).cast("int"))
    return F.slice(x, place(start_s) + 1, F.greatest(F.lit(0), place(end_s) - place(start_s)))


def drop_idle(x: Column, idle: float = IDLE) -> Column:
    """Without leading and trailing runs of the idle value; inner runs stay, a wholly idle series is empty."""
    live = F.filter(F.transform(x, lambda v, i: F.when(v != idle, i)), lambda i: i.isNotNull())
    first, last = F.element_at(live, 1), F.element_at(live, -1)
    return F.when(F.size(live) == 0, F.slice(x, 1, 0)).otherwise(F.slice(x, first + 1, last - first + 1))


def held_belt(rows: DataFrame, x: str, fs: float = 32.0, hold: int = HOLD) -> DataFrame:
    """gt_rr of recordings that repeat every sample ``hold`` times (1: read by strides): 20 s at least, finite, not constant."""
    own = rows.withColumn("_x", F.filter(x, lambda v, i: i % hold == 0) if hold > 1 else F.col(x))
    return belt_rate(own, "_x", fs, LEAST_S).drop("_x")


def stimulus_belt(rows: DataFrame, x: str, fs: str, start_s: str, end_s: str, target: float = DEFAULT.fs) -> DataFrame:
    """gt_rr over the stimulus window: clipped, without idle ends, 10 s at least, brought to the analysis rate."""
    part = drop_idle(clip_by_time(F.col(x), F.col(fs), F.col(start_s), F.col(end_s)))
    own = rows.withColumn("_w", part).withColumn("_n", F.bround(F.size("_w") / F.col(fs) * target).cast("int"))
    long_enough = (F.size("_w") >= F.floor(LEAST_BELT_S * F.col(fs))) & (F.col("_n") >= 2)
    own = own.withColumn("_w", F.when(long_enough, F.concat(F.array(F.col("_n").cast("double")), F.transform("_w", lambda v: v.cast("double")))))
    rate = per_array(lambda v: signal.breathing_rate(signal.fourier_resample(v[1:], int(v[0])), target, DEFAULT.low, DEFAULT.high, 2), "_w", "double")
    return own.withColumn("gt_rr", rate).drop("_w", "_n")


def unlabelled(rows: DataFrame) -> DataFrame:
    """Corpora without a respiration recording."""
    return rows.withColumn("gt_rr", F.lit(None).cast("double"))
