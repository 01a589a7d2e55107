"""Boxes around faces and the maps computed inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def best_detection(detections: DataFrame, by: Sequence[str], box: Sequence[str], score: str) -> DataFrame:
    """The detection with the highest score of each frame; equal scores go to the least box."""
    best = F.min(F.struct((-F.col(score)).alias("s"), *box)).alias("b")
    return detections.where(F.col(score).isNotNull()).groupBy(*by).agg(best).select(*by, *[F.col(f"b.{c}").alias(c) for c in box])


def median_box(detections: DataFrame, session: Sequence[str], frame: str, box: Sequence[str], score: str) -> DataFrame:
    """Median of each coordinate over the frames' best detections; sessions without one are absent."""
    best = best_detection(detections, [*session, frame], box, score)
    return best.groupBy(*session).agg(*[F.median(c).alias(c) for c in box], F.count("*").alias("n_frames"))


def expand_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, scale: float = DEFAULT.box_scale) -> tuple[Column, Column, Column, Column]:
    """Square of ``scale`` times the longer side about the centre, rounded half to even, clamped to the frame."""
    half = F.greatest(w, h) * scale / 2
    cx, cy = x + w / 2.0, y + h / 2.0
    low = lambda c: F.greatest(F.lit(0), F.bround(c - half).cast("int"))
    high = lambda c, most: F.least(most, F.bround(c + half).cast("int"))
    return low(cx), low(cy), high(cx, width), high(cy, height)
