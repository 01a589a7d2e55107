"""Readers of corpora by name: a catalogue, its frames, and its reference rates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references
from . import avi, corpora, hdf5, images

#: Facts of sessions that go into the manifest where a corpus has them.
DESCRIPTORS = {"trial": "string", "task": "string", "task_name": "string", "head_motion": "boolean", "illumination": "string", "part": "string", "duration_s": "double", "stim_span_s": "double"}


@dataclass(frozen=True)
class Reader:
    """How to list a corpus, read its frames (none where its video needs a decoder) and its reference rates."""

    sessions: Callable[..., DataFrame]
    frames: Callable[..., DataFrame] | None
    reference: Callable[..., DataFrame]


READERS = {
    "cohface": Reader(corpora.cohface, None, references.held_belt),
    "mahnob": Reader(corpora.mahnob, None, references.stimulus_belt),
    "pure": Reader(corpora.pure, images.image_frames, references.unlabelled),
    "ubfc": Reader(corpora.ubfc, avi.read_frames, references.unlabelled),
    "vitalvideo": Reader(corpora.vitalvideo, None, references.unlabelled),
}


def reader(name: str) -> Reader:
    if name not in READERS:
        raise KeyError(f"unknown corpus {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name]


def register(name: str, own: Reader) -> None:
    """Makes a further corpus known; a name is taken once."""
    if name in READERS:
        raise ValueError(f"{name!r} is taken")
    READERS[name] = own


def cohface_files(spark: SparkSession, root: str, probes: DataFrame) -> DataFrame:
    """The catalogue with lights and reference rates from the recordings below ``root``; a rate is null, with the reason in
    ``rate_error``, where the recording cannot be read."""
    sessions = corpora.cohface(corpora.files(spark, root), probes, corpora.recorded_lights(hdf5.root_attributes(spark, root)))
    belts = hdf5.read_series(hdf5.chunk_index(spark, root, "respiration"), references.HOLD)
    rates = references.held_belt(belts, "x", corpora.BELT_FS, hold=1)
    return sessions.join(rates.select(F.col("path").alias("hdf5"), "gt_rr", F.col("error").alias("rate_error")), "hdf5", "left")


def manifest_rows(sessions: DataFrame) -> DataFrame:
    """sid, dataset, subject, fps_src and all descriptors of a catalogue; those that it lacks are null."""
    carried = [(F.col(c) if c in sessions.columns else F.lit(None)).cast(kind).alias(c) for c, kind in DESCRIPTORS.items()]
    return sessions.select("sid", "dataset", F.col("subject").cast("string").alias("subject"), F.col("fps").cast("double").alias("fps_src"), *carried)
