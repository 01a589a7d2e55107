"""Maps of a corpus, as a store that runs may be broken off and taken up again: two keyed tables, maps and records.

Sessions whose map is stored are not worked on and become ``cached``; of the rest, what fails or has no frames is tried in
a second wave.  Maps are added before records, so a run that ends between the two is mended by the next one.

Defined results: a session that ends in an error or is skipped has a record and no map; with ``force`` the sessions that
are worked on replace what is stored of them, and no others; ``limit`` takes the first sessions of each dataset by sid,
after ``retry_skipped`` has left those that are done already out; a reference rate that is not finite is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import maps
from .operators.catalog import first_per_group, retry_selection
from .operators.metrics import finite
from .sources import avi, map_store, readers

MAPS = "sid string, roi int, x array<double>, dataset string"
RECORDS = (
    "sid string, subject string, fps_src double, " + ", ".join(f"{c} {kind}" for c, kind in readers.DESCRIPTORS.items())
    + ", gt_rr double, status string, reason string, T int, wave int, dataset string"
)


def records(spark: SparkSession, out: str) -> DataFrame:
    """The manifest of a store."""
    return map_store.stored(spark, f"{out}/records", RECORDS)


def stored_maps(spark: SparkSession, out: str) -> DataFrame:
    return map_store.stored(spark, f"{out}/maps", MAPS)


def _record(attempts: DataFrame) -> DataFrame:
    """Attempts (the columns of sessions with status, reason, T and wave) in the columns of a record."""
    own = readers.manifest_rows(attempts.withColumn("subject", F.col("subject") if "subject" in attempts.columns else F.lit(None)))
    rate = F.when(finite(F.col("gt_rr")), F.col("gt_rr")) if "gt_rr" in attempts.columns else F.lit(None)
    told = attempts.select("sid", rate.cast("double").alias("gt_rr"), "status", "reason", F.col("T").cast("int").alias("T"), F.col("wave").cast("int").alias("wave"))
    rated = F.when(F.col("status").isin("ok", "cached"), F.col("gt_rr"))
    rows = own.join(told, "sid").withColumn("gt_rr", rated)
    return rows.select(*[f.split()[0] for f in RECORDS.split(", ")])


def build_maps(
    sessions: DataFrame, frames_of: Callable[[DataFrame], DataFrame], detections: DataFrame, out: str, limit: int | None = None, retry_skipped: bool = False, force: bool = False, **settings
) -> DataFrame:
    """Builds the maps of sessions (sid, dataset, width, height, fps, and what else is known) below ``out``; the records of all
    sessions there, old and new.  ``settings`` go to ``maps.session_maps_in_waves``."""
    spark = sessions.sparkSession
    todo = retry_selection(sessions, records(spark, out)) if retry_skipped else sessions
    todo = todo if limit is None else first_per_group(todo, "dataset", "sid", limit)
    lengths = stored_maps(spark, out).groupBy("sid").agg(F.max(F.size("x")).alias("T"))
    work = todo if force else todo.join(lengths.select("sid"), "sid", "left_anti")
    told, found = maps.session_maps_in_waves(work, frames_of, detections, **settings)
    cached = todo.join(lengths, "sid").withColumns({"status": F.lit("cached"), "reason": F.lit(None).cast("string"), "wave": F.lit(0)})
    new = maps.written(_record(told) if force else _record(told).unionByName(_record(cached)), "attempts")  # before the store has the new maps
    named = found.join(sessions.select("sid", "dataset"), "sid").select("sid", "roi", "x", "dataset")
    if force:
        map_store.upsert(named, f"{out}/maps")
    else:
        map_store.add(named, f"{out}/maps")
    map_store.upsert(new, f"{out}/records")
    return records(spark, out)


def video_maps(sessions: DataFrame, videos: str, detections: DataFrame, out: str, readers_at_once: int | None = None, **settings) -> DataFrame:
    """``build_maps`` of sessions (sid, dataset, fps, video) with raw AVI files below ``videos``, whose frames are found by an index
    that is kept below ``out``; ``readers_at_once`` bounds the tasks that read a store at a time."""
    index = avi.extended_index(sessions.sparkSession, videos, f"{out}/index")
    sizes = index.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    sized = sessions.drop("width", "height").join(sizes.withColumnRenamed("path", "video"), "video", "left")

    def frames_of(wanted: DataFrame) -> DataFrame:
        named = wanted.select(F.col("video").alias("path"), "sid")
        frames = avi.read_frames(index.join(named.select("path").distinct(), "path", "left_semi"), readers=readers_at_once)
        few = named.limit(maps.MOST_SESSIONS + 1).count() <= maps.MOST_SESSIONS
        return frames.join(F.broadcast(named) if few else named, "path").drop("path")

    return build_maps(sized, frames_of, detections, out, **settings)
