"""From frames to spatio-temporal maps: box, grey crop, motion between neighbours, block means, target rate.

Raw frames are read once and never shuffled: boxes, one a session, are broadcast behind a check of their number, and what
is left of a frame is its crop of a few kilobytes.  Motion is taken over ranges of SPAN frames, each with the last frame
of the one before, so a long video spreads over many tasks and a task holds one range.  Crops and block means are written
to the shared folder between the steps, so no step is done twice.

What goes wrong with a frame, a pair of frames or a series becomes an error row, which reaches the status and reason of
its session and fails nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import frames as pixels
from ..functions import signal
from .catalog import with_status
from .geometry import expand_box, median_box
from .scratch import shared_folder
from .timeseries import to_series

#: Frames of a range, and sessions whose boxes are broadcast; with more, crops are joined by session.
SPAN = 256
MOST_SESSIONS = 500_000


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def boxes(sessions: DataFrame, detections: DataFrame, whole: bool = False, scale: float = DEFAULT.box_scale) -> DataFrame:
    """Adds box (x0, y0, x1, y1) to sessions (sid, width, height): around the median of the best detections, or the whole frame
    where frames are cropped already; null without a detection."""
    if whole:
        return sessions.withColumn("box", F.array(F.lit(0), F.lit(0), F.col("width").cast("int"), F.col("height").cast("int")))
    middle = median_box(detections, ["sid"], "frame", ["x", "y", "w", "h"], "score").drop("n_frames")
    corners = F.array(*expand_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"), scale))
    return sessions.join(middle, "sid", "left").withColumn("box", F.when(F.col("x").isNotNull(), corners)).drop("x", "y", "w", "h")


def crops(frames: DataFrame, boxed: DataFrame, side: int = DEFAULT.crop) -> DataFrame:
    """Rows (sid, frame, grey, error), one for each frame (sid, frame, width, height, bgr): side x side bytes, null without a box
    or for an empty one; an exception becomes its class and message."""

    @F.pandas_udf("grey binary, error string")
    def crop(width: pd.Series, height: pd.Series, bgr: pd.Series, box: pd.Series) -> pd.DataFrame:
        out = []
        for w, h, data, corners in zip(width, height, bgr, box):
            try:
                if data is None:
                    raise OSError("the frame was not read")
                grey = None if corners is None else pixels.grey_crop(np.frombuffer(data, np.uint8).reshape(h, w, 3), tuple(corners), side)
                out.append((None if grey is None else grey.tobytes(), None))
            except Exception as error:  # noqa: BLE001  told in the row
                out.append((None, _told(error)))
        return pd.DataFrame(out, columns=["grey", "error"])

    known = boxed.where("box is not null").select("sid", "box")
    known = F.broadcast(known) if known.limit(MOST_SESSIONS + 1).count() <= MOST_SESSIONS else known
    return frames.join(known, "sid", "left").select("sid", "frame", crop("width", "height", "bgr", "box").alias("c")).select("sid", "frame", "c.grey", "c.error")


def with_halo(crops_: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (sid, range, frame, grey, halo): every readable crop in its range, and in each range but a session's first one also
    the last readable crop before it, however many frames are missing between."""
    rows = crops_.where("grey is not null").withColumn("range", F.floor(F.col("frame") / span))
    before = Window.partitionBy("sid").orderBy("range")
    edges = rows.groupBy("sid", "range").agg(F.max("frame").alias("last")).withColumn("frame", F.lag("last").over(before))  # a row a range
    halo = rows.drop("range").join(edges.where("frame is not null").select("sid", "range", "frame"), ["sid", "frame"])
    columns = ["sid", "range", "frame", "grey"]
    return rows.select(*columns, F.lit(False).alias("halo")).unionByName(halo.select(*columns, F.lit(True).alias("halo")))


def motion_columns(crops_: DataFrame, side: int = DEFAULT.crop, grid: int = DEFAULT.grid, span: int = SPAN) -> DataFrame:
    """Rows (sid, frame, means, error): block means of the vertical motion from each crop to the next one of its session."""

    @F.pandas_udf("means array<double>, error string")
    def between(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        out, image = [], lambda x: np.frombuffer(x, np.uint8).reshape(side, side)
        for a, b in zip(one, two):
            try:
                out.append((pixels.block_means(pixels.motion(image(a), image(b))[..., 1], grid), None))
            except Exception as error:  # noqa: BLE001  told in the row
                out.append((None, _told(error)))
        return pd.DataFrame(out, columns=["means", "error"])

    order = Window.partitionBy("sid", "range").orderBy("frame")
    pairs = with_halo(crops_, span).withColumn("before", F.lag("grey").over(order)).where(~F.col("halo") & F.col("before").isNotNull())
    return pairs.select("sid", "frame", between("before", "grey").alias("m")).select("sid", "frame", "m.means", "m.error")


def session_maps(
    sessions: DataFrame, frames: DataFrame, detections: DataFrame, side: int = DEFAULT.crop, grid: int = DEFAULT.grid, target: float = DEFAULT.fs, least_s: float = 5.0,
    whole: bool = False, span: int = SPAN,
) -> tuple[DataFrame, DataFrame]:
    """(records, maps): a record (sid, status, reason, T, ...) of each session (sid, width, height, fps), and maps (sid, roi, x) of
    those that are ok, at the target rate."""
    boxed = boxes(sessions, detections, whole)
    cropped = written(crops(frames, boxed, side), "crops")
    means = written(motion_columns(cropped, side, grid, span), "means")
    long = means.where("means is not null").select("sid", "frame", F.posexplode("means").alias("roi", "v"))
    series = to_series(long, ["sid", "roi"], ["frame"], "v").join(sessions.select("sid", "fps"), "sid")

    @F.pandas_udf("x array<double>, error string")
    def resampled(x: pd.Series, fps: pd.Series) -> pd.DataFrame:
        out = []
        for v, f in zip(x, fps):
            try:
                out.append((signal.resample_linear(np.asarray(v, float), f, target), None))
            except Exception as error:  # noqa: BLE001  told in the row
                out.append((None, _told(error)))
        return pd.DataFrame(out, columns=["x", "error"])

    rows = series.select("sid", "roi", resampled("x", "fps").alias("r")).select("sid", "roi", "r.x", "r.error")
    found = cropped.groupBy("sid").agg(F.count("*").alias("n_frames"), F.max("error").alias("crop_error"))
    moved = means.groupBy("sid").agg(F.max("error").alias("motion_error"))
    lengths = rows.groupBy("sid").agg(F.max(F.size("x")).alias("T"), F.max("error").alias("rate_error"))
    work = boxed.join(found, "sid", "left").join(moved, "sid", "left").join(lengths, "sid", "left")
    error = F.coalesce("crop_error", "motion_error", "rate_error")
    short = F.least(F.col("box")[2] - F.col("box")[0], F.col("box")[3] - F.col("box")[1])
    told = work.withColumns({"stored": F.lit(False), "side": short, "error": error, "T": F.when(F.col("T") > 0, F.col("T"))})
    records = with_status(told, 1 if whole else 32, int(least_s * target)).drop("stored", "side", "error", "crop_error", "motion_error", "rate_error")
    return records, rows.join(records.where("status = 'ok'").select("sid"), "sid", "left_semi").select("sid", "roi", "x")


def session_maps_in_waves(
    sessions: DataFrame, frames_of: Callable[[DataFrame], DataFrame], detections: DataFrame, waves: int = 2, wait_s: float = 1.0, **settings
) -> tuple[DataFrame, DataFrame]:
    """``session_maps`` of all sessions, then again of those that ended in an error or without frames, as busy stores leave them;
    ``frames_of`` reads the frames of the sessions that it is given.  Records have also the wave they come from.

    Each wave reads the frames of its own sessions only, and its records and maps are written before the next one.
    """
    todo = sessions
    records: DataFrame | None = None
    maps: DataFrame | None = None
    for wave in range(1, waves + 1):
        told, found = session_maps(todo, frames_of(todo), detections, **settings)
        told, found = written(told.withColumn("wave", F.lit(wave)), "records"), written(found, "maps")
        again = (F.col("status") == "error") | (F.col("reason") == "no_frames")
        failed = told.where(again) if wave < waves else told.limit(0)
        kept = told.join(failed.select("sid"), "sid", "left_anti")
        records = kept if records is None else records.unionByName(kept)
        maps = found if maps is None else maps.unionByName(found)
        if failed.isEmpty():
            break
        todo = written(todo.join(failed.select("sid"), "sid", "left_semi"), "sessions")
        time.sleep(wait_s)
    return records, maps
