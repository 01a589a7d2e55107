"""Uncompressed 24-bit AVI files: an index of their frames, made in tasks, and the frames in ranges of it.

Files can be far larger than one row may be, so frames are read by their places: ``frame_index`` walks the headers of the
container's chunks, one file a task, and ``read_frames`` reads what a plan asks for.  The index is a table like any other
and can be kept: ``extended_index`` walks only files that are new or changed.  ``register(spark)`` makes the same known as
"raw_avi", with files and ranges of frames pushed down to it.
"""

from __future__ import annotations

import fnmatch
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import ranges

FRAMES = "path string, frame int, width int, height int, bgr binary"
INDEX = "path string, frame int, place long, width int, height int, fps double, declared long, bottom_up boolean"
PER_PARTITION = 256
#: Bytes of a file that one task of the data source reads.
SPLIT = 256 << 20


@dataclass
class Layout:
    width: int
    height: int
    fps: float
    declared: int
    bottom_up: bool

    @property
    def frame_size(self) -> int:
        return (self.width * 3 + 3) // 4 * 4 * self.height


def layout(path: str) -> Layout | None:
    """From the headers; None unless the first stream is uncompressed 24-bit video."""
    with ranges.opened(path) as file:
        head = file.read(1 << 16)
    if head[:4] != b"RIFF" or head[8:12] != b"AVI ":
        return None
    stream, form = head.find(b"strh"), head.find(b"strf")
    if stream < 0 or form < stream or head[stream + 8 : stream + 12] != b"vids":
        return None
    scale, rate, _, declared = struct.unpack("<4I", head[stream + 28 : stream + 44])
    _, width, height, _, bits, compression = struct.unpack("<IiiHHI", head[form + 8 : form + 28])
    if bits != 24 or compression != 0 or width <= 0 or height == 0 or scale == 0:
        return None
    return Layout(width, abs(height), rate / scale, declared, height > 0)


def offsets(path: str, found: Layout, upto: int | None = None) -> list[int]:
    """Where frames begin, over all RIFF segments, up to the first chunk that cannot be right: no name, or a frame that is too
    short or beyond the end.  Only then is the last frame checked, and left out if an eighth of it is trailing zeros: it
    is where a file was cut off and padded.  What follows the last segment, such as padding, ends a file without doubt
    about its frames.  ``upto`` ends the walk at that place of the file."""
    end_of_file, out = ranges.size(path), []
    with ranges.opened(path) as file:

        def walk(at: int, end: int) -> bool:
            while at + 8 <= end and (upto is None or at < upto):
                file.seek(at)
                name, length = struct.unpack("<4sI", file.read(8))
                if not all(32 <= b < 127 for b in name):
                    return False
                if name == b"LIST":
                    if not walk(at + 12, min(end, at + 8 + length)):
                        return False
                elif name[2:] in (b"db", b"dc") and name[:2].isdigit():
                    if length < found.frame_size or at + 8 + found.frame_size > end_of_file:
                        return False
                    out.append(at + 8)
                at += 8 + length + length % 2
            return True

        at, whole = 0, True
        while whole and at + 12 <= end_of_file and (upto is None or at < upto):
            file.seek(at)
            name, length = struct.unpack("<4sI", file.read(8))
            if name != b"RIFF":
                break
            whole = walk(at + 12, min(end_of_file, at + 8 + length))
            at += 8 + length + length % 2
        if not whole and out:
            file.seek(out[-1])
            last = file.read(found.frame_size)
            if len(last) - len(last.rstrip(b"\0")) >= found.frame_size // 8:
                out.pop()
    return out


def frame(file, place: int, found: Layout) -> bytes:
    """Rows of BGR from the top, without padding."""
    row = found.frame_size // found.height
    file.seek(place)
    data = file.read(found.frame_size)
    lines = [data[r * row : r * row + 3 * found.width] for r in range(found.height)]
    return b"".join(lines[::-1] if found.bottom_up else lines)


def frame_index(spark: SparkSession, root: str, pattern: str = "*.avi") -> DataFrame:
    """One row for each frame of each readable file; Spark lists the files, tasks walk them."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows["path"]:
                try:
                    found = layout(path)
                    places = offsets(path, found) if found else []
                except (OSError, struct.error):
                    continue  # files that cannot be read have no frames
                for a in range(0, len(places), 100_000):
                    part = places[a : a + 100_000]
                    yield pd.DataFrame({"path": path, "frame": range(a, a + len(part)), "place": part, "width": found.width, "height": found.height, "fps": found.fps, "declared": found.declared, "bottom_up": found.bottom_up})

    return _files(spark, root, pattern).select("path").repartition("path").mapInPandas(walk, INDEX)


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, size and modified of the files, as Spark lists them; no file is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def extended_index(spark: SparkSession, root: str, store: str, pattern: str = "*.avi") -> DataFrame:
    """The frame index of all files of a folder, kept in ``store`` by path, size and time of modification: files that are new
    or changed are walked and added, all others come from the store; files that are gone are left out."""
    listed = _files(spark, root, pattern)
    schema = f"{INDEX}, size long, modified timestamp"
    try:
        kept = spark.read.schema(schema).parquet(store)
    except Exception as error:  # nothing is kept yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        kept = spark.createDataFrame([], schema)
    key = ["path", "size", "modified"]
    new = listed.join(kept.select(*key).distinct(), key, "left_anti")
    walked = new.repartition("path").select(*key).mapInPandas(_walked, schema)
    walked.write.mode("append").parquet(store)
    return spark.read.schema(schema).parquet(store).join(listed, key, "left_semi").where("frame >= 0").dropDuplicates(["path", "frame"]).select(*[c.split()[0] for c in INDEX.split(", ")])


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index rows of files with their size and time; a file without frames leaves one row of frame -1, so it is not walked again."""
    for rows in batches:
        for path, size, modified in zip(rows["path"], rows["size"], rows["modified"]):
            try:
                found = layout(path)
                places = offsets(path, found) if found else []
            except (OSError, struct.error):
                continue  # is tried again next time
            for part, first in [(places[a : a + 100_000], a) for a in range(0, len(places), 100_000)] or [([-1], -1)]:
                known = found or Layout(0, 0, 0.0, 0, False)
                yield pd.DataFrame({
                    "path": path, "frame": range(first, first + len(part)), "place": part, "width": known.width, "height": known.height, "fps": known.fps, "declared": known.declared,
                    "bottom_up": known.bottom_up, "size": size, "modified": modified,
                })


def headers(index: DataFrame) -> DataFrame:
    """One row for each file: what its header declares and how many frames were found."""
    return index.groupBy("path", "width", "height", "fps", "declared", "bottom_up").agg(F.count("*").alias("found"))


def read_frames(index: DataFrame, step: int = 1, most: int | None = None, readers: int | None = None) -> DataFrame:
    """The first ``most`` frames of each file, every step-th of them.  What is left out is not read; frames of a file that can
    no longer be read have null bytes.  ``readers`` bounds the tasks that read at a time where the store does not bear more."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, own in rows.groupby("path", sort=False):
                for a in range(0, len(own), 16):
                    part, pixels = own.iloc[a : a + 16], []
                    try:
                        with ranges.opened(path) as file:
                            pixels = [frame(file, r.place, Layout(r.width, r.height, r.fps, r.declared, r.bottom_up)) for r in part.itertuples()]
                    except OSError:  # frames without bytes, which become their session's error
                        pixels = [None] * len(part)
                    yield pd.DataFrame({"path": path, "frame": part["frame"], "width": part["width"], "height": part["height"], "bgr": pixels})

    chosen = index.where((F.col("frame") % step == 0) & (F.lit(True) if most is None else F.col("frame") < most))
    block = F.floor(F.col("frame") / (PER_PARTITION * step))
    dealt = chosen.repartition(readers, "path", block) if readers else chosen.repartition("path", block)
    return dealt.sortWithinPartitions("path", "frame").mapInPandas(read, FRAMES)


class FileRange(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class AviReader(DataSourceReader):
    """Files are listed when a query is planned, and walked where they are read: a task takes the frames that begin in its
    range of bytes, and walks the chunk headers before them."""

    def __init__(self, options: dict):
        self.pattern, self.step, self.most = options["path"], int(options.get("step", 1)), int(options.get("frames", 1 << 40))
        self.split = int(options.get("split", SPLIT))
        self.low, self.paths = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of frame and equality of path; Spark applies the others."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, value + isinstance(f, LessThanOrEqual))
            elif name == ("frame",) and isinstance(f, EqualTo):
                self.low, self.most = max(self.low, value), min(self.most, value + 1)
            elif name == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            else:
                yield f

    def partitions(self) -> list[FileRange]:
        folder, name = os.path.split(self.pattern)
        store, inner = ranges._opened(folder)
        parts = []
        for info in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path):
            path = f"{folder}/{info.base_name}"
            if info.is_file and fnmatch.fnmatch(info.base_name, name) and (self.paths is None or path in self.paths):
                parts += [FileRange(path, a, a + self.split) for a in range(0, info.size, self.split)]
        return parts or [FileRange("", 0, 0)]

    def read(self, part: FileRange) -> Iterator[tuple]:
        found = layout(part.path) if part.path and self.low < self.most else None
        if found is None:
            return
        # the next frame's place tells whether the last one is whole
        places = offsets(part.path, found, part.end + 2 * found.frame_size + 64)
        with ranges.opened(part.path) as file:
            for k, at in enumerate(places[: self.most]):
                if part.first <= at < part.end and k >= self.low and k % self.step == 0:
                    yield part.path, k, found.width, found.height, frame(file, at, found)


class AviSource(DataSource):
    """Options: path (a pattern), step (every so many frames), frames (the first so many), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "raw_avi"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> AviReader:
        return AviReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes "raw_avi" known to a session, and lets it push filters down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AviSource)
