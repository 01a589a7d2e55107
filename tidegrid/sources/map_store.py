"""A sink of keyed rows, as maps of sessions, that a lost task or a second run leaves neither halved nor doubled.

A job writes Parquet files of its own under ``data``; what counts is the list of files that it adds at its end, one JSON
file under ``commits``.  Files of task attempts that failed, or that ran twice, are in no list and are deleted.  A job
that ends after another one has added a list since it began gives up, as its rows may be there by now, and leaves the
store as it was.

Defined results: all rows of a new key are added, repeated ones too, and none of a stored key; null keys are never stored
keys; null parts have a folder of their own; an empty job adds an empty list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import _opened

#: Folder of rows whose part is null, as Spark reads it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Changed(RuntimeError):
    """Another job has added to the store in the meantime."""


def _lists(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.path.endswith(".json"))


def version(path: str) -> int:
    """How many lists the store has."""
    return len(_lists(*_opened(path)))


def _files(store: fs.FileSystem, root: str) -> list[str]:
    """Files that count: those of the last list that replaces the ones before, and of all later ones."""
    out: list[str] = []
    for path in _lists(store, root):
        with store.open_input_file(path) as file:
            told = json.loads(file.read())
        out = told["files"] if told["replaces"] else out + told["files"]
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, part: str, replaces: bool, seen: int | None = None):
        self.path, self.part, self.replaces, self.job = path, part, replaces, uuid.uuid4().hex
        self.seen = version(path) if seen is None else seen

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each run of rows of one part; batches are written as they come."""
        store, root = _opened(self.path)
        files: list[str] = []
        name, writer = None, None
        try:
            for batch in iterator:
                own = batch.column(self.part)
                rest = batch.drop_columns([self.part])
                for value in pc.unique(own).to_pylist():
                    chosen = rest.filter(pc.is_null(own) if value is None else pc.fill_null(pc.equal(own, value), False))
                    folder = f"{self.part}={NO_VALUE if value is None else quote(str(value), safe='')}"
                    if folder != name:
                        if writer:
                            writer.close()
                        name, files = folder, [*files, f"{folder}/{self.job}-{uuid.uuid4().hex}.parquet"]
                        store.create_dir(f"{root}/data/{folder}")
                        writer = pq.ParquetWriter(f"{root}/data/{files[-1]}", chosen.schema, filesystem=store)
                    writer.write_batch(chosen)
        finally:
            if writer:
                writer.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        if len(_lists(store, root)) != self.seen:
            self._clear(store, root, set())
            raise Changed(f"{self.path} has changed since the job began; nothing was added")
        self._clear(store, root, set(files))
        store.create_dir(f"{root}/commits")
        with store.open_output_stream(f"{root}/commits/{self.job}.part") as out:
            out.write(json.dumps({"replaces": self.replaces, "files": files}).encode())
        store.move(f"{root}/commits/{self.job}.part", f"{root}/commits/{self.seen:08d}-{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path), set())

    def _clear(self, store: fs.FileSystem, root: str, kept: set[str]) -> None:
        """Deletes what tasks of this job have left, but for the files that are kept."""
        for info in store.get_file_info(fs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
            place = "/".join(info.path.split("/")[-2:])
            if info.is_file and info.base_name.startswith(self.job) and place not in kept:
                store.delete_file(info.path)


class KeyedSink(DataSource):
    """Options: path, part (the column that names folders), seen (the version that the rows were chosen by)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_rows"

    def writer(self, schema: StructType, overwrite: bool) -> KeyedWriter:
        seen = self.options.get("seen")
        return KeyedWriter(self.options["path"], self.options.get("part", "dataset"), overwrite, None if seen is None else int(seen))


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows that count, parts pruned by folder; none where nothing was added yet."""
    store, root = _opened(path)
    files = _files(store, root)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in files])


def _save(rows: DataFrame, path: str, key: str, part: str, seen: int, replaces: bool) -> None:
    ordered = rows.sortWithinPartitions(part, key)
    ordered.write.format("keyed_rows").mode("overwrite" if replaces else "append").option("part", part).option("seen", seen).save(path)


def add(rows: DataFrame, path: str, key: str = "sid", part: str = "dataset", force: bool = False) -> None:
    """Adds the rows whose key is not stored yet; with ``force`` the rows replace all that is stored."""
    rows.sparkSession.dataSource.register(KeyedSink)
    seen = version(path)
    new = rows if force else rows.join(stored(rows.sparkSession, path, rows.schema).select(key).distinct(), key, "left_anti").select(*rows.columns)
    _save(new, path, key, part, seen, force)


def upsert(rows: DataFrame, path: str, key: str = "sid", part: str = "dataset") -> None:
    """Rows by key, new ones winning over stored ones; readers see the table before or after, nothing between."""
    rows.sparkSession.dataSource.register(KeyedSink)
    seen = version(path)
    old = stored(rows.sparkSession, path, rows.schema).join(rows.select(key), key, "left_anti").select(*rows.columns)
    _save(old.unionByName(rows), path, key, part, seen, True)
