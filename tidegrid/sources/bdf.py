"""BDF recordings: headers as a table, and single channels read without the others.

Spark lists the files; tasks read headers, and of each record only the bytes of the channel that is asked for, so neither
the size of a recording nor its other channels matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import ranges

HEADER = "path string, n_records long, record_s double, labels array<string>, samples array<int>"


@dataclass(frozen=True)
class Header:
    n_records: int
    record_s: float
    labels: list[str]
    samples: list[int]

    @property
    def size(self) -> int:
        return 256 * (len(self.labels) + 1)


def parse_header(data: bytes) -> Header | None:
    """None for anything but a whole header."""
    try:
        if data[1:8] != b"BIOSEMI":
            return None
        n_records, record_s, n = int(data[236:244]), float(data[244:252]), int(data[252:256])
        if n <= 0 or record_s <= 0 or len(data) < 256 * (n + 1):
            return None
        labels = [data[256 + 16 * k : 272 + 16 * k].decode("latin-1").strip() for k in range(n)]
        at = 256 + 216 * n
        return Header(n_records, record_s, labels, [int(data[at + 8 * k : at + 8 * k + 8]) for k in range(n)])
    except ValueError:
        return None


def decode(raw: np.ndarray) -> np.ndarray:
    """24-bit little-endian two's complement."""
    raw = raw.reshape(-1, 3).astype(np.int64)
    value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    return value - ((value & 0x800000) << 1)


def _read_header(file) -> Header | None:
    file.seek(0)
    first = file.read(256)
    try:
        n = int(first[252:256])
    except ValueError:
        return None
    return parse_header(first + file.read(256 * n)) if n > 0 else None


def channel(file, label: str, size: int) -> tuple[np.ndarray, float] | None:
    """Samples and rate of one channel of an open file of ``size`` bytes: whole records only."""
    head = _read_header(file)
    if head is None or label not in head.labels:
        return None
    k = head.labels.index(label)
    width = 3 * sum(head.samples)
    n = (size - head.size) // width if width else 0
    n = min(head.n_records, n) if head.n_records >= 0 else n
    first, own = 3 * sum(head.samples[:k]), 3 * head.samples[k]
    raw = np.empty((n, own), np.uint8)
    for record in range(n):
        file.seek(head.size + record * width + first)
        raw[record] = np.frombuffer(file.read(own), np.uint8)
    return decode(raw), head.samples[k] / head.record_s


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each readable recording."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for p in rows["path"]:
                with ranges.opened(p) as file:
                    found.append((p, _read_header(file)))
            yield pd.DataFrame([(p, h.n_records, h.record_s, h.labels, h.samples) for p, h in found if h], columns=["path", "n_records", "record_s", "labels", "samples"])

    return _files(spark, path).mapInPandas(run, HEADER)


def read_channel(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Rows (path, fs, x) of the recordings that have the channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, size in zip(rows["path"], rows["length"]):
                with ranges.opened(p) as file:
                    found = channel(file, label, int(size))
                if found:
                    yield pd.DataFrame({"path": [p], "fs": [found[1]], "x": [found[0]]})

    return _files(spark, path).repartition("path").mapInPandas(run, "path string, fs double, x array<bigint>")
