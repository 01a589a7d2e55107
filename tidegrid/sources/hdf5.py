"""HDF5 recordings: series of a file as rows of chunks, and attributes of its root, without the rest of the file.

Spark lists the files.  A first step walks the metadata of each file by byte range, where a task runs, and tells where the
chunks of a dataset lie; a second step deals these chunks, so that a long recording is read by many tasks, and undoes
their filters.  Conditions on the index (``first``, ``count``, ``path``) decide what is read at all.

Known: superblocks 0 to 3, groups by symbol table or by links in their header, series (one axis longer than 1) of
integers and floats, stored compact, contiguous or in chunks of a B-tree, with the filters deflate, shuffle and Fletcher
checksum; attributes that are numbers, strings of fixed or variable length, or arrays of one.  What is not known, not
there or broken gives one row with an ``error``, and no exception; Spark lists no file without a byte, so these have no row.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

# Fixed values of the format: signature, message types, filters.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, TYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, SYMBOLS = 0x01, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
#: Contiguous series are read in pieces of so many bytes, so that their size does not matter; rows of the index in a batch.
PIECE, ROWS = 1 << 20, 4096

INDEX = "path string, dataset string, at long, stored long, first long, count long, total long, kind string, filters array<int>, error string"


class Broken(ValueError):
    """The file is not HDF5, ends too early, or has what this reader does not know."""


class Series(NamedTuple):
    kind: str
    total: int
    layout: bytes
    place: int
    filters: list[int]


def _number(data: bytes, at: int, width: int) -> int:
    if at + width > len(data):
        raise Broken("ends too early")
    return int.from_bytes(data[at : at + width], "little")


class File:
    """Metadata of one open file; ``read`` counts the bytes that were read."""

    def __init__(self, file):
        self.file, self.size, self.base, self.read = file, file.size(), 0, 0
        at = next((at for at in (0, 512, 1024, 2048) if at + 8 <= self.size and self.bytes(at, 8) == SIGNATURE), None)
        if at is None:
            raise Broken("no HDF5 file")
        version = self.bytes(at + 8, 1)[0]
        if version > 3:
            raise Broken(f"superblock {version}")
        self.o, self.n = tuple(self.bytes(at + (13 if version < 2 else 9), 2))
        if self.o not in (2, 4, 8) or self.n not in (2, 4, 8):
            raise Broken("widths of addresses")
        fields = at + (24 if version == 0 else 28 if version == 1 else 12)
        self.base = self.address(self.bytes(fields, self.o), 0) or 0
        # versions 0 and 1: four addresses, then the root's entry, whose second field is its header
        place = fields + (5 if version < 2 else 3) * self.o
        self.root = self.address(self.bytes(place, self.o), 0)

    def bytes(self, at: int | None, count: int) -> bytes:
        if at is None or at + count > self.size:
            raise Broken("ends too early")
        self.file.seek(at)
        data = self.file.read(count)
        self.read += len(data)
        return data

    def address(self, data: bytes, at: int) -> int | None:
        """None for the undefined address."""
        value = _number(data, at, self.o)
        return None if value == (1 << 8 * self.o) - 1 else value + self.base

    def messages(self, header: int) -> list[tuple[int, bytes, int]]:
        """(type, body, the body's place in the file) of the messages of an object header."""
        start = self.bytes(header, 16)
        if start[:4] == b"OHDR":
            flags = start[5]
            at, size = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10), 1 << (flags & 3)
            blocks = [(header + at + size, _number(self.bytes(header + at, size), 0, size))]
            form, skip, tail = "<BHB", 2 * bool(flags & 4), 4
        elif start[0] == 1:
            blocks, form, skip, tail = [(header + 16, _number(start, 8, 4))], "<HHB3x", 0, 0
        else:
            raise Broken("object header")
        out, seen, step = [], set(), struct.calcsize(form)
        while blocks:
            at, size = blocks.pop(0)
            if at in seen:
                raise Broken("header in a circle")
            seen.add(at)
            data, p = self.bytes(at, size), 0
            while p + step + skip <= len(data):
                kind, length = struct.unpack_from(form, data, p)[:2]
                body = data[p + step + skip : p + step + skip + length]
                p += step + skip + length
                if kind == MORE:
                    more = self.address(body, 0), _number(body, self.o, self.n)
                    blocks.append((more[0] + 4, more[1] - 4 - tail) if tail else more)
                else:
                    out.append((kind, body, at + p - length))
        return out

    def nodes(self, top: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a B-tree, in order; a node at a time."""
        stack, seen = [(top, None)], set()
        while stack:
            at, above = stack.pop()
            head = self.bytes(at, 8 + 2 * self.o)
            if head[:4] != b"TREE" or head[4] != kind or at in seen or above is not None and head[5] != above - 1:
                raise Broken("B-tree")
            seen.add(at)
            used, width = _number(head, 6, 2), key + self.o
            data = self.bytes(at + len(head), used * width)
            entries = [(data[k : k + key], self.address(data, k + key)) for k in range(0, len(data), width)]
            if head[5]:
                stack.extend((child, head[5]) for _, child in reversed(entries))
            else:
                yield from entries

    def members(self, group: int) -> Iterator[tuple[str, int]]:
        """(name, header) of what a group holds."""
        for kind, body, _ in self.messages(group):
            if kind == SYMBOLS:
                heap = self.bytes(self.address(body, self.o), 8 + 2 * self.n + self.o)
                if heap[:4] != b"HEAP":
                    raise Broken("local heap")
                names = self.bytes(self.address(heap, 8 + 2 * self.n), _number(heap, 8, self.n))
                for _, node in self.nodes(self.address(body, 0), 0, self.n):
                    head = self.bytes(node, 8)
                    if head[:4] != b"SNOD":
                        raise Broken("symbol node")
                    width = 2 * self.o + 24
                    data = self.bytes(node + 8, _number(head, 6, 2) * width)
                    for k in range(0, len(data), width):
                        yield names[_number(data, k, self.o) :].split(b"\0", 1)[0].decode("utf-8", "replace"), self.address(data, k + self.o)
            elif kind == LINK:
                flags, at = body[1], 2
                hard = not flags & 8 or body[at] == 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 0x10)
                size = 1 << (flags & 3)
                name = body[at + size : at + size + _number(body, at, size)]
                if hard:
                    yield name.decode("utf-8", "replace"), self.address(body, at + size + len(name))

    def find(self, path: str) -> int | None:
        at = self.root
        for name in filter(None, path.split("/")):
            at = next((header for own, header in self.members(at) if own == name), None)
            if at is None:
                return None
        return at

    def extent(self, body: bytes) -> list[int]:
        at = 8 if body[0] == 1 else 4
        return [_number(body, at + k * self.n, self.n) for k in range(body[1])]

    def series(self, header: int) -> Series:
        found = {kind: (body, place) for kind, body, place in self.messages(header)}
        if not {SPACE, TYPE, LAYOUT} <= found.keys():
            raise Broken("no dataset")
        extent = self.extent(found[SPACE][0])
        if not extent or sum(n > 1 for n in extent) > 1:
            raise Broken(f"no series: {len(extent)} axes")
        return Series(kind_of(found[TYPE][0]), math.prod(extent), *found[LAYOUT], filters_of(found[FILTERS][0] if FILTERS in found else b""))

    def chunks(self, own: Series) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """(place in the file, stored bytes, first element, elements, filters to undo, the last one first)."""
        width, layout = np.dtype(own.kind).itemsize, own.layout
        if layout[0] != 3 or layout[1] > 2:
            raise Broken(f"layout {layout[0]}.{layout[1]}")
        if layout[1] < 2:
            at = own.place + 4 if layout[1] == 0 else self.address(layout, 2)
            if at is None or at + own.total * width > self.size:
                raise Broken("ends too early")
            for first in range(0, own.total, PIECE // width):
                count = min(PIECE // width, own.total - first)
                yield at + first * width, count * width, first, count, []
            return
        rank, tree = layout[2], self.address(layout, 3)
        sizes = [_number(layout, 3 + self.o + 4 * k, 4) for k in range(rank)]
        axis = max(range(rank - 1), key=lambda k: sizes[k])
        if any(n > 1 for k, n in enumerate(sizes[:-1]) if k != axis):
            raise Broken("chunks of several axes")
        for key, at in self.nodes(tree, 1, 8 + 8 * rank) if tree is not None else ():
            first, skipped = _number(key, 8 + 8 * axis, 8), _number(key, 4, 4)
            undo = [f for k, f in enumerate(own.filters) if not skipped >> k & 1][::-1]
            if first < own.total:
                yield at, _number(key, 0, 4), first, min(sizes[axis], own.total - first), undo

    def attributes(self, header: int) -> Iterator[tuple[str, str | None]]:
        """(name, first value as text); null for what is empty or of a kind that is not known."""
        for kind, body, _ in self.messages(header):
            if kind != ATTRIBUTE:
                continue
            version, sizes = body[0], struct.unpack_from("<HHH", body, 2)
            at, parts = 8 + (version == 3), []
            for size in sizes:
                parts.append(body[at : at + size])
                at += -(-size // 8) * 8 if version == 1 else size
            yield parts[0].split(b"\0", 1)[0].decode("utf-8", "replace"), self.text(parts[1], parts[2], body[at:])

    def text(self, kind: bytes, space: bytes, data: bytes) -> str | None:
        if math.prod(self.extent(space)) < 1:
            return None
        size = _number(kind, 4, 4)
        if kind[0] & 15 == 3:
            return data[:size].split(b"\0", 1)[0].decode("utf-8", "replace").rstrip(" ")
        if kind[0] & 15 == 9 and kind[1] & 15 == 1:
            length, heap, number = _number(data, 0, 4), self.address(data, 4), _number(data, 4 + self.o, 4)
            return self.held(heap, number)[:length].decode("utf-8", "replace") if length and heap is not None else ""
        try:
            return str(np.frombuffer(data, kind_of(kind), 1)[0])
        except Broken:
            return None

    def held(self, heap: int, number: int) -> bytes:
        """An object of a heap of strings."""
        head = self.bytes(heap, 8 + self.n)
        if head[:4] != b"GCOL":
            raise Broken("global heap")
        data, p = self.bytes(heap, _number(head, 8, self.n)), 8 + self.n
        while p + 8 + self.n <= len(data):
            index, size = _number(data, p, 2), _number(data, p + 8, self.n)
            p += 8 + self.n
            if index == number:
                return data[p : p + size]
            if index == 0:
                break
            p += -(-size // 8) * 8
        raise Broken("no such string")


def kind_of(body: bytes) -> str:
    """numpy's name of an integer or a float."""
    order, size = "<>"[body[1] & 1], _number(body, 4, 4)
    if body[0] & 15 == 0 and size in (1, 2, 4, 8):
        return f"{order}{'i' if body[1] & 8 else 'u'}{size}"
    if body[0] & 15 == 1 and size in (2, 4, 8):
        return f"{order}f{size}"
    raise Broken(f"type of class {body[0] & 15}")


def filters_of(body: bytes) -> list[int]:
    if not body:
        return []
    at, out = 8 if body[0] == 1 else 2, []
    for _ in range(body[1]):
        number = _number(body, at, 2)
        named = body[0] == 1 or number >= 256
        name = _number(body, at + 2, 2) if named else 0
        values = _number(body, at + 4 + 2 * named, 2)
        at += 6 + 2 * named + name + 4 * values + 4 * (body[0] == 1 and values % 2)
        if number not in (DEFLATE, SHUFFLE, FLETCHER):
            raise Broken(f"filter {number}")
        out.append(number)
    return out


def decode(data: bytes, kind: str, count: int, filters: list[int]) -> np.ndarray:
    """The elements of a chunk; ``filters`` are undone in the order in which they stand."""
    width = np.dtype(kind).itemsize
    for number in filters:
        if number == DEFLATE:
            data = zlib.decompress(data)
        elif number == FLETCHER:
            data = data[:-4]
        else:
            n = len(data) // width
            data = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.tobytes() + data[n * width :]
    return np.frombuffer(data, kind, count).astype(np.float64)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{hdf5,h5}")
    return files.load(path).select("path").repartition("path")


def _told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


#: What a broken or missing file can raise.
FAILURES = (Broken, OSError, struct.error, zlib.error, IndexError, ValueError, TypeError, MemoryError)


def chunk_index(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Where the chunks of a series lie in each file below ``path``; a file without it has one row with an error."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def walk(p: str) -> Iterator[tuple]:
        try:
            with ranges.opened(p) as opened:
                file = File(opened)
                header = file.find(dataset)
                if header is None:
                    raise Broken("no such dataset")
                own, seen = file.series(header), 0
                for at, stored, first, count, undo in file.chunks(own):
                    seen += count
                    yield p, dataset, at, stored, first, count, own.total, own.kind, undo, None
                if seen != own.total:
                    raise Broken(f"{seen} of {own.total} elements are stored")
                if not own.total:
                    yield p, dataset, 0, 0, 0, 0, 0, own.kind, [], None
        except FAILURES as error:
            yield p, dataset, None, None, None, None, None, None, None, _told(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p in rows["path"]:
                part = []
                for row in walk(p):
                    part.append(row)
                    if len(part) == ROWS:
                        yield pd.DataFrame(part, columns=names, dtype=object)
                        part = []
                yield pd.DataFrame(part, columns=names, dtype=object)

    return _listed(spark, path).mapInPandas(run, INDEX)


def read_chunks(index: DataFrame, stride: int = 1) -> DataFrame:
    """Rows (path, dataset, first, x, error): the elements of each chunk whose number in the series ``stride`` divides.

    Chunks are dealt over the tasks, whichever file they are of; null bytes of a file that went give an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                x, error = None, r.error
                if error is None:
                    try:
                        with ranges.opened(r.path) as file:
                            file.seek(int(r.at))
                            x = decode(file.read(int(r.stored)), r.kind, int(r.count), list(r.filters))[-int(r.first) % stride :: stride]
                    except FAILURES as failed:
                        error = _told(failed)
                yield pd.DataFrame({"path": [r.path], "dataset": [r.dataset], "first": [r.first], "x": [x], "error": [error]}, dtype=object)

    return index.repartition("path", "first").mapInPandas(run, "path string, dataset string, first long, x array<double>, error string")


def read_series(index: DataFrame, stride: int = 1) -> DataFrame:
    """Rows (path, x, error): a whole recording as one array, null with the first error where any chunk failed."""
    rows = read_chunks(index, stride).groupBy("path").agg(F.min("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("first", "x")))).alias("parts"))
    return rows.select("path", F.when(F.col("error").isNull(), F.flatten(F.col("parts.x"))).alias("x"), "error")


def root_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, name, value, error) of the attributes of each file's root, values as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p in rows["path"]:
                found, error = [], None
                try:
                    with ranges.opened(p) as opened:
                        file = File(opened)
                        found = list(file.attributes(file.root))
                except FAILURES as failed:
                    error = _told(failed)
                yield pd.DataFrame([(p, *f, None) for f in found] + [(p, None, None, error)] * bool(error), columns=["path", "name", "value", "error"], dtype=object)

    return _listed(spark, path).mapInPandas(run, "path string, name string, value string, error string")
