"""Recordings in HDF5 that the tests write by the format's description: read back, in part, and broken."""

import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import hdf5, readers

NONE = (1 << 64) - 1


class Writer:
    """A file of superblock 0: one group, series in chunks or in one piece, attributes of the root."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, body):
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += body
        return at

    def header(self, messages):
        """The second half of the messages is in a continuation block."""
        pack = lambda rows: b"".join(struct.pack("<HHB3x", k, len(b) + -len(b) % 8, 0) + b + bytes(-len(b) % 8) for k, b in rows)
        half = (len(messages) + 1) // 2
        rest = pack(messages[half:])
        where = self.put(rest)
        first = pack([*messages[:half], (hdf5.MORE, struct.pack("<QQ", where, len(rest)))])
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(first)) + first)

    @staticmethod
    def space(n):
        return struct.pack("<BBBB4xQ", 1, 1, 0, 0, n)

    @staticmethod
    def kind(dtype):
        d = np.dtype(dtype)
        big = d.byteorder == ">"
        if d.kind == "f":
            return struct.pack("<BBBBI", 0x11, 0x20 | big, 8 * d.itemsize - 1, 0, d.itemsize) + bytes(12)
        return struct.pack("<BBBBI", 0x10, big | 8 * (d.kind == "i"), 0, 0, d.itemsize) + bytes(4)

    def tree(self, entries, kind, last, fan=3):
        """Nodes of ``fan`` children, in as many levels as it takes; entries are (key, child)."""
        level = 0
        while True:
            nodes = []
            for k in range(0, len(entries), fan):
                part = entries[k : k + fan]
                body = b"TREE" + struct.pack("<BBHQQ", kind, level, len(part), NONE, NONE) + b"".join(key + struct.pack("<Q", at) for key, at in part) + last
                nodes.append((part[0][0], self.put(body)))
            if len(nodes) == 1:
                return nodes[0][1]
            entries, level = nodes, level + 1

    def series(self, x, chunk=None, filters=(), skip=()):
        x = np.asarray(x)
        messages = [(hdf5.SPACE, self.space(len(x))), (hdf5.TYPE, self.kind(x.dtype))]
        if chunk == "compact":
            messages.append((hdf5.LAYOUT, struct.pack("<BBH", 3, 0, x.nbytes) + x.tobytes()))
        elif chunk is None:
            messages.append((hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        else:
            entries = []
            for number, first in enumerate(range(0, len(x), chunk)):
                part = np.zeros(chunk, x.dtype)
                part[: len(x[first : first + chunk])] = x[first : first + chunk]
                raw, mask = part.tobytes(), 0
                for k, f in enumerate(filters):
                    if (number, f) in skip:
                        mask |= 1 << k
                    elif f == hdf5.SHUFFLE:
                        raw = np.frombuffer(raw, np.uint8).reshape(chunk, -1).T.tobytes()
                    elif f == hdf5.DEFLATE:
                        raw = zlib.compress(raw)
                    else:
                        raw += b"sum4"
                entries.append((struct.pack("<IIQQ", len(raw), mask, first, 0), self.put(raw)))
            top = self.tree(entries, 1, struct.pack("<IIQQ", 0, 0, len(x), 0))
            messages.append((hdf5.LAYOUT, struct.pack("<BBBQII", 3, 2, 2, top, chunk, x.itemsize)))
            if filters:
                body = b"".join(struct.pack("<HHHH", f, 8, 1, 1) + b"a filter" + struct.pack("<II", 4, 0) for f in filters)
                messages.append((hdf5.FILTERS, struct.pack("<BB6x", 1, len(filters)) + body))
        return self.header(messages)

    def attribute(self, name, kind, n, data):
        pad = lambda b: b + bytes(-len(b) % 8)
        own, space = name.encode() + b"\0", self.space(n)
        return hdf5.ATTRIBUTE, struct.pack("<BxHHH", 1, len(own), len(kind), len(space)) + pad(own) + pad(kind) + pad(space) + data

    def text(self, name, value):
        """A string of variable length in an array of one."""
        raw = value.encode()
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + 16 + len(raw) + -len(raw) % 8) + struct.pack("<HH4xQ", 1, 1, len(raw)) + raw + bytes(-len(raw) % 8))
        return self.attribute(name, struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + bytes(8), 1, struct.pack("<IQI", len(raw), heap, 1))

    def done(self, series, attributes=()):
        names, entries = bytearray(8), []
        for name, header in sorted(series.items()):
            entries.append(struct.pack("<QQII16x", len(names), header, 0, 0))
            names += name.encode() + bytes(8 - len(name) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, self.put(bytes(names))))
        leaves = [(struct.pack("<Q", 0), self.put(b"SNOD" + struct.pack("<BxH", 1, len(entries[k : k + 2])) + b"".join(entries[k : k + 2]))) for k in range(0, len(entries), 2)]
        root = self.header([(hdf5.SYMBOLS, struct.pack("<QQ", self.tree(leaves, 0, bytes(8)), heap)), *attributes])
        self.data[:96] = hdf5.SIGNATURE + struct.pack("<8B", 0, 0, 0, 0, 0, 8, 8, 0) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.data), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        return bytes(self.data)


def linked(x):
    """A file of superblock 2 whose root holds its series by a link, with headers of version 2 and a filter list of version 2."""
    raw = zlib.compress(np.asarray(x, "<i2").tobytes())
    data = bytearray(48)

    def put(body):
        data.extend(body)
        return len(data) - len(body)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
        return put(b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + b"sum4")

    at = put(raw)
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 1, NONE, NONE) + struct.pack("<IIQQ", len(raw), 0, 0, 0) + struct.pack("<Q", at) + struct.pack("<IIQQ", 0, 0, len(x), 0))
    own = header([(hdf5.SPACE, struct.pack("<BBBBQ", 2, 1, 0, 1, len(x))), (hdf5.TYPE, Writer.kind("<i2")), (hdf5.LAYOUT, struct.pack("<BBBQII", 3, 2, 2, tree, len(x), 2)), (hdf5.FILTERS, struct.pack("<BBHHHI", 2, 1, 1, 0, 1, 4))])
    root = header([(hdf5.LINK, struct.pack("<BBB", 1, 0, 1) + b"r" + struct.pack("<Q", own)), (hdf5.ATTRIBUTE, struct.pack("<BBHHHB", 3, 0, 2, 12, 4, 0) + b"n\0" + Writer.kind("<i4") + struct.pack("<BBBB", 2, 0, 0, 0) + struct.pack("<i", -7))])
    data[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, NONE, len(data), root) + b"sum4"
    return bytes(data)


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("hdf5")
    x = np.sin(np.arange(1003) / 7)
    w = Writer()
    every = (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.FLETCHER)
    series = {
        "respiration": w.series(x, 50, every, {(2, hdf5.DEFLATE), (3, hdf5.SHUFFLE)}), "pulse": w.series(x.astype(">f4")), "time": w.series(np.arange(-20, 20, dtype="<i2"), "compact"),
        "bytes": w.series(np.arange(200, dtype="u1"), 64), "none": w.series(np.empty(0)), "odd": w.series(x, 400, (hdf5.DEFLATE, 32000)),
    }
    (root / "a.hdf5").write_bytes(w.done(series, [w.text("illumination", "lamp é"), w.attribute("id", w.kind("<i4"), 1, struct.pack("<i", -5)), w.attribute("kind", struct.pack("<BBBBI", 0x13, 0, 0, 0, 6), 1, b"belt\0\0")]))
    (root / "b.h5").write_bytes(bytes(512))
    (root / "c.h5").write_bytes(linked([3, -1, 4, 1, 5]))
    return root, x


def _series(spark, root, name, stride=1):
    return {r.path.rsplit("/", 1)[1]: (r.x, r.error) for r in hdf5.read_series(hdf5.chunk_index(spark, str(root), name), stride).collect()}


def test_series_of_all_layouts(spark, recordings):
    root, x = recordings
    got = _series(spark, root, "respiration")
    assert got["a.hdf5"] == (x.tolist(), None) and got["b.h5"][0] is None and "no HDF5 file" in got["b.h5"][1] and "no such dataset" in got["c.h5"][1]
    assert _series(spark, root, "/respiration", 8)["a.hdf5"][0] == x[::8].tolist()
    assert _series(spark, root, "pulse")["a.hdf5"][0] == x.astype("f4").tolist()
    assert _series(spark, root, "time")["a.hdf5"][0] == list(range(-20, 20)) and _series(spark, root, "bytes", 7)["a.hdf5"][0] == list(range(0, 200, 7))
    assert _series(spark, root, "none")["a.hdf5"] == ([], None) and "filter 32000" in _series(spark, root, "odd")["a.hdf5"][1]
    assert _series(spark, root, "r")["c.h5"] == ([3, -1, 4, 1, 5], None)


def test_attributes(spark, recordings):
    rows = hdf5.root_attributes(spark, str(recordings[0])).collect()
    told = {(r.path.rsplit("/", 1)[1], r.name, r.value) for r in rows if not r.error}
    assert told == {("a.hdf5", "illumination", "lamp é"), ("a.hdf5", "id", "-5"), ("a.hdf5", "kind", "belt"), ("c.h5", "n", "-7")}
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["b.h5"]


def test_only_the_asked_chunks_are_read(spark, recordings):
    """Of 21 chunks two are dealt, and the metadata walked are a small part of a large file."""
    root, x = recordings
    index = hdf5.chunk_index(spark, str(root / "a.hdf5"), "respiration")
    assert index.count() == 21
    rows = sorted(hdf5.read_chunks(index.where("first >= 100 AND first < 200")).collect(), key=lambda r: r.first)
    assert [r.first for r in rows] == [100, 150] and [v for r in rows for v in r.x] == x[100:200].tolist()
    w = Writer()
    big = w.done({"big": w.series(np.zeros(1 << 20)), "respiration": w.series(x, 50)})
    file = hdf5.File(Sized(big))
    chunks = list(file.chunks(file.series(file.find("big"))))
    assert len(chunks) == 8 and sum(c[3] for c in chunks) == 1 << 20 and file.read < 2000


class Sized(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_broken_files_are_told(spark, tmp_path, recordings):
    """Cut or changed anywhere, a file gives its series or an error, never another exception and no endless walk."""
    whole, draw = (recordings[0] / "a.hdf5").read_bytes(), random.Random(1)
    for k in range(600):
        data = bytearray(whole[: draw.randrange(len(whole))] if k % 2 else whole)
        for _ in range(4 * (1 - k % 2)):
            data[draw.randrange(len(data))] = draw.randrange(256)
        try:
            file = hdf5.File(Sized(bytes(data)))
            list(file.attributes(file.root))
            for name in ("respiration", "time"):
                if (header := file.find(name)) is not None:
                    own = file.series(header)
                    for at, stored, _, count, undo in file.chunks(own):
                        hdf5.decode(file.bytes(at, stored), own.kind, count, undo)
        except hdf5.FAILURES:
            pass
    for name, data in (("whole", whole), ("cut", whole[: len(whole) // 2]), ("empty", b"")):
        (tmp_path / f"{name}.h5").write_bytes(data)
    got = _series(spark, tmp_path, "respiration")
    assert got.keys() == {"whole.h5", "cut.h5"} and got["whole.h5"][1] is None and got["cut.h5"][0] is None and got["cut.h5"][1]


def test_rates_and_lights_of_recordings(spark, tmp_path):
    """15 breaths a minute, held eight times; one recording is broken and falls back on the session's light."""
    breath = [math.sin(2 * math.pi * 0.25 * k / 32) for k in range(32 * 60) for _ in range(8)]
    for name in ("1/0", "1/2", "2/3"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "data.avi").write_bytes(b"x")
    w = Writer()
    (tmp_path / "1/0/data.hdf5").write_bytes(w.done({"respiration": w.series(breath, 1000, (hdf5.SHUFFLE, hdf5.DEFLATE))}, [w.text("illumination", "studio")]))
    (tmp_path / "1/2/data.hdf5").write_bytes(b"broken")
    probes = readers.corpora.files(spark, str(tmp_path)).where("path LIKE '%avi'").select("path", F.lit(20).cast("long").alias("n_frames"), F.lit(20.0).alias("fps"))
    got = {r.sid: r for r in readers.cohface_files(spark, str(tmp_path), probes).collect()}
    assert {k: r.illumination for k, r in got.items()} == {"COHFACE_1_0": "studio", "COHFACE_1_2": "natural", "COHFACE_2_3": "natural"}
    assert got["COHFACE_1_0"].gt_rr == pytest.approx(15, abs=0.4) and got["COHFACE_1_2"].gt_rr is None and got["COHFACE_1_2"].rate_error and got["COHFACE_2_3"].gt_rr is None
