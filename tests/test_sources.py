import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from tidegrid.operators import maps
from tidegrid.sources import avi, bdf, corpora, images, manifest, names, readers


def _bdf(n_records=2, cut=0):
    labels, samples = ["Resp", "Status"], [4, 2]
    head = b"\xffBIOSEMI" + b" " * 228 + b"%-8d" % n_records + b"%-8d" % 1 + b"%-4d" % 2
    head += b"".join(b"%-16s" % x.encode() for x in labels) + b" " * (2 * 200) + b"".join(b"%-8d" % n for n in samples) + b" " * 64
    values = [-1, 5, -8388608, 8388607, 1, 65536, 7, 8, 9, 10, 0, 3]
    data = head + b"".join((v & 0xFFFFFF).to_bytes(3, "little") for v in values)
    return data[: len(data) - cut]


def test_bdf_channels(spark, tmp_path):
    (tmp_path / "a.bdf").write_bytes(_bdf())
    (tmp_path / "b.bdf").write_bytes(b"no header")
    rows = bdf.read_channel(spark, str(tmp_path), "Resp").collect()
    assert [(r.fs, r.x) for r in rows] == [(4.0, [-1, 5, -8388608, 8388607, 7, 8, 9, 10])]
    assert bdf.headers(spark, str(tmp_path)).first().labels == ["Resp", "Status"]
    (tmp_path / "c.bdf").write_bytes(_bdf(cut=3))
    rows = {r.path[-5:]: r.x for r in bdf.read_channel(spark, str(tmp_path), "Status").collect()}
    assert rows == {"a.bdf": [1, 65536, 0, 3], "c.bdf": [1, 65536]}  # the second record is not whole
    assert bdf.read_channel(spark, str(tmp_path), "EEG").count() == 0


def _avi(frames, segments=1, pad=0, side=2):
    w = h = side
    strh = b"vids" + b"DIB " + b"\0" * 12 + struct.pack("<4I", 1, 25, 0, len(frames)) + b"\0" * 16
    strf = struct.pack("<IiiHHI", 40, w, h, 1, 24, 0) + b"\0" * 20
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    per = -(-len(frames) // segments)
    out = b""
    for k in range(segments):
        movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00db", f) for f in frames[k * per : (k + 1) * per]))
        out += chunk(b"RIFF", (b"AVI " + head if k == 0 else b"AVIX") + movi)
    return out + b"\0" * pad


def test_avi_frames(spark, tmp_path):
    frames = [bytes([k + 1] * 6 + [0, 0] + [k + 101] * 6 + [9, 9]) for k in range(5)]
    (tmp_path / "a.avi").write_bytes(_avi(frames))
    (tmp_path / "b.avi").write_bytes(_avi([*frames[:4], b"\5" * 8 + b"\0" * 8], segments=2, pad=64))
    avi.register(spark)
    rows = spark.read.format("raw_avi").option("path", f"{tmp_path}/*.avi").load().orderBy("path", "frame").collect()
    assert [(r.path[-5], r.frame) for r in rows] == [("a", k) for k in range(5)] + [("b", k) for k in range(5)]
    assert rows[0].bgr == bytes([101] * 6 + [1] * 6)  # stored bottom-up
    half = spark.read.format("raw_avi").option("path", f"{tmp_path}/a.avi").option("step", 2).option("frames", 4).load()
    assert sorted(r.frame for r in half.collect()) == [0, 2]


def test_avi_frames_that_end_in_black(spark, tmp_path):
    """Whole segments keep their black last frame, whatever follows them; short chunks end a file, and a frame that runs into
    dead space inside a segment goes."""
    frames = [bytes([k + 1] * 16) for k in range(2)] + [b"\0" * 16]
    (tmp_path / "black.avi").write_bytes(_avi(frames))
    (tmp_path / "short.avi").write_bytes(_avi([frames[0], b"\7" * 8, frames[1]]))
    (tmp_path / "padded.avi").write_bytes(_avi(frames, pad=64))
    (tmp_path / "noise.avi").write_bytes(b"RIFFxxxx")
    cut = _avi([bytes([k + 1] * 16) for k in range(4)])
    (tmp_path / "dead.avi").write_bytes(cut[: cut.index(bytes([3] * 16)) + 6].ljust(len(cut), b"\0"))
    index = avi.frame_index(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: (r.found, r.declared) for r in avi.headers(index).collect()}
    assert found == {"black.avi": (3, 3), "short.avi": (1, 3), "padded.avi": (3, 3), "dead.avi": (2, 4)}
    rows = avi.read_frames(index, step=2, most=3, readers=2).where("path like '%black.avi'").orderBy("frame").collect()
    assert [(r.frame, r.bgr) for r in rows] == [(0, bytes([1] * 12)), (2, bytes(12))]


def test_avi_filters_are_pushed_down(spark, tmp_path):
    """Files and frames that a filter excludes are neither planned nor read; ranges of a file give each frame once."""
    frames = [bytes([k + 1] * 16) for k in range(9)]
    for name in "ab":
        (tmp_path / f"{name}.avi").write_bytes(_avi(frames, segments=3))
    avi.register(spark)
    rows = spark.read.format("raw_avi").option("path", f"{tmp_path}/*.avi").option("split", 50).load()
    assert sorted((r.path[-5], r.frame, r.bgr[0]) for r in rows.collect()) == [(n, k, k + 1) for n in "ab" for k in range(9)]
    some = rows.where(f"path = '{tmp_path}/b.avi' AND frame >= 3 AND frame < 6 AND width = 2")
    assert sorted((r.path[-5], r.frame) for r in some.collect()) == [("b", 3), ("b", 4), ("b", 5)]
    reader = avi.AviReader({"path": f"{tmp_path}/*.avi"})
    left = list(reader.pushFilters([EqualTo(("path",), f"{tmp_path}/a.avi"), GreaterThan(("frame",), 6), LessThanOrEqual(("frame",), 7), EqualTo(("width",), 2)]))
    assert [f.attribute for f in left] == [("width",)] and [p.path for p in reader.partitions()] == [f"{tmp_path}/a.avi"]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [7]


def test_avi_index_walks_changed_files_only(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "videos", str(tmp_path / "index")
    root.mkdir()
    frames = [bytes([k + 1] * 16) for k in range(4)]
    for name in ("a", "b", "gone"):
        (root / f"{name}.avi").write_bytes(_avi(frames[: 2 + (name == "b")]))
    (root / "none.avi").write_bytes(b"no video")
    count = lambda: {r.path.rsplit("/", 1)[1]: r["count"] for r in avi.extended_index(spark, str(root), store).groupBy("path").count().collect()}
    assert count() == {"a.avi": 2, "b.avi": 3, "gone.avi": 2}
    before = spark.read.parquet(store).count()
    assert count() == {"a.avi": 2, "b.avi": 3, "gone.avi": 2} and spark.read.parquet(store).count() == before
    (root / "a.avi").write_bytes(_avi(frames))
    (root / "gone.avi").unlink()
    assert count() == {"a.avi": 4, "b.avi": 3} and spark.read.parquet(store).count() == before + 4


def test_frames_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(_avi([bytes([k + 1] * 16) for k in range(3)]))
    index = avi.frame_index(spark, str(tmp_path)).persist()
    assert index.count() == 3
    (tmp_path / "a.avi").unlink()
    rows = avi.read_frames(index)
    assert [r.bgr for r in rows.collect()] == [None] * 3
    boxed = rows.select("path").distinct().select(F.col("path").alias("sid"), F.array(F.lit(0), F.lit(0), F.lit(2), F.lit(2)).alias("box"))
    assert {r.error for r in maps.crops(rows.withColumnRenamed("path", "sid"), boxed, 2).collect()} == {"OSError: the frame was not read"}
    index.unpersist()


def test_catalogues_of_files(spark, tmp_path):
    """Listings and headers as they come from a store."""
    for name in ("1/0", "1/2", "x/1"):
        (tmp_path / "c" / name).mkdir(parents=True)
        (tmp_path / "c" / name / "data.avi").write_bytes(b"x")
    listing = corpora.files(spark, str(tmp_path / "c"))
    probes = listing.selectExpr("path", "if(path like '%/1/0/%', 20L, 1L) AS n_frames", "20.3D AS fps")
    lights = listing.selectExpr("regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder", "'other' AS light")
    rows = corpora.cohface(listing, probes, lights).collect()
    assert [(r.sid, r.fps, r.illumination, r.hdf5) for r in rows] == [("COHFACE_1_0", 20.3, "lamp", None)]
    (tmp_path / "m" / "10").mkdir(parents=True)
    (tmp_path / "m" / "10" / "session.xml").write_text('<session vidRate="61.5" x="1"><subject id="7" name="n"/></session>')
    assert [(r.subject, r.vid_rate) for r in corpora.session_xml(spark, str(tmp_path / "m")).collect()] == [("7", 61.5)]
    odd = spark.createDataFrame([("a", "<session><subject id='3_4'/></session>"), ("b", "<session><subject/></session>"), ("c", "<session vidRate='-1'><subject id='3'/></session>"), ("d", "<session><subject id='5'/></session>"), ("e", "no xml")], "folder string, xml string")
    assert [(r.folder, r.vid_rate) for r in corpora.parse_session_xml(odd).collect()] == [("d", corpora.TRIAL_FPS)]
    names = ["DATASET_1/8-gt/vid.avi", "DATASET_1/after-exercise/vid.avi", "DATASET_2/subject42/vid.avi", "DATASET_2/subject42/ground_truth.txt", "DATASET_1/05-gt/vid.avi", "DATASET_2/7-gt/vid.avi"]
    layout = corpora.ubfc_layout(spark.createDataFrame([(f"/r/{n}",) for n in names], "path string")).collect()
    assert {(r.folder, r.subject, r.session) for r in layout} == {("8-gt", "b42", "d1gt8"), ("after-exercise", "b42", "d1afterex"), ("subject42", "b42", "d2"), ("05-gt", "a5", "d1gt")}
    assert {r.folder for r in layout if r.reference} == {"subject42"}


def test_stores_of_maps_predictions_and_checkpoints(spark, tmp_path):
    maps = spark.createDataFrame([("a", "d", 0, [1.0 + 2**-12] * 20), ("b", "d", 0, [1.0] * 5)], "sid string, dataset string, roi int, x array<double>")
    manifest.write_maps(maps, str(tmp_path / "maps"), spark, half=True)
    kept, dropped = manifest.load_maps(spark, str(tmp_path / "maps"), spark.createDataFrame([("a",), ("b",), ("c",)], "sid string"), 8, 2)
    assert [(r.sid, len(r.x)) for r in kept.collect()] == [("a", 10)] and spark.read.parquet(str(tmp_path / "maps")).where("sid = 'a'").first().x[0] == 1.0
    assert {(r.sid, r.reason) for r in dropped.collect()} == {("b", "short:5"), ("c", "missing")}
    preds = spark.createDataFrame([("r1", "a", "mean", 1.0), ("r2", "a", "mean", 2.0)], "run string, sid string, readout string, bpm double")
    manifest.write_predictions(preds, str(tmp_path / "preds"))
    manifest.write_predictions(preds.where("run = 'r2'").selectExpr("run", "sid", "readout", "bpm + 1 AS bpm"), str(tmp_path / "preds"))
    assert {(r.run, r.bpm) for r in spark.read.parquet(str(tmp_path / "preds")).collect()} == {("r1", 1.0), ("r2", 3.0)}
    weights = {"w": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.ones(2, np.float32)}
    manifest.write_checkpoint(weights, spark, str(tmp_path / "net"))
    again = manifest.read_checkpoint(spark, str(tmp_path / "net"))
    assert all((again[k] == v).all() for k, v in weights.items())


def test_names(spark):
    rows = spark.createDataFrame([("s", "Image20.png"), ("s", "Image3.png"), ("s", "Imagex.png"), ("s", "a.png")], "sid string, name string")
    assert names.image_timestamps(rows, ["sid"], "name").first().stamps == [3, 20]
    rows = spark.createDataFrame([("10",), ("9",), ("x",)], "n string")
    assert [r.n for r in rows.orderBy(names.numeric_first(F.col("n"))).collect()] == ["9", "10", "x"]
    kinds = spark.createDataFrame([("1_2_S",), ("1_2_Q",), ("1",)], "n string").select(names.trial_kind(F.col("n")).alias("k")).collect()
    assert [r.k for r in kinds] == ["S", None, None]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"A_1_1": {"dataset": "a", "gt_rr": NaN, "box": [1, 2, 3, 4]}, "A_2_1": {"status": "ok"}, "_meta": {}}')
    rows = {r.sid: r for r in manifest.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert set(rows) == {"A_1_1", "A_2_1"} and np.isnan(rows["A_1_1"].gt_rr) and rows["A_2_1"].gt_rr is None
    maps = spark.createDataFrame([("A_1_1", "a", [1.0]), ("A_2_1", "a", [2.0])], "sid string, dataset string, x array<double>")
    manifest.write_maps(maps.limit(1), str(tmp_path / "maps"), spark)
    manifest.write_maps(maps, str(tmp_path / "maps"), spark)
    assert spark.read.parquet(str(tmp_path / "maps")).count() == 2
    assert manifest.markdown(maps.orderBy("sid"), ["sid", "dataset"]).splitlines()[2] == "| A_1_1 | a |"


def _png(rows):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + b"".join(bytes(p) for p in r) for r in rows))) + chunk(b"IEND", b"")


def test_image_frames(spark, tmp_path):
    for stamp in (30, 4, 100):
        (tmp_path / f"Image{stamp}.png").write_bytes(_png([[(stamp, 2, 3), (4, 5, 6)]]))
    (tmp_path / "Image5.png").write_bytes(b"no image")
    (tmp_path / "other.png").write_bytes(_png([[(1, 2, 3)]]))
    rows = images.image_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.stamp, r.width, r.height, bytes(r.bgr)) for r in rows] == [(k, s, 2, 1, bytes([3, 2, s, 6, 5, 4])) for k, s in enumerate((4, 30, 100))]


def test_readers_by_name(spark):
    assert readers.reader("pure").frames is images.image_frames
    with pytest.raises(KeyError, match="known: cohface"):
        readers.reader("none")
    with pytest.raises(ValueError):
        readers.register("pure", readers.reader("pure"))
    sessions = spark.createDataFrame([("a", "d", 1, 30.0, "S")], "sid string, dataset string, subject int, fps double, trial string")
    row = readers.manifest_rows(sessions).first()
    assert row.trial == "S" and row.head_motion is None and row.subject == "1"


def test_reference_rates(spark):
    """A belt at 15 breaths a minute: held samples, and a stimulus window between idle ends."""
    breath = lambda n, fs: [math.sin(2 * math.pi * 0.25 * k / fs) for k in range(n)]
    held = [v for v in breath(32 * 60, 32) for _ in range(8)]
    rows = spark.createDataFrame([(1, held), (2, held[: 32 * 8 * 19]), (3, [1.0] * len(held)), (4, [*held[:-8], *[float("nan")] * 8])], "k int, x array<double>")
    got = {r.k: r.gt_rr for r in readers.reader("cohface").reference(rows, "x").collect()}
    assert got[1] == pytest.approx(15, abs=0.4) and got[2] is got[3] is got[4] is None
    belt = [16] * 500 + [round(1000 * v) * 3 + 1 for v in breath(256 * 40, 256)] + [16] * 300
    rows = spark.createDataFrame([(1, belt, 0.0, 43.0), (2, belt, 0.0, 8.0), (3, [16] * 9000, 0.0, 30.0)], "k int, x array<bigint>, a double, z double").withColumn("fs", F.lit(256.0))
    got = {r.k: r.gt_rr for r in readers.reader("mahnob").reference(rows, "x", "fs", "a", "z").collect()}
    assert got[1] == pytest.approx(15, abs=0.4) and got[2] is got[3] is None
    assert readers.reader("ubfc").reference(rows).first().gt_rr is None
