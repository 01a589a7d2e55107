import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import frames, physnet, signal
from tidegrid.operators import catalog, contrastive, maps, metrics, spectral, splits, timeseries


def test_network_shape_and_size():
    found = physnet.weights()
    assert physnet.n_parameters(found) == 290_817
    for m in (64, 32, 16):
        assert physnet.forward(np.random.default_rng(0).standard_normal((m, 301)), found).shape == (301,)


def test_band_of_sines():
    assert len(spectral.band_bins(15, 300, 0.1, 0.5)) == 9
    assert len(spectral.band_bins(15, 4096, 0.1, 0.5)) == 109


def test_band_power_finds_sines(spark):
    rows = [(k, i, math.sin(2 * math.pi * f * i / 15)) for k, f in enumerate((0.15, 0.25, 0.40)) for i in range(300)]
    p = spectral.band_power(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", spectral.band_bins(15, 300, 0.1, 0.5), 300)
    found = p.select("k", spectral.argmax(F.col("p")).alias("at"), F.aggregate(spectral.normalised(F.col("p")), F.lit(0.0), lambda a, v: a + v).alias("sum")).orderBy("k").collect()
    assert [r["at"] for r in found] == [1, 3, 6] and all(abs(r["sum"] - 1) < 1e-4 for r in found)


def test_readouts_of_known_rates(spark):
    rows = [(bpm, [math.sin(2 * math.pi * bpm / 60 * i / 15) for i in range(900)]) for bpm in (9, 15, 24)]
    out = spectral.wave_readouts(spark.createDataFrame(rows, "sid int, x array<double>"), ["sid"], "x", 15.0, 300).collect()
    assert len(out) == 12 and all(abs(r["bpm"] - r["sid"]) < 1 for r in out)
    empty = spectral.wave_readouts(spark.createDataFrame([(1, [])], "sid int, x array<double>"), ["sid"], "x", 15.0, 300).collect()
    assert all(math.isnan(r["bpm"]) for r in empty)


def test_filters():
    t = np.arange(3000) / 30
    b, a = signal.butter_band(3, 0.1, 0.5, 30.0)
    inside, outside = np.sin(2 * np.pi * 0.25 * t), np.sin(2 * np.pi * 3 * t)
    y = signal.filtfilt(b, a, inside)
    assert np.abs(y[600:-600] - inside[600:-600]).max() < 0.02
    assert np.abs(signal.filtfilt(b, a, outside)[600:-600]).max() < 5e-3
    assert signal.breathing_rate(inside, 30.0, 0.1, 0.5, 300) == pytest.approx(15, abs=0.3)
    assert signal.breathing_rate(np.ones(3000), 30.0, 0.1, 0.5, 300) is None
    assert np.abs(signal.fourier_resample(np.sin(2 * np.pi * np.arange(64) / 16), 128)[::2] - np.sin(2 * np.pi * np.arange(64) / 16)).max() < 1e-9
    assert np.abs(signal.fir_decimate(inside, 2)[50:-50] - inside[::2][50:-50]).max() < 1e-2


def test_contrastive_order(spark):
    x = [[math.sin(2 * math.pi * f * i / 15) ** 2 for i in range(100)] for f in (0.15, 0.25, 0.35, 0.45)]
    rows = [(0, k, v, v) for k, v in enumerate(x)] + [(1, k, v, x[3 - k]) for k, v in enumerate(x)]
    loss = {r.g: r.loss for r in contrastive.info_nce(spark.createDataFrame(rows, "g int, k int, a array<double>, b array<double>"), "g", "k", "a", "b").collect()}
    assert loss[0] < loss[1]


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("a", "p", 1.0, 2.0), ("b", "p", float("nan"), 2.0), ("c", "p", 1.0, None), ("d", "p", 1.0, 1.0), ("d", "q", 1.0, 2.0)], "g string, person string, pred double, ref double")
    out = {r.g: r for r in metrics.complete(metrics.evaluate(rows, ["g"]), rows, ["g"]).collect()}
    assert out["b"].n == 0 and out["c"].n == 0 and out["a"].n == 1
    assert math.isnan(out["a"].pearson) and math.isnan(out["d"].pearson) and math.isnan(out["d"].icc)


def test_splits(spark):
    rows = [(f"d{n}", f"s{k}", f"d{n}_s{k}_{j}") for n in (2, 10, 27, 40) for k in range(n) for j in range(2)]
    sessions = spark.createDataFrame(rows, "dataset string, subject string, sid string")
    for how in (splits.hashed, splits.permuted):
        parts = how(sessions)
        sizes = {(r["dataset"], r["part"]): r["count"] for r in parts.groupBy("dataset", "part").count().collect()}
        assert [sizes[("d10", p)] for p in ("train", "val", "test")] == [7, 1, 2]
        assert [sizes[("d27", p)] for p in ("train", "val", "test")] == [19, 3, 5]
        assert [sizes[("d40", p)] for p in ("train", "val", "test")] == [28, 4, 8]
        assert sizes[("d2", "train")] == 2 and ("d2", "test") not in sizes
        assert parts.count() == parts.select("dataset", "subject").distinct().count()
    with pytest.raises(KeyError):
        splits.pool(splits.members(sessions, splits.hashed(sessions)), sessions, ["none"])


def test_variant_keeps_unknown_trials(spark):
    rows = spark.createDataFrame([("mahnob", "N"), ("mahnob", None), (None, "N"), ("pure", "N")], "dataset string, trial string")
    assert rows.where(catalog.variant_keep("sonly")).count() == 3
    with pytest.raises(ValueError):
        catalog.variant_keep("other")


def test_windows_and_stretch(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0]), (3, [])], "k int, x array<double>")
    out = timeseries.windows(rows, "x", 3, 2).orderBy("k", "start").collect()
    assert [(r.k, r.w) for r in out] == [(1, [1, 2, 3]), (1, [3, 4, 5]), (2, [1])]
    assert rows.where("k = 1").select(timeseries.stretch(F.col("x"), 9).alias("y")).first().y == [1 + i / 2 for i in range(9)]


def test_stimulus_window(spark):
    edges = spark.createDataFrame([(1, 300, 900, 2), (2, 100, 900, 2)], "k int, first int, second int, n_edges int")
    assert [r.k for r in timeseries.stimulus_window(edges, 10.0).collect()] == [1]


def test_recursive_filter_against_its_definition():
    rng = np.random.default_rng(5)
    b, a = signal.butter_band(3, 0.1, 0.5, 2.0)
    x, state = rng.standard_normal(333), rng.standard_normal(6)
    want, s = [], state.copy()
    for v in x:
        y = b[0] * v + s[0]
        s = np.append(s[1:], 0) + b[1:] * v - a[1:] * y
        want.append(y)
    assert np.allclose(signal._filter(b, a, x, state), want)


def test_permuted_splits_follow_the_generator(spark):
    names = [f"s{k:02d}" for k in range(27)]
    parts = {r.subject: r.part for r in splits.permuted(spark.createDataFrame([("d", n) for n in names], "dataset string, subject string")).collect()}
    order = np.random.default_rng(42).permutation(27)
    assert [parts[names[k]] for k in range(27)] == ["test" if p < 5 else "val" if p < 8 else "train" for p in np.argsort(order)]


def test_noise_of_views_is_in_proportion(spark):
    rows = spark.createDataFrame([(k, r, i, float((k + 1) * (i % 7))) for k in range(2) for r in range(4) for i in range(2000)], "k int, r int, i int, v double")
    views = timeseries.two_views(rows.withColumn("was", F.col("v")), ["k"], "r", "i", "v", 0.05, 1)
    got = views.groupBy("k", "view").agg(F.stddev_pop(F.col("v") - F.col("was")).alias("noise"), F.stddev_pop("was").alias("sd")).collect()
    assert len(got) == 4 and all(r.noise == pytest.approx(0.05 * r.sd, rel=0.06) for r in got)


def test_half_precision(spark):
    x = np.concatenate([np.random.default_rng(0).standard_normal(300) * 10.0 ** np.random.default_rng(1).integers(-9, 5, 300), [0.0, 8.0, 65504.0, 65519.0, 65520.0, 1e9, -1e9, 6e-8, float("inf")]])
    got = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(timeseries.half_precision(F.col("x")).alias("y")).collect()]
    with np.errstate(over="ignore"):
        assert got == x.astype(np.float16).astype(float).tolist()


def test_status_of_attempts(spark):
    rows = spark.createDataFrame([(1, True, "E: x", 0, None, None), (2, False, "E: x", 0, None, None), (3, False, None, None, 99, 200), (4, False, None, 9, None, None), (5, False, None, 9, 31, None), (6, False, None, 9, 32, None), (7, False, None, 9, 32, 149), (8, False, None, 9, 32, 150)], "sid int, stored boolean, error string, n_frames int, side int, T int")
    got = [(r.status, r.reason) for r in catalog.with_status(rows).orderBy("sid").collect()]
    assert got == [("cached", None), ("error", "E: x"), ("skip", "no_frames"), ("skip", "no_face"), ("skip", "box_too_small"), ("skip", "no_flow"), ("skip", "too_short"), ("ok", None)]


def _shifted(dy, dx=0.0, side=64):
    y, x = np.indices((side, side))
    return np.rint(128 + 50 * np.sin((y - dy) / 5.0) + 50 * np.cos((x - dx) / 6.0)).astype(np.uint8)


def test_crops_and_motion():
    frame = np.random.default_rng(3).integers(0, 256, (60, 80, 3)).astype(np.uint8)
    grey = frames.grey_crop(frame, (10, 5, 50, 45), 20)
    plain = np.rint((frame[5:45, 10:50].astype(int) @ np.array(frames.GREY) + 8192 >> 14).reshape(20, 2, 20, 2).mean(axis=(1, 3)))
    assert np.abs(grey.astype(int) - plain).max() <= 1 and frames.grey_crop(frame, (9, 9, 9, 20), 20) is None
    assert np.allclose(frames.area_weights(7, 3).sum(axis=1), 1) and np.allclose(frames.area_weights(7, 3).sum(axis=0), 3 / 7)
    flow = frames.motion(_shifted(0), _shifted(1.5, -0.7))[12:-12, 12:-12]
    assert np.abs(flow[..., 1] - 1.5).max() < 0.3 and np.abs(flow[..., 0] + 0.7).max() < 0.3
    assert frames.block_means(np.arange(81.0).reshape(9, 9), 4).tolist() == [5 + 18 * r + 2 * c for r in range(4) for c in range(4)]


@pytest.mark.parametrize("shift", [0.1, 0.3, 0.5, 0.7, 0.9, 2.6])
def test_motion_finds_fractions_of_a_pixel(shift):
    rng = np.random.default_rng(3)
    waves = [(*rng.uniform(-0.35, 0.35, 2), rng.uniform(0, 6), rng.uniform(0.5, 1)) for _ in range(40)]
    y, x = np.indices((128, 128))
    image = lambda d: np.clip(np.rint(127 + 18 * sum(a * np.cos(p * x + q * (y - d) + r) for p, q, r, a in waves)), 0, 255).astype(np.uint8)
    flow = frames.motion(image(0), image(shift))[16:-16, 16:-16]
    assert abs(flow[..., 1].mean() - shift) < 0.01 and np.abs(frames.block_means(flow[..., 1], 8) - shift).max() < 0.05 and np.abs(flow[..., 0]).mean() < 0.05


def test_ranges_of_frames_give_the_pairs_of_the_whole(spark):
    """Whatever frames are missing, pairs over ranges are those of neighbouring readable frames, and each crop is in two ranges at most."""
    rng = np.random.default_rng(6)
    rows = [(s, k, None if rng.random() < 0.4 else bytes([k])) for s in "ab" for k in range(60)] + [("c", 7, b"x"), ("d", 3, None)]
    crops_ = spark.createDataFrame(rows, "sid string, frame int, grey binary")
    readable = {s: [k for t, k, g in rows if t == s and g] for s in "abcd"}
    for span in (1, 4, 13, 100):
        held = {}
        halo = maps.with_halo(crops_, span).collect()
        for r in halo:
            held.setdefault((r.sid, r.range), []).append((r.frame, r.halo))
        pairs = {(s, a, b) for (s, _), own in held.items() for (a, _), (b, late) in zip(sorted(own), sorted(own)[1:]) if not late}
        assert pairs == {(s, a, b) for s, own in readable.items() for a, b in zip(own, own[1:])}
        assert max(len(own) for own in held.values()) <= span + 1


def test_one_broken_session_of_ten_leaves_nine(spark):
    image = lambda k: np.repeat(_shifted(math.sin(k / 2))[..., None], 3, axis=2).tobytes()
    rows = [(f"s{n}", k, 64, 64, b"torn" if n == 4 and k == 5 else image(k)) for n in range(10) for k in range(8)]
    frames_ = spark.createDataFrame(rows, "sid string, frame int, width int, height int, bgr binary")
    sessions = spark.createDataFrame([(f"s{n}", 64, 64, 0.0 if n == 7 else 15.0) for n in range(10)], "sid string, width int, height int, fps double")
    seen = spark.createDataFrame([], "sid string, frame int, x double, y double, w double, h double, score double")
    records, found = maps.session_maps(sessions, frames_, seen, side=32, grid=2, target=15.0, least_s=0.4, whole=True, span=3)
    got = {r.sid: (r.status, r.reason and r.reason.split(":")[0]) for r in records.collect()}
    assert {s: g for s, g in got.items() if s not in ("s4", "s7")} == {f"s{n}": ("ok", None) for n in range(10) if n not in (4, 7)}
    assert got["s4"] == ("error", "ValueError") and got["s7"][0] == "error"
    one = [r.x for r in found.where("sid = 's0' and roi = 0").collect()]
    whole_, _ = maps.session_maps(sessions.where("sid = 's0'"), frames_, seen, side=32, grid=2, target=15.0, least_s=0.4, whole=True, span=100)[::-1]
    assert one == [r.x for r in whole_.where("roi = 0").collect()] and len(one[0]) == 7


def test_sessions_that_failed_are_tried_again(spark):
    image = lambda k: np.repeat(_shifted(math.sin(k / 2))[..., None], 3, axis=2).tobytes()
    rows = [(s, k, 64, 64, image(k)) for s in "abcd" for k in range(8)]
    whole = spark.createDataFrame(rows, "sid string, frame int, width int, height int, bgr binary")
    sessions = spark.createDataFrame([(s, 64, 64, 15.0) for s in "abcde"], "sid string, width int, height int, fps double")
    seen = spark.createDataFrame([], "sid string, frame int, x double, y double, w double, h double, score double")
    asked = []

    def frames_of(wanted):
        asked.append(sorted(r.sid for r in wanted.collect()))
        if len(asked) > 1:  # the store answers for all but e by now
            return whole.join(wanted.select("sid"), "sid", "left_semi")
        return whole.where("sid != 'b'").withColumn("bgr", F.when(F.col("sid") != "c", F.col("bgr")))

    settings = dict(side=32, grid=2, target=15.0, least_s=0.4, whole=True)
    records, found = maps.session_maps_in_waves(sessions, frames_of, seen, wait_s=0, **settings)
    assert asked == [list("abcde"), list("bce")]
    got = {r.sid: (r.status, r.reason, r.wave) for r in records.collect()}
    assert got == {"a": ("ok", None, 1), "b": ("ok", None, 2), "c": ("ok", None, 2), "d": ("ok", None, 1), "e": ("skip", "no_frames", 2)}
    _, once = maps.session_maps(sessions, whole, seen, **settings)
    rows_of = lambda m: sorted((r.sid, r.roi, r.x) for r in m.collect())
    assert rows_of(found) == rows_of(once) and len(rows_of(found)) == 16
    asked.clear()
    records, _ = maps.session_maps_in_waves(sessions.where("sid = 'a'"), frames_of, seen, wait_s=0, **settings)
    assert len(asked) == 1 and records.count() == 1


def test_maps_of_sessions(spark):
    """A face that moves up and down gives its motion; what fails is told and fails nothing else."""
    move = [2 * math.sin(k / 3) for k in range(12)]
    image = lambda k: np.repeat(_shifted(move[k])[..., None], 3, axis=2).tobytes()
    rows = [("a", k, 64, 64, image(k)) for k in range(12)] + [("b", k, 64, 64, image(k)) for k in range(12)] + [("c", 0, 64, 64, image(0))] + [("d", k, 64, 64, b"short") for k in range(3)]
    frames_ = spark.createDataFrame(rows, "sid string, frame int, width int, height int, bgr binary")
    sessions = spark.createDataFrame([(s, 64, 64, 15.0) for s in "abcde"], "sid string, width int, height int, fps double")
    seen = spark.createDataFrame([(s, k, 4.0, 4.0, 40.0, 40.0, 0.9) for s in "acd" for k in range(3)], "sid string, frame int, x double, y double, w double, h double, score double")
    records, maps_ = maps.session_maps(sessions, frames_, seen, side=32, grid=4, target=30.0, least_s=0.5)
    got = {r.sid: (r.status, r.reason and r.reason.split(":")[0]) for r in records.collect()}
    assert got == {"a": ("ok", None), "b": ("skip", "no_face"), "c": ("skip", "no_frames"), "d": ("error", "ValueError"), "e": ("skip", "no_frames")}
    found = maps_.collect()
    assert {r.sid for r in found} == {"a"} and sorted(r.roi for r in found) == list(range(16)) and all(len(r.x) == 21 for r in found)
    middle = np.mean([r.x[::2] for r in found if r.roi in (5, 6, 9, 10)], axis=0)
    assert np.corrcoef(middle, np.diff(move))[0, 1] > 0.95


def test_command_line(spark, tmp_path):
    from tidegrid.__main__ import main

    path = lambda name: str(tmp_path / name)
    rows = [(f"D_{p}_{k}", d, f"s{p}", "ok", "S", 10.0 + p) for d in ("d", "u") for p in range(10) for k in range(2)]
    spark.createDataFrame(rows, "sid string, dataset string, subject string, status string, trial string, gt_rr double").write.parquet(path("manifest"))
    main(["splits", "--manifest", path("manifest"), "--seed", "7", "--train-only", "u", "--out", path("split")])
    split = spark.read.parquet(path("split"))
    assert {(r.dataset, r.part) for r in split.select("dataset", "part").distinct().collect()} == {("d", "all"), ("d", "train"), ("d", "val"), ("d", "test"), ("u", "all")}
    spark.createDataFrame([("r", f"D_{p}_0", n, 11.0 + p + (n == "mean")) for p in range(10) for n in ("mean", "median")], "run string, sid string, readout string, bpm double").write.parquet(path("preds"))
    spark.createDataFrame([("r", "d", "all", f"D_{p}_0") for p in range(9)], "run string, dataset string, subset string, sid string").write.parquet(path("sets"))
    spark.read.parquet(path("manifest")).where("dataset = 'd'").write.parquet(path("known"))
    main(["evaluate", "--predictions", path("preds"), "--sets", path("sets"), "--manifest", path("known"), "--readout", "mean", "--out", path("metrics")])
    row = spark.read.parquet(path("metrics")).first()
    assert (row.n, row.mae, row.subjects) == (9, 2.0, 9) and abs(row.mae_debiased) < 1e-9
    with pytest.raises(SystemExit):
        main(["query", "none", "--data", "x", "--out", "y"])
