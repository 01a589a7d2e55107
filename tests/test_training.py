"""Gradients, the training loop against a plain one, the grid, and scoring with what was trained."""

import numpy as np
import pytest

from tidegrid.functions import contrast, physnet
from tidegrid.operators import metrics, scoring, training

TINY = training.TrainConfig(epochs=3, steps=4, batch=5, val_batches=2, rate=3e-3, clip=60, warp_minus=6, warp_plus=12, slack=2, fs=3.0, stem=3, width=4, replicas=2)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    found = physnet.weights(1, stem=3, width=4, kind=np.float64)
    found = {k: v + 0.1 * rng.standard_normal(v.shape) if k.endswith(("gain", "shift")) else v for k, v in found.items()}
    a, b = rng.standard_normal((2, 3, 17, 33))
    config = training.TrainConfig(fs=15.0, low=1.0, high=5.0)
    _, grads, _ = training.batch_loss(a, b, found, config, True)
    assert sorted(grads) == physnet.trainable(found)
    for name in physnet.trainable(found):
        for _ in range(3):
            at, near = tuple(rng.integers(0, s) for s in found[name].shape), []
            for h in (1e-5, -1e-5):
                other = found[name].copy()
                other[at] += h
                near.append(training.batch_loss(a, b, found | {name: other}, config, True)[0])
            assert grads[name][at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_spectra_and_loss_on_known_signals():
    t = np.arange(300) / 15
    waves = np.stack([np.sin(2 * np.pi * f * t) for f in (0.15, 0.25, 0.40)])
    share, _ = contrast.band_spectra(waves, 15.0, 0.1, 0.5)
    assert share.shape == (3, 9) and np.allclose(share.sum(axis=1), 1) and share.argmax(axis=1).tolist() == [1, 3, 6]
    rng = np.random.default_rng(0)
    a = np.stack([np.sin(2 * np.pi * f * t) for f in (0.15, 0.25, 0.35, 0.45)])
    b = a + 0.01 * rng.standard_normal(a.shape)
    p, q = (contrast.band_spectra(x, 15.0, 0.1, 0.5)[0] for x in (a, b))
    assert contrast.info_nce(p, q, 0.1)[0] < contrast.info_nce(p, q[::-1], 0.1)[0]
    padded, _ = contrast.band_spectra(waves, 15.0, 0.1, 0.5, 4096)
    assert padded.shape == (3, 109)


def test_running_statistics_follow_the_batches():
    rng = np.random.default_rng(2)
    found = physnet.weights(0, stem=2, width=2)
    x = rng.standard_normal((6, 32, 40)).astype(np.float32) * 3 + 1
    for _ in range(150):
        wave, tape = physnet.run(x, found, True)
        found = physnet.moved(found, physnet.batch_statistics(tape))
    assert np.abs(physnet.run(x, found)[0] - wave).max() < 0.02 * np.abs(wave).max()
    several = physnet.weights(0, out=3, stem=2, width=2)
    assert physnet.forward(x[0], several).shape == (3, 40)


def sessions(n=9, channels=32, length=90):
    """Maps with one slow wave in all channels, each session at its own rate, under noise."""
    rng = np.random.default_rng(7)
    t = np.arange(length) / 3.0
    return {f"s{k}": (np.sin(2 * np.pi * (0.12 + 0.04 * k) * t + rng.uniform(0, 6)) + 0.7 * rng.standard_normal((channels, length))).astype(np.float32) for k in range(n)}


def frames(spark, partitions):
    held = sessions()
    maps = spark.createDataFrame([(s, 32, m.ravel().tolist()) for s, m in held.items()] + [("short", 32, [0.0] * 320), ("thin", 4, [0.0] * 400)], "sid string, channels int, x array<float>")
    rows = [("both", s, "val" if k % 4 == 3 else "train") for k, s in enumerate(held)] + [("both", "short", "train"), ("both", "absent", "train"), ("both", "s0", "train")] + [("alone", f"s{k}", "train") for k in range(3)]
    return maps.repartition(partitions), spark.createDataFrame(rows, "run string, sid string, part string").repartition(partitions)


def plain(run, seed, train, val):
    """The same training without Spark."""
    held, t = sessions(), training.Training(seed, TINY)
    cut = lambda names, part, first, epoch, step, replica, size: [
        training.views(held[names[k]], training._generator(run, first, part, epoch, step, replica, item), TINY)
        for item, k in enumerate(training._generator(run, first, part, epoch, step, replica).integers(0, len(names), size))
    ]
    for epoch in range(TINY.epochs):
        total = 0.0
        for step in range(TINY.steps):
            flats = []
            for replica in range(TINY.replicas):
                a, b = map(np.stack, zip(*cut(train, 0, seed, epoch, step, replica, TINY.batch)))
                loss, grads, stats = training.batch_loss(a, b, t.found, TINY, True)
                flats.append(np.concatenate([[loss], *(grads[k].ravel() for k in t.names), *(s[k] for s in stats for k in sorted(s))]).astype(float))
            total += t.step(sum(flats[1:], flats[0]) / TINY.replicas)
        found = []
        for step in range(TINY.val_batches if val else 0):
            a, b = map(np.stack, zip(*cut(val, 1, TINY.val_seed, 0, step, 0, min(TINY.batch, len(val)))))
            found.append(training.batch_loss(a, b, t.found, TINY, False)[0])
        t.end_epoch(epoch, total / TINY.steps, float(np.mean(found)) if found else float("nan"), bool(val))
    return t


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    out = []
    for partitions in (1, 5):
        store = f"file://{tmp_path_factory.mktemp('store')}"
        maps, members = frames(spark, partitions)
        losses, _ = training.train_grid(maps, members, [1, 2], store, TINY)
        out.append((store, {(r.run, r.seed, r.epoch): (r.train_loss, r.val_loss) for r in losses.collect()}))
    return out


def test_training_equals_a_plain_loop_for_any_partitioning(spark, trained):
    (store, one), (_, five) = trained
    assert one == five and len(one) == 2 * 2 * 3
    names = [f"s{k}" for k in range(9)]
    for run, train, val in (("both", [s for k, s in enumerate(names) if k % 4 != 3], ["s3", "s7"]), ("alone", names[:3], [])):
        t = plain(run, 2, train, val)
        for epoch, train_loss, val_loss in t.losses:
            a, b = one[run, 2, epoch]
            assert a == pytest.approx(train_loss, rel=1e-4) and (b is None if not val else b == pytest.approx(val_loss, rel=1e-4))
        kept = training.load_weights(spark, store, run, 2)
        assert sorted(kept) == sorted(t.kept) and all(np.allclose(kept[k], t.kept[k], atol=1e-4) for k in kept)


def test_loss_falls_and_the_best_epoch_is_kept(spark, trained):
    store, one = trained[0]
    assert np.mean([one["both", s, 2][0] for s in (1, 2)]) < np.mean([one["both", s, 0][0] for s in (1, 2)])
    best = {(r.run, r.seed): (r.best_epoch, r.best_loss) for r in training.best_epochs(spark, store).collect()}
    for run, at in (("both", 1), ("alone", 0)):
        for seed in (1, 2):
            told = [one[run, seed, e][at] for e in range(3)]
            assert best[run, seed] == (int(np.argmin(told)), min(told))
    spread = metrics.seed_spread(training.best_epochs(spark, store), ["run"], "best_loss").collect()
    assert sorted((r.run, r.n_seeds) for r in spread) == [("alone", 2), ("both", 2)]


def test_finished_trainings_are_not_done_again(spark, trained, monkeypatch):
    store, one = trained[0]
    maps, members = frames(spark, 2)
    done = []
    monkeypatch.setattr(training, "_train", lambda *a: done.extend(a[3]))
    again, _ = training.train_grid(maps, members, [1, 2, 3], store, TINY)
    assert done == [("alone", 3), ("both", 3)] and again.count() == len(one)
    with pytest.raises(ValueError, match="few.*1 usable"):
        training.train_grid(maps, spark.createDataFrame([("few", "s1", "train")], "run string, sid string, part string"), [1], store, TINY)


def test_scoring_with_trained_weights(spark, trained):
    store, _ = trained[0]
    found = training.load_weights(spark, store, "both", 1)
    assert not np.allclose(found["stem.mean"], 0)
    maps, _ = frames(spark, 2)
    got = {(r.sid, r.readout): r.bpm for r in scoring.score_maps(maps.where("channels = 32"), "sid", "x", 32, found, 3.0, 60, 0.1, 0.5).collect()}
    m = sessions()["s4"]
    wave = physnet.forward((m - m.mean()) / (m.std() + 1e-6), found)
    assert wave.shape == (90,) and got["s4", "psd_sum"] > 0


def test_command_line_trains_and_scores(spark, tmp_path):
    """Two corpora at 30 samples a second, one with a test part: trained, scored and evaluated from tables to tables."""
    from pyspark.sql import functions as F

    from tidegrid import __main__ as command

    rng = np.random.default_rng(1)
    t = np.arange(860) / 30
    rows, manifest = [], []
    for c, corpus in enumerate(("cohface", "pure")):
        for k in range(6):
            sid, rate = f"{corpus.upper()}_{k}_0", 0.15 + 0.04 * k
            rows += [(sid, roi, (np.sin(2 * np.pi * rate * t + c) + 0.3 * rng.standard_normal(860)).tolist()) for roi in range(32)]
            manifest.append((sid, corpus, str(k), "ok", 60 * rate if corpus == "cohface" else None, None))
    spark.createDataFrame(rows, "sid string, roi int, x array<double>").write.parquet(f"{tmp_path}/maps")
    spark.createDataFrame(manifest, "sid string, dataset string, subject string, status string, gt_rr double, trial string").write.parquet(f"{tmp_path}/manifest")
    command.main(["splits", "--manifest", f"{tmp_path}/manifest", "--out", f"{tmp_path}/split", "--train-only", "pure"])
    args = ["train", "--maps", f"{tmp_path}/maps", "--split", f"{tmp_path}/split", "--manifest", f"{tmp_path}/manifest", "--train", "cohface,pure", "--eval", "cohface", "--seed", "1", "2", "--epochs", "1", "--steps", "1", "--bs", "2", "--out", f"{tmp_path}/out"]
    command.main(args)
    cells = spark.read.parquet(f"{tmp_path}/out/metrics").collect()
    assert sorted((r.run, r.dataset, r.subset, r.n) for r in cells) == [(f"run_cohface+pure_s{s}", "cohface", "test", 1) for s in (1, 2)]
    preds = spark.read.parquet(f"{tmp_path}/out/predictions")
    assert preds.count() == 2 * 1 * 4 and preds.where(F.isnan("bpm")).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/best").count() == 2
    command.main([*args, "--force"])  # trains nothing again
    assert spark.read.parquet(f"{tmp_path}/out/losses").count() == 2


def test_predictions_of_a_grid(spark, trained):
    store, _ = trained[0]
    maps, _ = frames(spark, 3)
    found = training.stored_weights(spark, store)
    assert sorted(found) == ["alone_s1", "alone_s2", "both_s1", "both_s2"]
    got = {(r.run, r.sid, r.readout): r.bpm for r in scoring.predict_runs(maps, found, 3.0, 60, 0.1, 0.5, 60).collect()}
    assert len(got) == 4 * 10 * 4 and np.isnan(got["both_s1", "thin", "mean"]) and not any(s == "short" for _, s, _ in got)
    one = {(r.sid, r.readout): r.bpm for r in scoring.score_maps(maps.where("channels = 32"), "sid", "x", 32, found["both_s2"], 3.0, 60, 0.1, 0.5).collect()}
    assert all(got["both_s2", s, r] == v for (s, r), v in one.items() if s != "short")
