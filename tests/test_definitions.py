"""Queries that SQL does not express, against plain definitions written out here."""

import os

import numpy as np
import pytest

from tidegrid.functions import physnet, signal
from tidegrid.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def series(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id", "value").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        found.setdefault(r.user_id, []).append(r.value)
    return {k: np.array(v) for k, v in found.items()}


def filtered(b, a, x):
    """The difference equation, after a past of the first value and the output that belongs to it."""
    past, out = [x[0]] * (len(b) - 1), [x[0] * b.sum() / a.sum()] * (len(a) - 1)
    for v in x:
        out.append(b[0] * v + sum(c * past[-k] for k, c in enumerate(b[1:], 1)) - sum(c * out[-k] for k, c in enumerate(a[1:], 1)))
        past.append(v)
    return np.array(out[len(a) - 1 :])


def band_passed(x):
    b, a = signal.butter_band(3, 0.1, 0.5, 2.0)
    t = np.arange(len(x))
    x = x - np.polyval(np.polyfit(t, x, 1), t)
    pad = 3 * len(b)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        wide = filtered(b, a, wide)[::-1]
    return wide[pad:-pad]


def test_band_pass_is_a_butterworth_of_third_order():
    b, a = signal.butter_band(3, 0.1, 0.5, 2.0)
    warp = lambda f: 2 * 2.0 * np.tan(np.pi * f / 2.0)
    low, high = warp(0.1), warp(0.5)
    for f in (0.02, 0.1, 0.2, 0.35, 0.5, 0.8):
        z, w = np.exp(-2j * np.pi * f / 2.0 * np.arange(7)), warp(f)
        assert abs((b @ z) / (a @ z)) ** 2 == pytest.approx(1 / (1 + ((w * w - low * high) / (w * (high - low))) ** 6), rel=1e-6)


def test_bandpass_filtfilt(spark, series):
    got = {}
    for r in registry.queries()["bandpass_filtfilt"](spark, DATA).collect():
        got.setdefault(r.user_id, {})[r.i] = r.y
    assert sorted(got) == sorted(series)
    for user, x in series.items():
        assert np.allclose([got[user][i] for i in range(len(x))], band_passed(x), atol=2e-5)


def test_belt_rates(spark, series):
    got = {r.user_id: r.gt_rr for r in registry.queries()["belt_rates"](spark, DATA).collect()}
    assert sorted(got) == sorted(series)
    bins = [k for k in range(8192) if 0.1 <= k * 2.0 / 8192 <= 0.5]
    for user, x in series.items():
        y = band_passed(x)
        n = min(len(y), 120)
        hann = np.sin(np.pi * np.arange(n) / n) ** 2
        power = 0
        for start in range(0, len(y) - n + 1, n - n // 2):
            part = (y[start : start + n] - y[start : start + n].mean()) * hann
            power = power + np.abs([(part * np.exp(-2j * np.pi * k * np.arange(n) / 8192)).sum() for k in bins]) ** 2
        assert got[user] == pytest.approx(bins[int(np.argmax(power))] * 2.0 / 8192 * 60)


def wave(m, w):
    """The network in scoring, by patches, with one map's axes (features, channels, time)."""

    def block(h, name):
        kernel = w[f"{name}.w"].astype(float)
        kr, kc = kernel.shape[2:]
        wide = np.pad(h, ((0, 0), (kr // 2,) * 2, (kc // 2,) * 2))
        y = np.einsum("ocij,cmtij->omt", kernel, np.lib.stride_tricks.sliding_window_view(wide, (kr, kc), axis=(1, 2)), optimize=True)
        at = lambda k: w[f"{name}.{k}"].astype(float)[:, None, None]
        y = (y + at("b") - at("mean")) / np.sqrt(at("var") + 1e-5) * at("gain") + at("shift")
        return np.where(y > 0, y, np.exp(np.minimum(y, 0)) - 1)

    def halved(h, axis):
        n = h.shape[axis] // 2 * 2
        return (np.take(h, range(0, n, 2), axis) + np.take(h, range(1, n, 2), axis)) / 2

    def stretched(h, n):
        place = (np.arange(n) + 0.5) * h.shape[2] / n - 0.5
        return np.stack([[np.interp(place, np.arange(h.shape[2]), row) for row in plane] for plane in h])

    t = m.shape[1]
    h = block(m[None], "stem")
    for stage in ("s1", "s2", "mid_", "s3"):
        h = halved(h, 1)
        h = halved(h, 2) if stage == "mid_" else h
        h = block(block(h, stage + "a"), stage + "b")
    h = block(stretched(h, 2 * h.shape[2]), "up")
    h = stretched(h, t) if h.shape[2] != t else h
    return w["head.w"][0, :, 0, 0] @ h.mean(axis=1) + w["head.b"][0]


def test_batch_scoring(spark, series):
    got = {(r.user_id, r.readout): r.bpm for r in registry.queries()["batch_scoring"](spark, DATA).collect()}
    assert len(got) == 4 * len(series)
    for user, x in sorted(series.items())[:5]:
        m = np.stack([x[r : len(x) - 15 + r] for r in range(16)])
        want = signal.readouts(wave((m - m.mean()) / (m.std() + 1e-6), physnet.weights()), 30, 15.0, 1.0, 4096, 0.1, 0.5)
        for name, bpm in zip(("psd_sum", "mean", "median", "snr_mean"), want):
            assert got[user, name] == pytest.approx(bpm, rel=1e-3)
