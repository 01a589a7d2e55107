"""Maps of a folder of videos, built in several runs and from the command line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import _shifted
from test_sources import _avi

from tidegrid import __main__ as command
from tidegrid import build


@pytest.fixture
def videos(spark, tmp_path):
    root = tmp_path / "videos"
    root.mkdir()
    rows = []
    for n, name in enumerate("abc"):
        rows.append((f"U_{n}_{name}", "u", str(n), 15.0, f"file:{root}/{name}.avi", "x" if n else None, 12.5 if n else float("nan")))
    rows += [("V_0_d", "v", "0", 15.0, f"file:{root}/d.avi", None, 20.0), ("V_1_gone", "v", "1", 15.0, f"file:{root}/gone.avi", None, 20.0)]
    return root, spark.createDataFrame(rows, "sid string, dataset string, subject string, fps double, video string, task string, gt_rr double")


def _video(frames=8):
    return _avi([np.repeat(_shifted(math.sin(k / 2))[..., None], 3, axis=2).tobytes() for k in range(frames)], side=64)


def _told(rows):
    return {r.sid: (r.status, r.reason, r.wave) for r in rows.collect()}


def test_runs_take_up_where_others_ended(spark, tmp_path, videos):
    root, sessions = videos
    none = spark.createDataFrame([], "sid string, frame int, x double, y double, w double, h double, score double")
    out = str(tmp_path / "store")
    run = lambda **more: build.video_maps(sessions, str(root), none, out, whole=True, side=32, grid=2, target=15.0, least_s=0.4, wait_s=0, **more)
    for name in "abd":
        (root / f"{name}.avi").write_bytes(_video())
    rows = run(limit=2)
    assert _told(rows) == {"U_0_a": ("ok", None, 1), "U_1_b": ("ok", None, 1), "V_0_d": ("ok", None, 1), "V_1_gone": ("skip", "no_frames", 2)}
    got = {r.sid: r for r in rows.collect()}
    assert got["U_0_a"].gt_rr is None and got["U_1_b"].gt_rr == 12.5 and got["V_1_gone"].gt_rr is None and got["U_1_b"].task == "x" and got["U_1_b"].T == 7
    first = sorted((r.sid, r.roi, r.x) for r in build.stored_maps(spark, out).collect())
    assert len(first) == 12 and len(first[0][2]) == 7
    (root / "c.avi").write_bytes(_video(9))
    (root / "gone.avi").write_bytes(_video())
    assert _told(run(retry_skipped=True)) == {"U_0_a": ("ok", None, 1), "U_1_b": ("ok", None, 1), "U_2_c": ("ok", None, 1), "V_0_d": ("ok", None, 1), "V_1_gone": ("ok", None, 1)}
    assert _told(run(limit=1)) == {"U_0_a": ("cached", None, 0), "U_1_b": ("ok", None, 1), "U_2_c": ("ok", None, 1), "V_0_d": ("cached", None, 0), "V_1_gone": ("ok", None, 1)}
    again = sorted((r.sid, r.roi, r.x) for r in build.stored_maps(spark, out).collect())
    assert [r for r in again if r[0] not in ("U_2_c", "V_1_gone")] == first and len(again) == 20
    (root / "a.avi").write_bytes(_video(10))
    rows = run(limit=1, force=True)
    assert _told(rows)["U_0_a"] == ("ok", None, 1) and {r.sid: r["T"] for r in rows.collect()}["U_0_a"] == 9
    forced = {(r.sid, r.roi): r.x for r in build.stored_maps(spark, out).collect()}
    assert len(forced) == 20 and len(forced["U_0_a", 0]) == 9 and all(forced[s, k] == x for s, k, x in again if s[0] == "U" and s != "U_0_a")


def test_maps_from_the_command_line(spark, tmp_path, videos, capfd):
    root, sessions = videos
    (root / "a.avi").write_bytes(_video(80))
    sessions.where(F.col("sid") == "U_0_a").write.parquet(str(tmp_path / "sessions"))
    command.main(["maps", "--sessions", str(tmp_path / "sessions"), "--videos", str(root), "--limit", "3", "--jobs", "2", "--out", str(tmp_path / "out")])
    assert _told(build.records(spark, str(tmp_path / "out"))) == {"U_0_a": ("ok", None, 1)}
    assert build.stored_maps(spark, str(tmp_path / "out")).count() > 0
