import glob
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.sources import map_store

SCHEMA = "sid string, roi int, x array<double>, dataset string"


def _maps(spark, sids, value=1.0):
    rows = [(s, k, [value] * 3, None if s == "n" else "d/ %1" if s in "ab" else "e") for s in sids for k in range(2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "sid")


def _got(spark, path):
    return sorted((r.sid, r.roi, r.x[0], r.dataset) for r in map_store.stored(spark, path, SCHEMA).collect())


def _files(path):
    return glob.glob(f"{path}/data/*/*.parquet")


def test_a_second_run_adds_only_what_is_not_stored(spark, tmp_path):
    path = str(tmp_path / "maps")
    assert _got(spark, path) == []
    map_store.add(_maps(spark, "abn"), path)
    map_store.add(_maps(spark, "abcn", 2.0), path)
    want = [(s, k, 2.0 if s == "c" else 1.0, None if s == "n" else "e" if s == "c" else "d/ %1") for s in "abcn" for k in range(2)]
    assert _got(spark, path) == want
    one = map_store.stored(spark, path, SCHEMA).where("dataset = 'e'")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(dataset" in one._jdf.queryExecution().toString()
    map_store.add(_maps(spark, "x", 3.0), path, force=True)
    assert _got(spark, path) == [("x", k, 3.0, "e") for k in range(2)]
    map_store.add(_maps(spark, "x").limit(0), path)
    assert len(_got(spark, path)) == 2


def test_a_job_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "maps")
    map_store.add(_maps(spark, "a"), path)
    before, files = _got(spark, path), sorted(_files(path))

    @F.udf("array<double>")
    def broken(sid, x):
        if sid == "c":
            raise ValueError("killed")
        return x

    with pytest.raises(Exception, match="killed"):
        map_store.add(_maps(spark, "bcef").withColumn("x", broken("sid", "x")), path)
    assert _got(spark, path) == before and sorted(_files(path)) == files
    map_store.add(_maps(spark, "bcef"), path)
    assert [r[0] for r in _got(spark, path)] == sorted("abcef" * 2)


def test_attempts_that_run_twice_count_once(tmp_path):
    path = str(tmp_path / "maps")
    batch = pa.RecordBatch.from_pydict({"sid": ["a", "b", "c"], "dataset": ["d", "d", None]})
    writer = map_store.KeyedWriter(path, "dataset", False)
    writer.write(iter([batch]))  # a task whose executor was lost after it had written
    told = writer.write(iter([batch, batch.slice(0, 1)]))
    writer.commit([told, None])
    assert sorted(_files(path)) == sorted(f"{path}/data/{f}" for f in told.files)
    assert len(json.load(open(glob.glob(f"{path}/commits/*.json")[0]))["files"]) == len(told.files)


def test_of_two_jobs_at_once_one_gives_up(tmp_path):
    path = str(tmp_path / "maps")
    batch = pa.RecordBatch.from_pydict({"sid": ["a"], "dataset": ["d"]})
    one, two = (map_store.KeyedWriter(path, "dataset", False) for _ in range(2))
    mine, other = one.write(iter([batch])), two.write(iter([batch]))
    one.commit([mine])
    with pytest.raises(map_store.Changed):
        two.commit([other])
    two.abort([other])
    assert len(_files(path)) == 1


def test_upsert_of_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    map_store.upsert(_maps(spark, "ab"), path)
    map_store.upsert(_maps(spark, "bc", 2.0), path)
    assert [(s, v) for s, _, v, _ in _got(spark, path)] == [("a", 1.0)] * 2 + [("b", 2.0)] * 2 + [("c", 2.0)] * 2


def test_rows_chosen_by_an_older_version_are_not_added(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "maps")
    save = map_store._save

    def late(*args):
        monkeypatch.setattr(map_store, "_save", save)
        map_store.add(_maps(spark, "a"), path)  # another run, after the rows were chosen
        save(*args)

    monkeypatch.setattr(map_store, "_save", late)
    with pytest.raises(Exception, match="has changed"):
        map_store.add(_maps(spark, "a", 2.0), path)
    assert _got(spark, path) == [("a", k, 1.0, "d/ %1") for k in range(2)] and len(_files(path)) == 1
