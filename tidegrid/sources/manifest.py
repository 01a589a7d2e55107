"""Manifests, maps and reports: JSON objects keyed by session in, tables and Markdown out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import fir_decimate
from ..operators.catalog import drop_private, with_reasons
from ..operators.spectral import per_array
from ..operators.timeseries import half_precision

RECORD = "dataset string, subject string, status string, reason string, fps_src double, gt_rr double, T int, M int, n_frames bigint, trial string, task string, head_motion boolean, illumination string, box array<int>"


def read_manifest(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """One row for each key of whole-file JSON objects; bare NaN is read, absent fields are null."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{_fields(record)}>>").alias("m"))
    return rows.select(F.explode("m").alias("sid", "r")).where(~F.col("sid").startswith("_")).select("sid", "r.*")


def _fields(record: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (x.strip().split(" ", 1) for x in record.split(", ")))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Lines of JSON, one record each, without private columns; the folder is made."""
    drop_private(rows).write.mode("overwrite").json(path)


def write_maps(maps: DataFrame, path: str, spark: SparkSession, force: bool = False, half: bool = False) -> None:
    """Adds maps (sid, dataset, x, ...) whose session is not stored yet, or all if forced; parted by dataset, and rounded to half
    precision if asked for."""
    try:
        stored = None if force else spark.read.parquet(path).select("sid").distinct()
    except Exception as error:  # the folder does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = None
    new = maps if stored is None else maps.join(stored, "sid", "left_anti")
    if half:
        new = new.withColumn("x", F.transform("x", half_precision))
    new.write.mode("overwrite" if force else "append").partitionBy("dataset").parquet(path)


def load_maps(spark: SparkSession, path: str, wanted: DataFrame, least: int, q: int = 1) -> tuple[DataFrame, DataFrame]:
    """Stored maps (sid, roi, x) of wanted sessions, decimated by q, and the sessions that are left out with their reasons."""
    stored = spark.read.parquet(path)
    lengths = stored.groupBy("sid").agg(F.max(F.size("x")).alias("T"))
    told = with_reasons(wanted.select("sid").distinct(), lengths, least, q)
    kept = stored.join(told.where("reason is null").select("sid"), "sid", "left_semi")
    if q > 1:
        kept = kept.withColumn("x", per_array(fir_decimate, "x", "array<double>", q=q))
    return kept, told.where("reason is not null").select("sid", "reason")


def write_predictions(preds: DataFrame, path: str) -> None:
    """Rows (run, sid, readout, bpm), one folder a run; runs that are written again replace their own."""
    preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_checkpoint(weights: Mapping[str, np.ndarray], spark: SparkSession, path: str) -> None:
    """A network's tensors as rows (name, shape, values); each better epoch replaces the last."""
    rows = [(k, [int(n) for n in v.shape], v.astype(float).ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def markdown(rows: DataFrame, columns: Sequence[str], formats: dict[str, str] | None = None, most: int = 10_000) -> str:
    """A report table, on the driver; more than ``most`` rows are an error, never cut off."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} rows; write it as a table")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    for r in rows.select(*columns).collect():
        cells = ["" if r[c] is None else format(r[c], (formats or {}).get(c, "")) for c in columns]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines)
