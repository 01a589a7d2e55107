"""Session catalogue and manifest: filters, keyed upsert, lookups, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("ok", "cached")


def usable(manifest: DataFrame, dataset: str | None = None, require_reference: bool = False, keep: Column | None = None) -> DataFrame:
    """Finished sessions, of one dataset, with a reference, and that meet ``keep``, as far as asked for."""
    rows = manifest.where(F.col("status").isin(*DONE))
    for wanted in (keep, F.col("dataset") == dataset if dataset is not None else None, F.col("gt_rr").isNotNull() if require_reference else None):
        rows = rows if wanted is None else rows.where(wanted)
    return rows


def variant_keep(variant: str, dataset: str = "dataset", trial: str = "trial", corpus: str = "mahnob", neutral: str = "N") -> Column:
    """Condition of a variant: ``full`` keeps all; ``sonly`` leaves out neutral trials of one corpus, never unknown ones."""
    if variant == "full":
        return F.lit(True)
    if variant == "sonly":
        return ~(F.col(dataset).eqNullSafe(corpus) & F.col(trial).eqNullSafe(neutral))
    raise ValueError(f"unknown variant {variant!r}: full or sonly")


def retry_selection(catalogue: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions that the manifest does not have as finished."""
    return catalogue.join(manifest.where(F.col("status").isin(*DONE)).select("sid"), "sid", "left_anti")


def with_status(work: DataFrame, least_side: int = 32, least_length: int = 150) -> DataFrame:
    """Adds status and reason of each attempt: cached where a map is stored, error where one was raised, skip with the first
    reason that holds, else ok.

    ``work`` has stored, error (class and message, null without), n_frames, side (of the box; null without a face) and T
    (columns of the map at the target rate; null without flow).
    """
    skip = (
        F.when(F.coalesce("n_frames", F.lit(0)) < 2, "no_frames").when(F.col("side").isNull(), "no_face").when(F.col("side") < least_side, "box_too_small")
        .when(F.col("T").isNull(), "no_flow").when(F.col("T") < least_length, "too_short")
    )
    reason = F.when(F.col("stored"), None).otherwise(F.coalesce(F.col("error"), skip))
    status = F.when(F.col("stored"), "cached").when(F.col("error").isNotNull(), "error").when(skip.isNotNull(), "skip").otherwise("ok")
    return work.withColumns({"status": status, "reason": reason})


def upsert(old: DataFrame, new: DataFrame, key: str = "sid") -> DataFrame:
    """Rows of both by key, new ones winning; columns that one side lacks are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_per_group(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("place") <= n).drop("place")


def lookup(rows: DataFrame, key: str, table: Mapping, default, name: str) -> DataFrame:
    """A small fixed table's value for a key, or the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return rows.withColumn(name, F.coalesce(F.create_map(*pairs)[F.col(key)], F.lit(default)))


def session_rates(frames: DataFrame, sid: str, ts: str) -> DataFrame:
    """Frames, span and rate (n - 1) / span of sessions that have two frames at least and a positive span."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    out = frames.groupBy(sid).agg(F.count("*").alias("n_frames"), F.min(seconds).alias("t0"), F.max(seconds).alias("t1"))
    out = out.where("n_frames >= 2 and t1 > t0").withColumn("duration_s", F.col("t1") - F.col("t0"))
    return out.select(sid, "n_frames", "duration_s", ((F.col("n_frames") - 1) / F.col("duration_s")).alias("fps"))


def status_histogram(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def corpus_report(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count("gt_rr").alias("with_gt"),
        F.min("T").alias("t_min"), F.median("T").cast("int").alias("t_median"), F.max("T").alias("t_max"),
    )


def drop_private(rows: DataFrame) -> DataFrame:
    """Without columns whose name begins with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def with_reasons(wanted: DataFrame, maps: DataFrame, least: int, q: int = 1) -> DataFrame:
    """Wanted sessions with their length after decimation by q and why one is dropped: missing, or short before or after."""
    rows = wanted.join(maps.select("sid", "T"), "sid", "left")
    after = F.ceil(F.col("T") / q)
    short = F.when(F.col("T") < least, F.col("T")).when(after < least, after)
    reason = F.when(F.col("T").isNull(), "missing").when(short.isNotNull(), F.concat(F.lit("short:"), short.cast("string")))
    return rows.select("sid", after.cast("long").alias("T"), reason.alias("reason"))


def gather(rows: DataFrame, by: Sequence[str], sid: str = "sid") -> DataFrame:
    """Sorted distinct session ids of each group."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(sid)).alias("sids"))
