"""Splits by person: nobody is in two parts.

Membership follows either a seeded permutation of the sorted subjects of a dataset (``permuted``) or an order by hash (``hashed``, all in Spark, same part sizes).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .catalog import usable, variant_keep


def part_sizes(n: Column, ratios: tuple[float, float, float]) -> tuple[Column, Column]:
    """Subjects for test and val of n: rounded half to even, one at least, one left for training; none below three."""
    test = F.greatest(F.lit(1), F.least(F.bround(F.lit(ratios[2]) * n).cast("int"), n - 2))
    test = F.when(n >= 3, test).otherwise(0)
    val = F.greatest(F.lit(1), F.least(F.bround(F.lit(ratios[1]) * n).cast("int"), n - test - 1))
    return test, F.when(n >= 3, val).otherwise(0)


def _parts(ranked: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """part of each (dataset, subject, place from 0, n)."""
    test, val = part_sizes(F.col("n").cast("int"), ratios)
    place = F.col("place")
    part = F.when(place < test, "test").when(place < test + val, "val").otherwise("train")
    return ranked.select("dataset", "subject", part.alias("part"))


def _ranked(subjects: DataFrame, seed: int) -> DataFrame:
    """place (from 0) of each subject of a dataset in the order of the MD5 of seed and subject, and n, how many there are.

    Subjects are ranked in parts by the first digits of the hash, so that a dataset of many subjects is no single task.
    """
    keyed = subjects.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("subject")))).withColumn("digits", F.substring("key", 1, 3))
    own, so_far = Window.partitionBy("dataset"), Window.partitionBy("dataset").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("dataset", "digits").agg(F.count("*").alias("here")).select("dataset", "digits", F.coalesce(F.sum("here").over(so_far), F.lit(0)).alias("ahead"), F.sum("here").over(own).alias("n"))
    within = F.row_number().over(Window.partitionBy("dataset", "digits").orderBy("key", "subject")) - 1
    return keyed.withColumn("within", within).join(counts, ["dataset", "digits"]).select("dataset", "subject", (F.col("within") + F.col("ahead")).alias("place"), "n")


def hashed(sessions: DataFrame, ratios: tuple[float, float, float] = DEFAULT.ratios, seed: int = DEFAULT.seed) -> DataFrame:
    return _parts(_ranked(sessions.select("dataset", F.col("subject").cast("string").alias("subject")).distinct(), seed), ratios)


def permuted(sessions: DataFrame, ratios: tuple[float, float, float] = DEFAULT.ratios, seed: int = DEFAULT.seed) -> DataFrame:
    """By numpy's permutation of each distinct number of subjects, made in tasks and joined to the sorted subjects."""

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for n in rows["n"]:
                at = np.random.default_rng(seed).permutation(int(n))
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    yield pd.DataFrame({"n": n, "at": part, "place": np.arange(a, a + len(part))})

    subjects = sessions.select("dataset", F.col("subject").cast("string").alias("subject")).distinct()
    numbered = subjects.withColumns({"at": F.row_number().over(Window.partitionBy("dataset").orderBy("subject")) - 1, "n": F.count("*").over(Window.partitionBy("dataset"))})
    places = numbered.select("n").distinct().mapInPandas(permute, "n long, at int, place int")
    return _parts(numbered.join(places, ["n", "at"]), ratios)


def members(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Long table (dataset, subject, sid, part) with every session also under ``all``."""
    rows = sessions.select("dataset", F.col("subject").cast("string").alias("subject"), "sid").join(parts, ["dataset", "subject"])
    return rows.unionByName(rows.withColumn("part", F.lit("all")))


def build(manifest: DataFrame, train_only: Sequence[str] = (), variant: str = "full", ratios: tuple[float, float, float] = DEFAULT.ratios, seed: int = DEFAULT.seed) -> DataFrame:
    """Split of a manifest's usable sessions; datasets that only train have all of theirs under ``all`` and no other part."""
    rows = usable(manifest, keep=variant_keep(variant))
    parts = hashed(rows.where(~F.col("dataset").isin(*train_only)) if train_only else rows, ratios, seed)
    whole = rows.select("dataset", F.col("subject").cast("string").alias("subject"), "sid")
    return whole.join(parts, ["dataset", "subject"]).unionByName(whole.withColumn("part", F.lit("all")))


def build_report(split: DataFrame, manifest: DataFrame, train_only: Sequence[str] = ()) -> DataFrame:
    """Sessions, subjects and sessions with a reference of each part (none counts where a dataset only trains), and its role."""
    only = F.col("dataset").isin(*train_only) if train_only else F.lit(False)
    rows = split.join(manifest.select("sid", "gt_rr"), "sid")
    counted = rows.groupBy("dataset", "part").agg(F.count("*").alias("sessions"), F.count_distinct("subject").alias("subjects"), F.count(F.when(~only, F.col("gt_rr"))).alias("n_with_gt"))
    return counted.withColumn("role", F.when(only, "training-only").otherwise("labelled"))


def report(split: DataFrame) -> DataFrame:
    return split.groupBy("dataset", "part").agg(F.count("*").alias("sessions"), F.count_distinct("subject").alias("subjects"))


def _auxiliary(sessions: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Sessions (dataset, sid, is_val) of unlabelled datasets: a share of subjects (second token of sid), one at least, validate."""
    rows = sessions.select("dataset", "sid", F.split("sid", "_")[1].alias("subject"))
    ranked = _ranked(rows.select("dataset", "subject").distinct(), seed)
    picked = ranked.where(F.col("place") < F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).select("dataset", "subject", F.lit(True).alias("picked"))
    return rows.join(picked, ["dataset", "subject"], "left").select("dataset", "sid", F.col("picked").isNotNull().alias("is_val"))


def aux_val(sessions: DataFrame, fraction: float = DEFAULT.val_fraction, seed: int = DEFAULT.val_seed) -> DataFrame:
    """Validation slice of unlabelled datasets."""
    return _auxiliary(sessions, fraction, seed).where("is_val").select("dataset", "sid")


def pool(split: DataFrame, sessions: DataFrame, datasets: list[str]) -> DataFrame:
    """(sid, part) for training on several datasets: own train and val where there is a test part, else all but a slice.

    Which of the named datasets exist and have a test part is asked first, in one job; then each dataset is read from its
    one source.
    """
    named = F.col("dataset").isin(datasets)
    flags = sessions.where(named).select("dataset", F.lit(False).alias("tested")).unionByName(split.where(named & (F.col("part") == "test")).select("dataset", F.lit(True).alias("tested")))
    tested = {r["dataset"]: r["tested"] for r in flags.groupBy("dataset").agg(F.max("tested").alias("tested")).collect()}  # the named datasets at most
    if missing := set(datasets) - set(tested):
        raise KeyError(f"unknown datasets {sorted(missing)}")
    own = split.where(F.col("dataset").isin([d for d, t in tested.items() if t]) & F.col("part").isin("train", "val")).select("sid", "part")
    if all(tested.values()):
        return own.distinct()
    rest = _auxiliary(sessions.where(F.col("dataset").isin([d for d, t in tested.items() if not t])), DEFAULT.val_fraction, DEFAULT.val_seed)
    rest = rest.select("sid", F.when(F.col("is_val"), "val").otherwise("train").alias("part"))
    return (own.unionByName(rest) if any(tested.values()) else rest).distinct()
