"""Facts that corpora keep in names of files and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_timestamps(files: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Sorted nanosecond stamps of frames named Image<stamp>.png; other names are left out."""
    stamp = F.expr(f"try_cast(regexp_extract({name}, '^Image(.+)[.]png$', 1) AS bigint)")
    return files.withColumn("_s", stamp).where(F.col("_s").isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("stamps"))


def numeric_first(name: Column) -> Column:
    """Order of folder names: numbers by value, other names last."""
    return F.coalesce(name.try_cast("bigint"), F.lit(1 << 40))


def trial_kind(name: Column) -> Column:
    """S or N, the third token of a folder's name; else null."""
    kind = F.get(F.split(name, "_"), F.lit(2))
    return F.when(kind.isin("S", "N"), kind)


def person_and_scene(stem: Column) -> tuple[Column, Column]:
    """The parts before and after the last underscore."""
    return F.regexp_extract(stem, "^(.*)_([^_]*)$", 1), F.regexp_extract(stem, "^(.*)_([^_]*)$", 2)
