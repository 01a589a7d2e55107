"""Operators on uniformly sampled series, kept as one array a row or as long rows (series, place, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_series(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "x") -> DataFrame:
    """One array a series, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(*by).agg(F.transform(items, lambda r: r["_v"]).alias(name))


def windows(rows: DataFrame, x: str, width: int, step: int) -> DataFrame:
    """Complete windows of an array: start and w.  A series shorter than the width is one window; an empty one has none."""
    n = F.size(x)
    own = F.least(F.lit(width), n)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - own, F.lit(max(1, step))))
    return rows.withColumn("start", F.explode(starts)).withColumn("w", F.slice(F.col(x), F.col("start") + 1, own))


def remove_line(rows: DataFrame, by: Sequence[str], place: str, value: str) -> DataFrame:
    """Long rows less their least-squares line."""
    own = Window.partitionBy(*by)
    slope = F.regr_slope(F.col(value), F.col(place)).over(own)
    intercept = F.regr_intercept(F.col(value), F.col(place)).over(own)
    line = F.coalesce(slope * F.col(place) + intercept, F.avg(value).over(own))
    return rows.withColumn("detrended", F.col(value) - line)


def rising_edges(rows: DataFrame, by: Sequence[str], order: Sequence[str], on: str) -> DataFrame:
    """Places of the first two changes from off to on, and how many there are; series with fewer than two are absent."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = rows.withColumns({"_on": F.col(on).cast("int"), "_place": F.row_number().over(w) - 1})
    edges = flagged.withColumn("_before", F.lag("_on").over(w)).where("_on = 1 and _before = 0")
    ranked = edges.groupBy(*by).agg(F.array_sort(F.collect_list("_place")).alias("p"))
    return ranked.where(F.size("p") >= 2).select(*by, F.col("p")[0].alias("first"), F.col("p")[1].alias("second"), F.size("p").alias("n_edges"))


def stimulus_window(edges: DataFrame, fs: float, onset: float = 30.0, tolerance: float = 1.0) -> DataFrame:
    """Start and end in seconds where the first edge is near the expected onset."""
    t = edges.withColumns({"start_s": F.col("first") / fs, "end_s": F.col("second") / fs})
    return t.where((F.abs(F.col("start_s") - onset) <= tolerance) & (F.col("end_s") > F.col("start_s")))


def trim_flat(rows: DataFrame, by: Sequence[str], place: str, value: str, flat: float) -> DataFrame:
    """Without leading and trailing runs of one idle value; wholly idle series vanish, inner runs stay."""
    own = Window.partitionBy(*by)
    live = F.when(F.col(value) != flat, F.col(place))
    ends = rows.withColumns({"_a": F.min(live).over(own), "_z": F.max(live).over(own)})
    return ends.where(F.col(place).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def decimate(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Every k-th row from the first."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("place", place).where(F.col("place") % k == 0)


def probe_places(sessions: DataFrame, n: str, most: int = 24) -> DataFrame:
    """Distinct evenly spaced places 0..n-1, ``most`` at most, truncated to whole ones."""
    m = F.least(F.lit(most), F.col(n))
    i = F.sequence(F.lit(0), (m - 1).cast("int"))
    step = F.when(m > 1, (F.col(n) - 1).cast("double") / (m - 1)).otherwise(0.0)
    return sessions.where(F.col(n) > 0).withColumn("place", F.explode(F.array_distinct(F.transform(i, lambda v: F.floor(v * step)))))


def previous_pairs(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each row with the value before it; the first of a series has none and is absent."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull())


def resample_linear(rows: DataFrame, by: Sequence[str], place: str, value: str, source: float, target: float) -> DataFrame:
    """Long series at ``source`` Hz on the grid of ``target`` Hz by linear interpolation: rows (series, i, value).

    Every source row makes the grid points from itself up to the next row, so nothing is joined.
    """
    w = Window.partitionBy(*by).orderBy(place)
    p, ratio = F.col(place), source / target
    rows = rows.withColumns({"_next": F.lead(value).over(w), "_top": F.max(place).over(Window.partitionBy(*by))})
    first = F.ceil(p / ratio)
    last = F.when(p == F.col("_top"), F.floor(p / ratio)).otherwise(F.ceil((p + 1) / ratio) - 1)
    points = rows.withColumn("_i", F.explode(F.when(last >= first, F.sequence(first, last)))).withColumn("_share", F.col("_i") * ratio - p)
    mixed = F.col(value) + F.when(F.col("_share") > 0, F.col("_share") * (F.col("_next") - F.col(value))).otherwise(0.0)
    return points.select(*by, F.col("_i").cast("long").alias("i"), mixed.alias("value"))


def stretch(x: Column, length: int) -> Column:
    """An array resampled to ``length`` points from its first to its last by linear interpolation."""
    n = F.size(x)

    def at(i: Column) -> Column:
        s = i * (n - 1) / float(max(1, length - 1))
        a = F.floor(s).cast("int")
        return F.element_at(x, a + 1) * (1 - (s - a)) + F.element_at(x, F.least(a + 2, n)) * (s - a)

    return F.when(n == length, x).when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))


def standardise(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Less the mean, over the population deviation plus 1e-6, over all rows of a group."""
    own = Window.partitionBy(*by)
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(own)) / (F.stddev_pop(value).over(own) + 1e-6))


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 by the MD5 of seed and keys: the same wherever it is computed."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(seed, *keys, F.lit("a")))) * F.cos(2.0 * math.pi * uniform(seed, *keys, F.lit("b")))


def two_views(rows: DataFrame, by: Sequence[str], roi: str, place: str, value: str = "x", noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Even and odd channels as views a and b of long rows, each with noise of ``noise`` times its view's population deviation
    (and 1e-6) if asked for; the draw follows from seed, series, channel and place."""
    out = rows.withColumn("view", F.when(F.col(roi) % 2 == 0, "a").otherwise("b"))
    if not noise:
        return out
    spread = F.stddev_pop(value).over(Window.partitionBy(*by, "view")) + 1e-6
    return out.withColumn(value, F.col(value) + noise * spread * normal(seed, *map(F.col, by), F.col(roi), F.col(place)))


def training_batch(maps: DataFrame, draws: DataFrame, sid: str, target: int, minus: int, plus: int, noise: float, seed: int) -> DataFrame:
    """Rows (draw, view, roi, i, z): for each draw (draw, sid) of a map (sid, roi, x) one clip for all its channels, stretched to
    the target length, in two noisy views, each standardised over all its channels."""
    lengths = maps.groupBy(sid).agg(F.max(F.size("x")).alias("_n"))
    clips = clip_draws(draws.join(lengths, sid), "_n", target, minus, plus, seed, ("draw", sid))
    part = stretch(F.slice(F.col("x"), F.col("clip_start") + 1, F.col("clip_length")), target)
    long = clips.select("draw", sid, "clip_start", "clip_length").join(maps, sid).select("draw", "roi", F.posexplode(part).alias("i", "x"))
    return standardise(two_views(long, ["draw"], "roi", "i", "x", noise, seed), ["draw", "view"], "x").select("draw", "view", "roi", "i", "z")


def block_mean(rows: DataFrame, by: Sequence[str], row: str, col: str, value: str, side: int, grid: int) -> DataFrame:
    """Means of grid x grid blocks of a side x side image; what is left over at the far edges is cropped."""
    size = side // grid
    inside = rows.where((F.col(row) < grid * size) & (F.col(col) < grid * size))
    roi = F.floor(F.col(row) / size) * grid + F.floor(F.col(col) / size)
    return inside.groupBy(*by, roi.cast("long").alias("roi")).agg(F.avg(value).alias("value"))


def clip_draws(pairs: DataFrame, length: str, target: int, minus: int, plus: int, seed: int, keys: Sequence[str] | None = None) -> DataFrame:
    """A clip of minus..plus around the target length (both included) at a uniform start, one draw for each pair, by seed and keys."""
    own = [F.col(c) for c in (pairs.columns if keys is None else keys)]
    size = F.lit(target - minus) + F.floor(uniform(seed, *own, F.lit("length")) * (minus + plus + 1)).cast("int")
    out = pairs.withColumn("clip_length", size)
    start = F.floor(uniform(seed, *own, F.lit("start")) * (F.col(length) - F.col("clip_length") + 1)).cast("int")
    return out.withColumn("clip_start", start).where(F.col("clip_length") <= F.col(length))


def draw_with_replacement(rows: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """n rows by index, repeats allowed: drawn indices join the ranks of the rows, which are counted in ranges of the order."""
    spark = rows.sparkSession
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count()
    if not total:
        return rows.limit(0).withColumn("draw", F.lit(0))
    draws = spark.range(n).select(F.col("id").cast("int").alias("draw"), F.least(F.floor(uniform(seed, F.col("id")) * total), F.lit(total - 1)).cast("long").alias("_at"))
    cuts = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts + 1000)).first()[0] or []
    spread = rows.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0))
    counts = spread.groupBy("_part").count().withColumn("_ahead", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = spread.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).join(counts.select("_part", "_ahead"), "_part")
    return ranked.withColumn("_at", F.col("_k") + F.col("_ahead")).join(draws, "_at").drop("_at", "_k", "_part", "_ahead")


def half_precision(x: Column) -> Column:
    """A number as it comes back from 16-bit storage: 11 significant bits, half to even, in steps of 2 ** -24 near zero."""
    size = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    unit = F.pow(F.lit(2.0), size - 10)
    kept = F.rint(x / unit) * unit
    return F.when(x.isNull() | F.isnan(x) | (x == 0) | (F.abs(x) == float("inf")), x).when(F.abs(kept) > 65504.0, F.signum(x) * float("inf")).otherwise(kept)
