"""Contrastive loss between two views of each item of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def info_nce(items: DataFrame, batch: str, item: str, a: str, b: str, tau: float = DEFAULT.tau) -> DataFrame:
    """Symmetric loss of each batch; likeness is the negative mean squared difference of two arrays over tau.

    Every other item of the batch, in either view, is a negative; an item's own views are left out of the denominator.
    Items join only within their batch, whose size the caller chooses; an item's likenesses are gathered once.
    """
    side = lambda view, x: items.select(F.col(batch), F.col(item).alias("i"), F.lit(view).alias("view"), F.col(x).alias("p"))
    views = side("a", a).unionByName(side("b", b))
    other = views.select(F.col(batch), F.col("i").alias("j"), F.col("view").alias("other"), F.col("p").alias("q"))
    gap = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size("p")
    pairs = views.join(other, batch).withColumn("s", -gap / tau)
    pairs = pairs.where((F.col("i") != F.col("j")) | (F.col("view") != F.col("other"))).select(batch, "i", "view", "s", (F.col("i") == F.col("j")).alias("own"))
    each = pairs.groupBy(batch, "i", "view").agg(F.max(F.when(F.col("own"), F.col("s"))).alias("pos"), F.collect_list(F.when(~F.col("own"), F.col("s"))).alias("others"))
    top = F.array_max("others")
    rest = F.aggregate("others", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return each.groupBy(batch).agg(F.avg(F.log(rest) + top - F.col("pos")).alias("loss"), (F.count("*") / 2).cast("long").alias("n"))
