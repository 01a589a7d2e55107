"""Connected components of links by alternating large-star and small-star steps, all in grouped aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the least of its neighbours and itself."""
    near = _both(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself go to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of links (a, b): the least node of their component.

    Ends when a round changes nothing, which takes rounds in the order of the logarithm of the longest path.
    """
    digest = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    links = materialize(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        links = materialize(_small_star(_large_star(links)))
        now = tuple(links.agg(*digest).first())
        if now == before or not now[0]:
            break
        before = now
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
