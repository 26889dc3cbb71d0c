"""Connected components of a link table, by stars that merge until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trafficlens.session import written


def _swapped(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _stars(links: DataFrame) -> bool:
    """Whether each number hangs on one other that hangs on none."""
    sides = links.select(F.col("a").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    sides = sides.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sides.where((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every linked number; the component is its smallest number.

    ``links`` holds (a, b) as long numbers, in any direction and as often as they like.
    In turn, every number hands the smallest of its neighbours to its larger ones, and to
    its smaller ones; that keeps the components and ends in one star for each, after a
    number of rounds that grows with the logarithm of the longest path. Only the smallest
    neighbour is gathered per number, so a hub needs no more room than others. Each round
    is written to the shared folder and does not depend on executors that are lost.
    """
    a, b = F.col("a"), F.col("b")
    links = written(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while True:
        # Large star: larger neighbours go to the smallest of all neighbours.
        both = links.unionByName(_swapped(links))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        # Small star: a number and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        if _stars(links):
            break
    roots = links.select(b.alias("id"), b.alias("component")).distinct()
    return links.select(a.alias("id"), b.alias("component")).unionByName(roots)
