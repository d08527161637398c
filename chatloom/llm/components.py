"""Connected components of a graph given as links, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.scratch import release, written


def _stars(links: DataFrame, label: str) -> DataFrame:
    """One alternating step: every node's larger neighbours, then its smaller ones, move to its least neighbour.

    The least neighbour is an aggregate with partial sums, so a node with very many links meets them as one row
    a task; the table of least neighbours is small and joined back on its own shuffle, which AQE may split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), f"{label}-least")
    large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large.where("a <> b").distinct(), f"{label}-large")
    release(least)
    # now b < a in every row
    least = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"), f"{label}-least")
    moved = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = moved.where("a <> b").union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    out = written(small.distinct(), f"{label}-small")
    release(least, large, links)
    return out


def _is_settled(links: DataFrame) -> bool:
    """Whether every node has one link to its root and roots have none: one aggregate over both ends."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the least node that can be reached from it.

    Alternates large-star and small-star steps until all links lead straight to a root, which takes a number of rounds that
    grows with the logarithm of the component's size; links that are stars already take none. Links with a null end
    and loops are left out; no links, no rows.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-links")
    while not _is_settled(links):
        links = _stars(links, label)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
