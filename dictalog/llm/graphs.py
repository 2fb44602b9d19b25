"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictalog.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in ``links`` (a, b: long).

    Each round links the larger neighbours of every node with its smallest neighbour, then the smaller ones, until only stars are left: every link goes to a
    smaller node, so their centres are the components then. A node's neighbours are never gathered: both steps are a minimum and a join.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))  # a row for each link; copies go with the small stars
        large = materialize(large, "large-stars")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
        now = materialize(small.filter("a != b").distinct(), "small-stars")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")


def _stars(links: DataFrame) -> bool:
    """No node has two links to smaller nodes, or a link to a smaller and one to a larger node."""
    up = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
