"""Connected components by alternating large and small stars.

Each round joins links with the least neighbour of their ends and is written to
the shared folder; nothing but two numbers a round comes to the driver. Least
neighbours are aggregated before the shuffle, so a node with very many links costs
one row a task there, and joins on it are splittable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links``: pairs of longs ``a``, ``b``. Gives ``node`` and ``root`` (the least
    node reachable) for every node of a link between different nodes."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    seen = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        links = _small_star(_large_star(links))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its least neighbour or itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, move to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
