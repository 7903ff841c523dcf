"""Connected components of a link table, by alternating stars.

Every round is two groupings and two joins over the links alone, ends with a
table in the shared folder, and needs about log(n) rounds. Only a count and a
checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcall.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(a, b), links in any direction, to (node, root); root is the smallest node of a component.

    Nodes that are their own root are not listed; loops and nulls don't count.
    """
    now = stage(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = stage(_small_star(_large_star(now)), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
