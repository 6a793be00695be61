"""Connected components as DataFrame joins: alternating large-star and small-star steps.

Each step links every vertex to the least vertex it can see; the two steps together converge in a
number of rounds that grows with the logarithm of a component's diameter. Links stay in tables in
the shared folder; the driver sees two numbers a round. A hub's links are joined, not gathered, so
an adaptive skew join can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, table


def _canonical(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    to_least = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _canonical(to_least.unionByName(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links (a, b) -> one row (a, b) per vertex with a link: b is the least vertex of a's component.

    The least vertex itself has no row. Vertices can be of any ordered type. Null vertices and loops
    link nothing. Raises where ``rounds`` rounds (a component of more than 2 ** rounds hops) don't do.
    """
    now = table(_canonical(links.where("a is not null and b is not null")))
    seen = None
    for _ in range(rounds):
        new = table(_small_star(_large_star(now)))
        said = new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        drop(now)
        now = new
        if said == seen:
            return now
        seen = said
    raise RuntimeError(f"components did not settle in {rounds} rounds")
