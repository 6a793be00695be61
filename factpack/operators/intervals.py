"""Half-open intervals: islands of strict overlap, and the tokens they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals (keys, island, start, end, n); intervals that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col(start) < before, 0).otherwise(1)
    numbered = df.withColumn("_open", opened).withColumn("island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def credited(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each key's islands: a quarter of the length of each, rounded up."""
    worth = F.ceil((F.col("end") - F.col("start")) / 4)
    return merged.groupBy(*keys).agg(F.sum(worth).cast("long").alias("tokens"), F.count("*").alias("n_islands"))
