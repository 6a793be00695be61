"""Rollups of a run ledger, and the weighted score that leaves out what is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a run's aggregate score.
WEIGHTS = {"edit_coverage": 0.35, "support_coverage": 0.25, "representation_adequacy": 0.15, "uncertainty_honesty": 0.15, "noise_efficiency": 0.10}


def weighted(components: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the components that are not null; null without any."""
    add = lambda columns: reduce(lambda a, b: a + b, columns)
    worth = add([F.when(F.col(c).isNotNull(), F.lit(w) * F.col(c)).otherwise(0.0) for c, w in components.items()])
    total = add([F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in components.items()])
    return F.when(total > 0, worth / total)


def provider_rollup(ledger: DataFrame, provider: str, compliant: str, scores: list[str]) -> DataFrame:
    """Runs, rate of compliance and mean scores (nulls skipped) of each provider."""
    rate = F.avg(F.col(compliant).cast("double")).alias("compliance_rate")
    return ledger.groupBy(provider).agg(F.count("*").alias("n_runs"), rate, *[F.avg(c).alias(f"avg_{c}") for c in scores])


def winners(ledger: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The rows of the highest score of each key, ties kept."""
    return ledger.withColumn("_best", F.max(score).over(Window.partitionBy(*keys))).where(F.col(score) == F.col("_best")).drop("_best")


def grouped_counts(df: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Counts by grouping sets, with level naming the set's columns."""
    names = [[F.col(c) for c in s] for s in sets]
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return df.groupingSets(names, *columns).agg(F.count("*").alias("n"), level.alias("level"))


def dense_pivot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value by key, zero where there is none."""
    return df.groupBy(key).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v}") for v in values])


def map_outcomes(df: DataFrame, payload: Column) -> DataFrame:
    """How often each (key, value) of a map column occurs."""
    return df.select(F.explode(payload).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
