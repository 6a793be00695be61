"""Joins and ordered picks: unique keys, as-of look-ups, prioritised rules, optional matches, differences.

Orders are total: every pick takes a tie-breaker, so a result does not depend on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_key(df: DataFrame, keys: list[str], **picked: Column) -> DataFrame:
    """One row per key that occurs exactly once, with the picked columns; partial sums before a shuffle."""
    picks = [F.min(c).alias(name) for name, c in picked.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), *picks).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[Column], rest: list[str]) -> DataFrame:
    """The first row of each key: an aggregate of the least struct, not a window, so it combines early."""
    ordered = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*ordered, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column], rest: list[str]) -> DataFrame:
    ordered = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = F.max(F.struct(*ordered, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, upto: str, picked: list[str], tie: str, strict: bool = True) -> DataFrame:
    """Each left row with the last right row of its keys whose ``upto`` is before its ``at``.

    One shuffle by the keys: both sides run in one ordered stream, and the last right row so far is
    carried along, so the work is linear where a join on the keys would be quadratic.
    """
    names = [f.name for f in left.schema]
    side = F.struct(*[F.col(c).alias(f"_{c}") for c in [upto, *picked]])
    empty = F.lit(None).cast(right.select(side.alias("x")).schema["x"].dataType)
    # at equal times, strict puts the asking row first
    rows = left.select(*keys, F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*names).alias("_left"), empty.alias("_right"))
    theirs = right.select(*keys, F.col(upto).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), side.alias("_right"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(theirs).withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).where("_left is not null")
    return seen.select("_left.*", *[F.col(f"_seen._{c}").alias(c if c not in names else f"{c}_asof") for c in [upto, *picked]])


def nearest_scope(asks: DataFrame, ancestors: DataFrame, bindings: DataFrame, ask: list[str], visible: Column, depth: str, seq: str, picked: list[str]) -> DataFrame:
    """As-of over a hierarchy: the nearest scope first, then the latest visible binding.

    asks have (ask..., scope, name); ancestors (scope, ancestor, depth); bindings (ancestor, name, seq, picked).
    The pick is an aggregate of the best struct, combined before the shuffle.
    """
    rows = asks.join(ancestors, "scope").join(bindings, ["ancestor", "name"]).where(visible)
    best = F.min(F.struct(F.col(depth).alias("_depth"), (-F.col(seq)).alias("_seq"), *picked)).alias("_best")
    return rows.groupBy(*ask).agg(best).select(*ask, *[F.col("_best")[c].alias(c) for c in picked])


def prioritised(rules: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The value of the first rule that yields one: rules are data, so no join order can change it."""
    numbered = [r.where(F.col(value).isNotNull()).select(*keys, F.lit(i).alias("rule_no"), value) for i, r in enumerate(rules)]
    best = F.min(F.struct("rule_no", value)).alias("_best")
    return reduce(DataFrame.unionByName, numbered).groupBy(*keys).agg(best).select(*keys, f"_best.{value}", "_best.rule_no")


def optional_match(selectors: DataFrame, rows: DataFrame, selector: str, row: str, mandatory: list[str], optional: list[str]) -> DataFrame:
    """Resolve selectors whose optional keys match anything when null.

    status: resolved (one row), ambiguous (more), unresolved (none); match is the one row's id.
    """
    theirs = rows.select(F.col(row).alias("_row"), *[F.col(c).alias(f"_{c}") for c in [*mandatory, *optional]])
    same = [F.col(c) == F.col(f"_{c}") for c in mandatory] + [F.col(c).isNull() | (F.col(c) == F.col(f"_{c}")) for c in optional]
    found = selectors.join(theirs, reduce(lambda a, b: a & b, same), "left").groupBy(selector).agg(F.count("_row").alias("n"), F.min("_row").alias("first"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return found.select(selector, "n", status.alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("match"))


def quarantine(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows of bad keys; Spark broadcasts the bad side if it is measured to be small."""
    return df.join(bad.select(*keys).distinct(), keys, "left_anti")


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with change: added, removed or common, in one pass over both."""
    both = before.select(*keys, F.lit(1).alias("_b")).unionByName(after.select(*keys, F.lit(2).alias("_b"))).groupBy(*keys).agg(F.bit_or("_b").alias("_b"))
    return both.select(*keys, F.when(F.col("_b") == 1, "removed").when(F.col("_b") == 2, "added").otherwise("common").alias("change"))


def coverage_violations(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not occur equally often on both sides."""
    both = expected.select(*keys, F.lit(1).alias("_n")).unionByName(actual.select(*keys, F.lit(-1).alias("_n"))).groupBy(*keys).agg(F.sum("_n").alias("surplus"))
    return both.where("surplus != 0")


def path_suffixes(path: Column) -> Column:
    """Every segment suffix of a normalised path, so that a suffix match becomes an equi-join."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
