"""Relations as graphs: closures, propagation, noisy-or support, orchestration and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, drop

#: How much of a source's edit score supports its target, its scope's, and orchestration.
DEPENDENCY, SCOPE, ORCHESTRATION = 0.50, 0.40, 0.12
MIN_SOURCE, MIN_TARGET, MIN_TARGETS = 0.05, 0.15, 2


def closure(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> (src, dst, depth): each reachable pair once, at its least depth.

    Semi-naive doubling: with all pairs of up to n hops known, a pair of up to 2n hops is one of n hops and
    a known one behind it, so only the pairs of exactly n hops are joined. Pairs, not paths, are kept, each
    round's in a table: cycles and diamonds add nothing, and the rounds are the logarithm of the longest
    of the shortest ways. Edges with a null lead nowhere.
    """
    reached = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct().withColumn("depth", F.lit(1)))
    hops = 1
    while True:
        behind = reached.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("depth").alias("more"))
        met = reached.where(F.col("depth") == hops).join(behind, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        new = cut(met.join(reached, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            drop(new)
            return reached
        reached, hops = reached.unionByName(new), 2 * hops


def propagate(nodes: DataFrame, edges: DataFrame, share: float, rounds: int = 2) -> DataFrame:
    """nodes (id, score), edges (src, dst): each round adds share * score(src) to every dst at once."""
    now = nodes.select("id", "score")
    for _ in range(rounds):
        pushed = edges.join(now, edges["src"] == now["id"]).groupBy("dst").agg((share * F.sum("score")).alias("push"))
        now = now.join(pushed, now["id"] == pushed["dst"], "left").select("id", (F.col("score") + F.coalesce("push", F.lit(0.0))).alias("score"))
    return now


def _misses(value) -> F.Column:
    """The product of 1 - value as an aggregate: exact zeros are counted, as logs cannot hold them."""
    left = F.lit(1.0) - value
    return F.when(F.max(F.when(left <= 0, 1).otherwise(0)) == 1, 0.0).otherwise(F.product(left))


def noisy_or(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """1 - product of (1 - value) over each key's rows; partial products before the shuffle."""
    return df.groupBy(*keys).agg((1 - _misses(F.col(value))).alias(name))


def support(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """scores (unit_id, p_edit, p_support) raised by boosts (unit_id, boost), one row per proof."""
    missed = boosts.where("boost > 0").groupBy("unit_id").agg(_misses(F.col("boost")).alias("miss"))
    raised = 1 - (1 - F.col("p_support")) * F.coalesce("miss", F.lit(1.0))
    keys = [c for c in scores.columns if c not in ("p_support",)]
    return scores.join(missed, "unit_id", "left").select(*keys, raised.alias("p_support"))


def orchestrated(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """p_edit raised for sources of two or more distinct relevant targets, by their mean relevance."""
    source = scores.select(F.col("unit_id").alias("src"), F.col("p_edit").alias("_e")).where(F.col("_e") >= MIN_SOURCE)
    target = scores.select(F.col("unit_id").alias("dst"), F.greatest("p_edit", "p_support").alias("r")).where(F.col("r") >= MIN_TARGET)
    gained = edges.select("src", "dst").distinct().join(source, "src").join(target, "dst").groupBy("src").agg(F.avg("r").alias("mean"), F.count("*").alias("n"))
    gained = gained.where(F.col("n") >= MIN_TARGETS).select(F.col("src").alias("unit_id"), "mean")
    p_edit = F.least(F.lit(1.0), F.col("p_edit") + ORCHESTRATION * F.coalesce("mean", F.lit(0.0)))
    rest = [c for c in scores.columns if c not in ("unit_id", "p_edit", "p_support")]
    return scores.join(gained, "unit_id", "left").select("unit_id", *rest, p_edit.alias("p_edit"), "p_support")


def adjacency(edges: DataFrame, by: str, other: str, name: str) -> DataFrame:
    """The sorted distinct neighbours of each vertex."""
    return edges.groupBy(by).agg(F.array_sort(F.collect_set(other)).alias(name))
