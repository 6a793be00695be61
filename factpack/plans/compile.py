"""Compile contexts: source files and queries in, one packed document for each query and repository out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import focus_pack
from ..tables import cut
from . import scoring, semantics
from .semantics import Program


def pack_units(program: Program, queries: DataFrame, embed=None, keep=cut, boosts: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query, budget[, repo_id]) -> a row for each unit, chosen or omitted, in rank order."""
    table = keep(scoring.units(program))
    scores = scoring.score(program, table, queries.drop("budget"), embed)
    if boosts is not None:
        scores = boosted(scores, boosts)
    return keep(focus_pack.pack_table(table, scores, program.dependencies, queries.select("query_id", "budget").distinct()))


def results(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each compiled document, with its selections, omissions and warnings in order."""
    ordered = lambda when, *c: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("rank", F.struct(*c).alias("row"))))), lambda x: x["row"])
    chosen = F.col("detail").isNotNull()
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("detail").isNull(), 1).otherwise(0).alias("late"), "rank", "unit_id", "warnings"))), lambda x: F.transform(x["warnings"], lambda w: F.struct(w["code"].alias("code"), x["unit_id"].alias("unit_id"), w["message"].alias("message")))))
    out = packed.groupBy("query_id", "repo_id", "budget").agg(
        F.max("document").alias("document"),
        ordered(chosen, "unit_id", "detail", "token_count", "basis", "reason").alias("selections"),
        F.transform(ordered(~chosen, "unit_id"), lambda x: x["unit_id"]).alias("omitted_unit_ids"),
        notes.alias("warnings"),
        F.max("total_tokens").alias("unit_tokens"),
        F.max("confidence").alias("confidence"),
    )
    asked = queries.select("query_id", "query").distinct()
    tokens = F.greatest(F.lit(1), F.floor((F.length("document") + 3) / 4)).cast("long").alias("total_tokens")
    return out.join(asked, "query_id").select("query_id", "query", "repo_id", "budget", "document", tokens, "unit_tokens", "confidence", "selections", "omitted_unit_ids", "warnings")


def compile_context(files: DataFrame, queries: DataFrame, embed=None, keep=cut) -> DataFrame:
    """files (repo_id, path, content) and queries (query_id, query, budget) -> compiled documents."""
    program = semantics.analyse(files, keep)
    return results(pack_units(program, queries, embed, keep), queries)


def violations(compiled: DataFrame) -> DataFrame:
    """Documents that break a promise: over budget, a unit chosen twice, or chosen and omitted."""
    ids = F.transform("selections", lambda s: s["unit_id"])
    broken = F.filter(F.array(
        F.when(F.col("total_tokens") > F.col("budget"), "over_budget"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_unit"),
        F.when(F.size(F.array_intersect(ids, F.col("omitted_unit_ids"))) > 0, "chosen_and_omitted"),
        F.when(F.aggregate(F.transform("selections", lambda s: s["token_count"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b) != F.col("unit_tokens"), "total_differs"),
    ), lambda x: x.isNotNull())
    return compiled.select("query_id", "repo_id", "budget", F.explode(broken).alias("violation"))


def boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """scores raised to floors (query_id, repo_id, unit_id, edit_floor, support_floor, support_boost)."""
    keys = ["query_id", "repo_id", "unit_id"]
    most = boosts.groupBy(*keys).agg(F.max("edit_floor").alias("e"), F.max("support_floor").alias("s"), F.max("support_boost").alias("b"))
    rows = scores.join(most, keys, "left")
    merged = 1 - (1 - F.col("p_support")) * (1 - F.coalesce("b", F.lit(0.0)))
    return rows.select(*keys, F.greatest("p_edit", F.coalesce("e", F.lit(0.0))).alias("p_edit"), F.greatest(merged, F.coalesce("s", F.lit(0.0))).alias("p_support"))
