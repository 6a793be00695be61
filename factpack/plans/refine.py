"""Refinement: ground reported misses to units, say what went wrong, and compile again with a boost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import path_suffixes
from ..tables import cut
from . import compile as compiling
from .semantics import Program

#: Floors (edit, support) for proven units, bare boundaries and those with evidence; and for expansions.
PROVEN_FLOOR, BARE_FLOOR, BACKED_FLOOR, EXPANSION = (0.95, 0.60), (0.12, 0.25), (0.25, 0.45), 0.65
FILE, FUNCTION, PYTHON = r"File\s+[\"']([^\"']+)[\"']", r",\s+in\s+([A-Za-z_][A-Za-z0-9_]*)", r"[A-Za-z0-9_./\\-]+\.py"
RANK = {"identity": 0, "summary": 1, "source": 2}
#: What a grounded unit can be, and the kinds of boundary.
STATUSES = ("omitted", "too_shallow", "sufficiently_represented")
BOUNDARIES = ("statically_proved", *[f"{t}_{s}" for t in ("heuristic_frontier", "unsupported_opaque") for s in ("missing_runtime_support", "with_attached_runtime_support")])
_KEYS = ["miss_id", "query_id", "repo_id"]


def _clean(path):
    return F.regexp_replace(F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), "/+", "/"), r"^(\./)+", "")


def _names(units: DataFrame) -> DataFrame:
    """Everything a unit can be called by: (repo_id, name, unit_id)."""
    simple = F.when(F.col("kind") == "proven_symbol", F.substring_index("primary_text", ".", -1))
    return units.select("repo_id", F.explode(F.array_distinct(F.filter(F.array("unit_id", "primary_text", simple), lambda x: x.isNotNull()))).alias("name"), "unit_id")


def _by_path(asked: DataFrame, units: DataFrame) -> DataFrame:
    """asked (keys, snippet): units of files that the snippet names, by equi-joins on path suffixes.

    A relative snippet is a suffix of the file's path; an absolute one has the file's path as suffix, or inside it.
    """
    wanted = asked.withColumn("snippet", _clean(F.col("snippet"))).where(F.col("snippet").endswith(".py"))
    files = units.select("repo_id", "path").distinct()
    short = files.select("repo_id", "path", F.explode(path_suffixes(F.col("path"))).alias("snippet"))
    long = wanted.select(*_KEYS, F.explode(path_suffixes(F.col("snippet"))).alias("path"), F.col("snippet").rlike("^(/|[A-Za-z]:/)").alias("absolute")).where("absolute").drop("absolute")
    hits = wanted.join(short, ["repo_id", "snippet"]).select(*_KEYS, "path").union(long.join(files, ["repo_id", "path"]).select(*_KEYS, "path")).distinct()
    return hits.join(units.select("repo_id", "path", "unit_id"), ["repo_id", "path"]).select(*_KEYS, "unit_id").distinct()


def ground(misses: DataFrame, units: DataFrame) -> DataFrame:
    """misses (miss_id, query_id, repo_id, kind, evidence) -> the units (keys, unit_id) they are about."""
    names = _names(units)
    by_name = lambda rows: rows.join(names, ["repo_id", "name"]).select(*_KEYS, "unit_id").distinct()
    absent = by_name(misses.where("kind = 'absent_symbol'").select(*_KEYS, F.trim("evidence").alias("name")))
    edits = _by_path(misses.where("kind = 'edit_to_omitted_path'").select(*_KEYS, F.col("evidence").alias("snippet")), units)
    traces = misses.where("kind = 'out_of_pack_trace'")
    quoted = F.regexp_extract_all("evidence", F.lit(FILE), F.lit(1))
    files = F.when(F.size(quoted) > 0, quoted).otherwise(F.regexp_extract_all("evidence", F.lit(PYTHON), F.lit(0)))
    functions = F.regexp_extract_all("evidence", F.lit(FUNCTION), F.lit(1))
    traces = traces.select(*_KEYS, files.alias("files"), functions.alias("functions"))
    at_file = _by_path(traces.select(*_KEYS, F.explode("files").alias("snippet")), units)
    at_name = by_name(traces.select(*_KEYS, F.explode("functions").alias("name")))
    both = traces.where("size(files) > 0 and size(functions) > 0").select(*_KEYS)
    one = at_file.union(at_name).join(both, _KEYS, "left_anti")
    return absent.union(edits).union(one).union(at_file.join(at_name, [*_KEYS, "unit_id"]).join(both, _KEYS, "left_semi")).distinct()


def _boundary(tier, has_runtime):
    support = F.when(has_runtime, "_with_attached_runtime_support").otherwise("_missing_runtime_support")
    return F.when(tier == "statically_proved", tier).otherwise(F.concat(tier, support))


def diagnose(misses: DataFrame, units: DataFrame, packed: DataFrame, traces: DataFrame) -> DataFrame:
    """(keys, unit_id, status, boundary, tier, has_runtime): omitted, too_shallow or sufficiently_represented."""
    held = packed.where("detail is not null").select("query_id", "repo_id", "unit_id", "detail")
    rows = ground(misses, units).join(held, ["query_id", "repo_id", "unit_id"], "left").join(traces, ["repo_id", "unit_id"], "left")
    proven = F.col("primary_tier") == "statically_proved"
    boundary = _boundary(F.col("primary_tier"), F.col("has_runtime"))
    required = F.when(proven, 2).when(F.col("has_runtime"), 1).otherwise(0)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("detail"))
    status = F.when(F.col("detail").isNull(), "omitted").when(rank < required, "too_shallow").otherwise("sufficiently_represented")
    return rows.select(*_KEYS, "unit_id", status.alias("status"), boundary.alias("boundary"), F.col("primary_tier").alias("tier"), "has_runtime")


def summary(found: DataFrame) -> DataFrame:
    """Counts of units by status and kind of boundary, for each miss."""
    return found.groupBy(*_KEYS, "status", "boundary").agg(F.count("*").alias("n"))


def dense_summary(misses: DataFrame, found: DataFrame) -> DataFrame:
    """``summary`` with a row for every miss, status and kind of boundary, 0 where there is no unit."""
    grid = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(b).alias("boundary")) for s in STATUSES for b in BOUNDARIES])
    cells = misses.select(*_KEYS).distinct().select(*_KEYS, F.inline(grid))
    return cells.join(summary(found), [*_KEYS, "status", "boundary"], "left").fillna(0, ["n"])


def violations(misses: DataFrame, units: DataFrame, found: DataFrame, traces: DataFrame) -> DataFrame:
    """(keys, unit_id, reason): what a diagnosis must not say.

    The statuses part the grounded units: each has exactly one, and no other unit has any. A boundary
    follows from its unit's tier and runtime support, and both are those of the unit's trace.
    """
    at = [*_KEYS, "unit_id"]
    grounded = ground(misses, units).withColumn("grounded", F.lit(True))
    said = found.groupBy(*at).agg(F.count("*").alias("n"), F.count_distinct("status").alias("statuses"))
    both = grounded.join(said, at, "full")
    parted = both.select(*at, F.when(F.col("n").isNull(), "not_classified").when(F.col("grounded").isNull(), "not_grounded").when(F.col("statuses") > 1, "statuses_overlap").when(F.col("n") > 1, "unit_repeats").alias("reason"))
    kept = traces.select("repo_id", "unit_id", F.col("primary_tier").alias("kept_tier"), F.col("has_runtime").alias("kept_runtime"))
    rows = found.join(kept, ["repo_id", "unit_id"], "left")
    odd = F.filter(F.array(
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown_status"),
        F.when(~F.col("boundary").eqNullSafe(_boundary(F.col("tier"), F.col("has_runtime"))), "boundary_differs"),
        F.when(F.col("kept_tier").isNotNull() & ~F.col("kept_tier").eqNullSafe(F.col("tier")), "tier_differs_from_trace"),
        F.when(F.col("kept_runtime").isNotNull() & ~F.col("kept_runtime").eqNullSafe(F.col("has_runtime")), "runtime_differs_from_trace"),
    ), lambda x: x.isNotNull())
    return parted.where("reason is not null").unionByName(rows.select(*at, F.explode(odd).alias("reason")))


#: What is said of n units by status and kind of boundary (not every pair can occur).
_STATIC, _HEURISTIC, _OPAQUE = "statically proved unit(s)", "heuristic frontier unit(s)", "unsupported/opaque unit(s)"
_BACKED, _BARE = "_with_attached_runtime_support", "_missing_runtime_support"
SENTENCES = {
    ("omitted", "statically_proved"): f"{_STATIC} were omitted due to budget pressure.",
    ("omitted", "heuristic_frontier" + _BARE): f"{_HEURISTIC} were omitted; they remain non-proof boundary work without attached runtime-backed support.",
    ("omitted", "heuristic_frontier" + _BACKED): f"{_HEURISTIC} with attached runtime-backed provenance were omitted.",
    ("omitted", "unsupported_opaque" + _BARE): f"{_OPAQUE} were omitted; they remain boundary work without attached runtime-backed support.",
    ("omitted", "unsupported_opaque" + _BACKED): f"{_OPAQUE} with attached runtime-backed provenance were omitted.",
    ("too_shallow", "statically_proved"): f"{_STATIC} were present but too shallow.",
    ("too_shallow", "heuristic_frontier" + _BACKED): f"{_HEURISTIC} carried attached runtime-backed provenance but were still too shallow.",
    ("too_shallow", "unsupported_opaque" + _BACKED): f"{_OPAQUE} carried attached runtime-backed provenance but were still too shallow.",
    ("sufficiently_represented", "statically_proved"): f"{_STATIC} were already sufficiently represented.",
    ("sufficiently_represented", "heuristic_frontier" + _BARE): f"{_HEURISTIC} were already surfaced as non-proof boundary work without attached runtime-backed support.",
    ("sufficiently_represented", "heuristic_frontier" + _BACKED): f"{_HEURISTIC} were already surfaced with attached runtime-backed provenance.",
    ("sufficiently_represented", "unsupported_opaque" + _BARE): f"{_OPAQUE} were already surfaced as boundary work without attached runtime-backed support.",
    ("sufficiently_represented", "unsupported_opaque" + _BACKED): f"{_OPAQUE} were already surfaced with attached runtime-backed provenance.",
}


def reasons(misses: DataFrame, found: DataFrame) -> DataFrame:
    """(keys, reason): one text for each miss, its sentences in the order of ``SENTENCES``."""
    spark = found.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, b, i, t) for i, ((s, b), t) in enumerate(SENTENCES.items())], "status string, boundary string, place int, said string"))
    counted = summary(found).join(table, ["status", "boundary"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("said")).alias("said")))), lambda x: x["said"])
    total = found.groupBy(*_KEYS).agg(F.count("*").alias("total"))
    told = counted.groupBy(*_KEYS).agg(parts.alias("parts"))
    rows = misses.select(*_KEYS).join(total, _KEYS, "left").join(told, _KEYS, "left")
    text = F.concat_ws(" ", F.concat(F.lit("Grounded "), F.col("total").cast("string"), F.lit(" semantic unit(s).")), "parts")
    return rows.select(*_KEYS, F.when(F.col("total").isNull(), "Could not ground the evidence to accepted semantic unit IDs.").otherwise(text).alias("reason"))


def boosts(found: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Floors for the units to act on, and support for what the proven ones among them depend on."""
    acting = found.where("status != 'sufficiently_represented'")
    pick = lambda i: F.when(F.col("tier") == "statically_proved", PROVEN_FLOOR[i]).when(F.col("has_runtime"), BACKED_FLOOR[i]).otherwise(BARE_FLOOR[i])
    floors = acting.select("query_id", "repo_id", "unit_id", pick(0).alias("edit_floor"), pick(1).alias("support_floor"), F.lit(0.0).alias("support_boost"))
    near = acting.where("tier = 'statically_proved'").join(dependencies.select("repo_id", F.col("src").alias("unit_id"), "dst"), ["repo_id", "unit_id"])
    more = near.select("query_id", "repo_id", F.col("dst").alias("unit_id")).distinct().join(acting.select("query_id", "repo_id", "unit_id"), ["query_id", "repo_id", "unit_id"], "left_anti")
    return floors.unionByName(more.select("*", F.lit(0.0).alias("edit_floor"), F.lit(0.0).alias("support_floor"), F.lit(EXPANSION).alias("support_boost")))


def recompile(program: Program, queries: DataFrame, misses: DataFrame, units: DataFrame, packed: DataFrame, traces: DataFrame, delta: int, embed=None, keep=cut) -> tuple[DataFrame, DataFrame]:
    """(packs at budget + delta with boosted scores, changes against the former packs)."""
    found = keep(diagnose(misses, units, packed, traces))
    wider = queries.withColumn("budget", F.col("budget") + delta)
    again = compiling.pack_units(program, wider, embed, keep, boosts(found, program.dependencies))
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col(c))
    old = packed.where("detail is not null").select("query_id", "repo_id", "unit_id", F.col("detail").alias("before"))
    new = again.where("detail is not null").select("query_id", "repo_id", "unit_id", F.col("detail").alias("after"))
    both = new.join(old, ["query_id", "repo_id", "unit_id"], "left")
    change = F.when(F.col("before").isNull(), "newly_selected").when(rank("after") > rank("before"), "upgraded")
    return again, both.select("query_id", "repo_id", "unit_id", change.alias("change")).where("change is not null")
