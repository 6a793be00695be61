"""Evaluation: oracle selectors, competing packs, metrics of a run, rollups of the ledger, and reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import file_packs, intervals, rollups
from ..operators.relational import optional_match
from ..sources import ledger as ledgers
from .scoring import asked_of
from .semantics import Program, absolute_module

#: How many files the baselines consider, and how many of them seed a neighbourhood.
TOP_FILES, SEEDS = 8, 2
DETAIL_RANK = {"identity": 1, "summary": 2, "source": 3}
TIER_ORDER = ("statically_proved", "heuristic_frontier", "unsupported_opaque", "runtime_backed")


def resolve_selectors(selectors: DataFrame, program: Program) -> DataFrame:
    """Selectors with status (resolved, ambiguous, unresolved), candidates, and the one unit and its span."""
    names = program.symbols.select("repo_id", F.col("symbol_id").alias("scope_id"), F.col("qualified_name").alias("enclosing")).dropDuplicates(["repo_id", "scope_id"])
    nothing = F.lit(None).cast("string")
    site = ["path", "sl", "sc", "el", "ec"]
    symbols = program.symbols.select("repo_id", F.lit("symbol").alias("kind"), F.col("symbol_id").alias("unit_id"), "qualified_name", F.col("kind").alias("symbol_kind"), nothing.alias("file_path"), nothing.alias("text"), nothing.alias("context"), nothing.alias("reason_code"), nothing.alias("enclosing"), nothing.alias("snippet"), *site)
    bound = lambda df, kind, id_, text, context: df.join(names, ["repo_id", "scope_id"], "left").select("repo_id", F.lit(kind).alias("kind"), F.col(id_).alias("unit_id"), nothing.alias("qualified_name"), nothing.alias("symbol_kind"), F.col("path").alias("file_path"), F.col(text).alias("text"), context.alias("context"), "reason_code", "enclosing", F.trim("snippet").alias("snippet"), *site)
    units = symbols.unionByName(bound(program.frontier, "frontier", "access_id", "access_text", F.col("context"))).unionByName(bound(program.unsupported, "unsupported", "construct_id", "construct_text", nothing))
    asked = selectors.withColumns({"selector": F.concat_ws("|", "task_id", F.lpad(F.col("ord").cast("string"), 9, "0")), "snippet": F.trim("snippet")})
    keys = ["qualified_name", "symbol_kind", "file_path", "text", "context", "reason_code", "enclosing", "snippet"]
    rows = units.withColumn("row", F.concat_ws("|", "unit_id", "el", "ec"))
    found = optional_match(asked.select("selector", "repo_id", "kind", *keys), rows.select("row", "repo_id", "kind", *keys), "selector", "row", ["repo_id", "kind"], keys)
    where = rows.select("repo_id", "kind", F.col("row").alias("match"), "unit_id", *site)
    return asked.drop("snippet").join(found.select("selector", F.col("n").alias("candidates"), "status", "match"), "selector").join(where, ["repo_id", "kind", "match"], "left").drop("match")


def unresolved_report(resolved: DataFrame) -> DataFrame:
    said = F.when(F.col("candidates") > 1, F.concat(F.lit("selector matched "), F.col("candidates"), F.lit(" candidates"))).otherwise(F.lit("selector matched no candidate"))
    return resolved.where("status != 'resolved'").select("task_id", "ord", "kind", "status", said.alias("failure"))


def scored_files(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, repo_id, path, text, tokens, score, rank) of every file, best first."""
    text = F.decode("content", "UTF-8")
    rows = asked_of(files.select("repo_id", "path", text.alias("text")), queries.select("query_id", "query").distinct())
    score = X.file_score(X.terms(F.col("query")), X.tokens(F.col("text")), X.tokens(F.col("path")))
    return rows.withColumns({"tokens": X.estimate_tokens(F.col("text")), "score": score})


def import_neighbours(program: Program) -> DataFrame:
    """(repo_id, path, ord, other, warning): the files that each file's imports name, in their order."""
    facts = program.facts
    modules = facts.where("fact = 'file'").groupBy("repo_id", F.col("module").alias("module")).agg(F.max("path").alias("other"))
    files = facts.where("fact = 'file'").select("repo_id", "path", F.col("module").alias("importer"))
    rows = facts.where("fact = 'import'").select("repo_id", "path", F.col("seq").alias("ord"), "kind", F.col("module").alias("said"), "imported", F.col("flag").alias("relative")).join(files, ["repo_id", "path"])
    base = absolute_module(F.col("said"), F.col("relative"), F.col("importer"), F.col("path").endswith("__init__.py"))
    rows = rows.withColumn("base", base)
    whole = F.when(F.col("kind") == "from_import", F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), "imported")).otherwise(F.col("base"))
    rows = rows.withColumn("whole", whole)
    one = rows.join(modules.select("repo_id", F.col("module").alias("whole"), F.col("other").alias("first")), ["repo_id", "whole"], "left")
    two = one.join(modules.select("repo_id", F.col("module").alias("base"), F.col("other").alias("second")), ["repo_id", "base"], "left")
    other = F.coalesce("first", F.when(F.col("kind") == "from_import", F.col("second")))
    warning = F.filter(F.array(F.when(F.col("base").isNull(), "unsupported_relative_import"), F.when(F.col("base").isNotNull() & (F.col("kind") == "star_import"), "star_import_not_expanded"), F.when(F.col("base").isNotNull() & other.isNull(), "import_not_resolved")), lambda x: x.isNotNull())
    broken = facts.where("fact = 'diagnostic'").select("repo_id", "path", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("other"), F.array(F.lit("import_parse_error")).alias("warnings"))
    return two.select("repo_id", "path", "ord", other.alias("other"), warning.alias("warnings")).unionByName(broken)


def file_candidates(program: Program, files: DataFrame, queries: DataFrame) -> DataFrame:
    """(provider, query_id, repo_id, rank, path, text): the ordered candidates of the three file baselines."""
    scored = scored_files(files, queries)
    keys = ["query_id", "query", "repo_id"]
    order = [F.col("score").desc(), F.col("tokens"), F.col("path")]
    best = scored.where("score > 0")
    ranked = file_packs.numbered(best, keys, order)
    top = ranked.where(F.col("rank") < TOP_FILES).select(F.lit("lexical_top_k_files").alias("provider"), *keys, F.struct("rank").alias("at"), "path", "text")
    floor = scored.select(F.lit("file_order_floor").alias("provider"), *keys, F.struct(F.lit(0).alias("rank")).alias("at"), "path", "text")
    floor = file_packs.numbered(floor.drop("at"), ["provider", *keys], [F.col("path")]).select("provider", *keys, F.struct("rank").alias("at"), "path", "text")
    seeds = ranked.where(F.col("rank") < SEEDS).select(*keys, "rank", "path")
    linked = seeds.join(import_neighbours(program), ["repo_id", "path"]).select(*keys, (F.col("rank") + SEEDS).alias("rank"), "ord", F.col("other").alias("path")).where("path is not null")
    near = seeds.select(*keys, "rank", F.lit(0).alias("ord"), "path").unionByName(linked).groupBy(*keys, "path").agg(F.min(F.struct("rank", "ord")).alias("first"))
    texts = files.select("repo_id", "path", F.decode("content", "UTF-8").alias("text"))
    near = file_packs.numbered(near.join(texts, ["repo_id", "path"]), keys, [F.col("first")]).select(F.lit("import_neighborhood_files").alias("provider"), *keys, F.struct("rank").alias("at"), "path", "text")
    return top.unionByName(floor).unionByName(near).select("provider", *keys, F.col("at.rank").alias("rank"), "path", "text")


def file_warnings(program: Program, files: DataFrame, queries: DataFrame) -> DataFrame:
    """(provider, query_id, repo_id, warnings): codes in the order of their first sight."""
    scored = scored_files(files, queries)
    keys = ["query_id", "repo_id"]
    none = scored.groupBy(*keys).agg(F.max("score").alias("best")).where("best <= 0")
    lexical = none.select(F.lit("lexical_top_k_files").alias("provider"), *keys, F.array(F.lit("no_positive_lexical_score")).alias("warnings"))
    seedless = none.select(F.lit("import_neighborhood_files").alias("provider"), *keys, F.array(F.lit("no_positive_seed")).alias("warnings"))
    seeds = file_packs.numbered(scored.where("score > 0"), keys, [F.col("score").desc(), F.col("tokens"), F.col("path")]).where(F.col("rank") < SEEDS)
    said = seeds.join(import_neighbours(program), ["repo_id", "path"]).select(*keys, F.posexplode("warnings").alias("i", "code"), "rank", "ord")
    first = said.groupBy(*keys, "code").agg(F.min(F.struct("rank", "ord", "i")).alias("at")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("warnings"))
    return lexical.unionByName(seedless).unionByName(first.select(F.lit("import_neighborhood_files").alias("provider"), *keys, "warnings"))


def file_runs(program: Program, files: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (run_id, task_id, query_id, query, repo_id, provider, budget) of file providers -> packed documents."""
    wanted = runs.where("provider != 'compiled_pack'")
    candidates = file_candidates(program, files, wanted)
    rows = wanted.join(candidates.drop("query"), ["provider", "query_id", "repo_id"], "left").join(file_warnings(program, files, wanted), ["provider", "query_id", "repo_id"], "left")
    return file_packs.pack_files(rows)


def run_metrics(resolved: DataFrame, results: DataFrame, program: Program) -> DataFrame:
    """Metrics of runs: results (run_id, task_id, repo_id, provider, budget, total_tokens, selected, files, omitted, warned).

    ``selected`` is an array of (unit_id, detail, token_count); tokens of source spans count once where they overlap.
    """
    units = results.select("run_id", F.explode("selected").alias("u")).select("run_id", F.col("u.unit_id").alias("unit_id"), F.col("u.detail").alias("detail"), F.col("u.token_count").alias("unit_tokens"))
    keys = ["run_id", "provider", "total_tokens", "files", "omitted", "warned"]
    rows = results.select(*keys, "task_id", "repo_id", "budget").join(resolved.where("status = 'resolved'"), ["task_id", "repo_id"]).join(units, ["run_id", "unit_id"], "left")
    by_unit = F.col("provider") == "compiled_pack"
    rank = F.create_map(*[F.lit(x) for kv in DETAIL_RANK.items() for x in kv])
    shown = F.when(by_unit, F.col("detail").isNotNull()).otherwise(F.array_contains("files", F.col("path")))
    enough = F.when(by_unit, F.coalesce(rank[F.col("detail")] >= rank[F.col("min_detail")], F.lit(False))).otherwise(shown)
    category = F.coalesce("role", F.lit("uncertainty"))
    noticed = F.when(F.array_contains("omitted", F.col("unit_id")), 0.25).otherwise(0.0) + F.when(F.array_contains("warned", F.col("unit_id")), 0.25).otherwise(0.0)
    honest = F.when(~by_unit, F.when(shown, 0.0).otherwise(noticed)).when(shown, F.when(enough, 1.0).otherwise(0.5)).otherwise(noticed)
    rows = rows.withColumns({"shown": shown, "enough": enough, "category": category, "honest": honest})
    relevant = F.when(F.col("category") == "uncertainty", F.col("honest") == 1.0).otherwise(F.col("enough"))
    credit = rows.where(relevant)
    whole = credit.where(by_unit & (F.col("detail") != "source")).groupBy("run_id").agg(F.sum("unit_tokens").alias("unit_credit"))
    offsets = program.facts.where("fact = 'definition' and kind = 'module'").select("repo_id", "path", F.split(F.coalesce("snippet", F.lit("")), "(?<=\n)").alias("lines"))
    spans = credit.where(~by_unit | (F.col("detail") == "source")).join(offsets, ["repo_id", "path"])
    before = lambda line: F.aggregate(F.slice(F.col("lines"), F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0), lambda s, x: s + F.length(x))
    placed = spans.select("run_id", "path", (before(F.col("sl")) + F.col("sc")).alias("s"), (before(F.col("el")) + F.col("ec")).alias("t"))
    merged = intervals.credited(intervals.islands(placed, ["run_id", "path"], "s", "t"), ["run_id"]).select("run_id", F.col("tokens").alias("span_credit"))
    is_ = lambda c, x: F.sum(F.when((F.col("category") == c) & x, 1).otherwise(0))
    yes = F.lit(True)
    sums = rows.groupBy("run_id").agg(is_("edit", yes).alias("edits"), is_("edit", F.col("enough")).alias("edits_ok"), is_("support", yes).alias("supports"), is_("support", F.col("enough")).alias("supports_ok"), is_("uncertainty", yes).alias("opens"), F.sum(F.when(F.col("category") == "uncertainty", F.col("honest"))).alias("honesty"), F.sum(F.when((F.col("category") != "uncertainty") & F.col("shown"), 1).otherwise(0)).alias("represented"))
    out = results.select("run_id", "task_id", "provider", "budget", "total_tokens").join(sums, "run_id").join(whole, "run_id", "left").join(merged, "run_id", "left")
    relevant_tokens = F.coalesce("unit_credit", F.lit(0)) + F.coalesce("span_credit", F.lit(0))
    out = out.withColumns({
        "budget_compliant": F.col("total_tokens") <= F.col("budget"),
        "edit_coverage": F.when(F.col("edits") > 0, F.col("edits_ok") / F.col("edits")).otherwise(F.raise_error(F.lit("a task needs an edit selector"))),
        "support_coverage": F.when(F.col("supports") > 0, F.col("supports_ok") / F.col("supports")),
        "representation_adequacy": F.when(F.col("represented") > 0, (F.col("edits_ok") + F.col("supports_ok")) / F.col("represented")).otherwise(0.0),
        "uncertainty_honesty": F.when(F.col("opens") > 0, F.col("honesty") / F.col("opens")),
        "credited_relevant_tokens": relevant_tokens.cast("long"),
        "noise_tokens": F.greatest(F.lit(0), F.col("total_tokens") - relevant_tokens).cast("long"),
        "noise_efficiency": relevant_tokens / F.col("total_tokens"),
    })
    return out.withColumn("aggregate_score", rollups.weighted()).drop("edits", "edits_ok", "supports", "supports_ok", "opens", "honesty", "represented", "unit_credit", "span_credit")


def summarise(ledger: DataFrame) -> dict[str, DataFrame]:
    """The rollups of a typed ledger (``sources.ledger``)."""
    chosen = ledger.select("provider_name", F.explode_outer("selected_units").alias("u")).select("provider_name", F.col("u.primary_capability_tier").alias("tier"), F.col("u.has_attached_runtime_provenance").alias("runtime"), F.col("u").isNotNull().alias("is_unit"))
    wanted = ledger.select(F.explode("resolved_selectors").alias("s")).select(F.col("s.original_selector.expected_primary_capability_tier").alias("tier"), F.col("s.original_selector.expect_attached_runtime_provenance").alias("runtime"), F.col("s.primary_capability_tier").alias("got_tier"), F.coalesce("s.has_attached_runtime_provenance", F.lit(False)).alias("got_runtime"))
    units = F.sum(F.col("is_unit").cast("int")).cast("long").alias("n_units")
    backed = F.sum(F.coalesce(F.col("runtime"), F.lit(False)).cast("int")).cast("long").alias("n_runtime")
    tiered = chosen.where("tier is not null and tier != 'runtime_backed'")
    best = rollups.winners(ledger.select("task_id", "budget", "provider_name", "aggregate_score"), ["task_id", "budget"], "aggregate_score")
    return {
        "providers": rollups.provider_rollup(ledger, "provider_name", "budget_compliant", list(ledgers.SCORES)),
        "winners": best.groupBy("task_id", "budget").agg(F.array_sort(F.collect_set("provider_name")).alias("winners"), F.max("aggregate_score").alias("score")),
        "tier_expectations": wanted.where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.count(F.when(F.col("tier") == F.col("got_tier"), 1)).alias("n_satisfied")),
        "runtime_expectations": wanted.where("runtime is not null").groupBy("runtime").agg(F.count("*").alias("n"), F.count(F.when(F.col("runtime") == F.col("got_runtime"), 1)).alias("n_satisfied")),
        "units_by_tier": tiered.groupBy("tier").agg(units, backed),
        "units_by_provider": chosen.groupBy("provider_name").agg(units, backed),
        "units_by_provider_tier": tiered.groupBy("provider_name", "tier").agg(units, backed),
        "outcomes": rollups.map_outcomes(ledger.select(F.explode("runtime_provenance_records").alias("r")), F.col("r.normalized_payload")),
        "overview": ledger.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("task_id")).alias("tasks"), F.array_sort(F.collect_set("provider_name")).alias("providers"), F.array_sort(F.collect_set("budget")).alias("budgets"), F.array_sort(F.collect_set(F.when(~F.col("budget_compliant"), F.col("run_id")))).alias("violations")),
    }


def _cell(value) -> str:
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value:.3f}"
    return ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def render(summary: dict[str, DataFrame]) -> str:
    """The rollups as a Markdown report; a rollup has a row for each provider, task or tier, not for each run."""
    lines = ["# Eval Summary"]
    for name, df in summary.items():
        rows = sorted((tuple(r) for r in df.collect()), key=lambda r: (TIER_ORDER.index(r[0]) if r[0] in TIER_ORDER else 9, repr(r)))
        lines += ["", f"## {name.replace('_', ' ').title()}", ""]
        lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(map(_cell, r)) + " |" for r in rows] if rows else ["None."]
    return "\n".join(lines) + "\n"


def manifest(plan_id: str, runs: DataFrame, **paths: str) -> DataFrame:
    """A run plan's counts and ids (of the column run_id) as one row of JSON, made where the rows are."""
    named = F.map_from_arrays(F.array(*[F.lit(k) for k in paths]), F.array(*[F.lit(v) for v in paths.values()]))
    ids = runs.agg(F.array_sort(F.collect_list("run_id")).alias("run_ids"))
    return ids.select(F.to_json(F.struct(F.lit(plan_id).alias("plan_id"), F.size("run_ids").alias("record_count"), "run_ids", named.alias("paths"))).alias("value"))
