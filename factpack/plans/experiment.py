"""Experiments: a run plan, its tasks and files in; one ledger row for each run out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import specs
from ..tables import cut
from . import compile as compiling
from . import evaluation, provenance, scoring, semantics

_SELECTED = "cast(array() as array<struct<unit_id:string,detail:string,token_count:int>>)"


def run(spark: SparkSession, plan: str, tasks: dict[str, tuple[str, str]], files: DataFrame, observations: dict[str, str] | None = None, embed=None, keep=cut) -> DataFrame:
    """plan: JSON of a run plan; tasks: task path -> (task JSON, repo_id); files (repo_id, path, content).

    Every selector of every task must resolve to one unit. Rows have the schema of ``sources.ledger``, with
    what each run chose and left out beside the metrics.
    """
    named = spark.createDataFrame([(path, specs.task_rows(text, repo)[0][0], repo) for path, (text, repo) in tasks.items()], "task_path string, task_id string, repo_id string")
    runs = keep(specs.runs(spark, plan).join(named, "task_path").withColumn("query_id", F.col("case_id")))
    program = semantics.analyse(files, keep)
    resolved = keep(evaluation.resolve_selectors(specs.selectors(spark, {repo: text for text, repo in tasks.values()}), program))
    if lost := evaluation.unresolved_report(resolved).limit(3).collect():
        raise ValueError("; ".join(f"{r.status} selector {r.ord} of {r.task_id}: {r.failure}" for r in lost))
    units = keep(scoring.units(program))
    observed = specs.observations(spark, observations) if observations else spark.createDataFrame([], specs.OBSERVATIONS)
    records = keep(provenance.checked(program, observed))
    traces = keep(provenance.trace_summaries(units, records))

    asked = runs.where("provider = 'compiled_pack'").select(F.concat_ws("|", "case_id", "budget").alias("query_id"), "query", "budget", "repo_id").distinct()
    done = compiling.results(compiling.pack_units(program, asked, embed, keep), asked)
    mine = runs.where("provider = 'compiled_pack'").withColumn("query_id", F.concat_ws("|", "case_id", "budget")).drop("query")
    texts = F.array().cast("array<string>")
    mine = mine.join(done.drop("budget"), ["query_id", "repo_id"]).select(
        "run_id", "task_id", "repo_id", "provider", "budget", "query", "total_tokens",
        F.transform("selections", lambda s: F.struct(s["unit_id"].alias("unit_id"), s["detail"].alias("detail"), s["token_count"].alias("token_count"))).alias("selected"),
        texts.alias("files"), F.col("omitted_unit_ids").alias("omitted"), F.transform("warnings", lambda w: w["unit_id"]).alias("warned"), "document",
    )
    others = evaluation.file_runs(program, files, runs)
    theirs = runs.join(others, "run_id").select("run_id", "task_id", "repo_id", "provider", "budget", "query", F.col("total_tokens").cast("long").alias("total_tokens"), F.expr(_SELECTED).alias("selected"), "files", texts.alias("omitted"), texts.alias("warned"), "document")
    results = keep(mine.unionByName(theirs))
    metrics = evaluation.run_metrics(resolved, results, program)

    chosen = results.select("run_id", "repo_id", F.explode("selected").alias("u")).select("run_id", "repo_id", F.col("u.unit_id").alias("unit_id")).join(traces, ["repo_id", "unit_id"])
    chosen = chosen.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col("unit_id"), F.col("primary_tier").alias("primary_capability_tier"), F.col("has_runtime").alias("has_attached_runtime_provenance")))).alias("units"))
    wanted = resolved.join(traces, ["repo_id", "unit_id"]).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.struct(F.col("tier").alias("expected_primary_capability_tier"), F.col("runtime").alias("expect_attached_runtime_provenance")).alias("original_selector"), F.col("primary_tier").alias("primary_capability_tier"), F.col("has_runtime").alias("has_attached_runtime_provenance")).alias("s")))), lambda x: x["s"]).alias("resolved_selectors"))
    seen = records.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("record_id", F.map_entries("normalized_payload").alias("e")))).alias("seen"))
    proofs = F.transform("seen", lambda r: F.struct(r["record_id"].alias("record_id"), F.map_from_entries(r["e"]).alias("normalized_payload")))
    rows = results.join(metrics.drop("task_id", "provider", "budget", "total_tokens"), "run_id").join(chosen, "run_id", "left").join(wanted, "task_id", "left").join(seen, "repo_id", "left")
    bare = F.transform("units", lambda u: F.struct(u["primary_capability_tier"].alias("primary_capability_tier"), u["has_attached_runtime_provenance"].alias("has_attached_runtime_provenance")))
    none = F.expr("cast(array() as array<struct<primary_capability_tier:string,has_attached_runtime_provenance:boolean>>)")
    return rows.select(
        "run_id", "task_id", F.col("provider").alias("provider_name"), "budget", "query", "total_tokens", F.col("files").alias("selected_files"),
        F.transform("selected", lambda s: s["unit_id"]).alias("selected_unit_ids"), F.col("omitted").alias("omitted_unit_ids"), "document",
        F.struct(F.coalesce(bare, none).alias("selected_units")).alias("provider_metadata"), "resolved_selectors", proofs.alias("runtime_provenance_records"),
        F.struct("budget_compliant", "aggregate_score", "edit_coverage", "support_coverage", "representation_adequacy", "uncertainty_honesty", "noise_efficiency", "credited_relevant_tokens", "noise_tokens").alias("metrics"),
    )
