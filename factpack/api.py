"""The public surface: analyse repositories, compile contexts, run experiments, answer a tool call."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import compile as compiling
from .plans import evaluation, provenance, semantics
from .sources import repo, specs
from .tables import cut

__all__ = ["PROVIDERS", "analyse_repository", "compile_repository_context", "mirror_violations", "tool_response", "write_bundle"]


def analyse_repository(spark: SparkSession, root: str, repo_id: str = "repo", keep=cut, path: str | None = None, **observations: list[dict]) -> semantics.Program:
    """All tables of the Python files under root, or of the one file ``path`` in it.

    ``observations`` are lists of runtime observations by family, named as in an observation file
    (``getattr_runtime_observations=[...]``); they become the program's ``provenance``. One of an unknown
    family, without its site, or that may not be attached raises ValueError.
    """
    files = repo.scan(spark, root, repo_id) if path is None else repo.scan_file(spark, root, path, repo_id)
    program = semantics.analyse(files, keep)
    if not observations:
        return program
    observed = specs.observations(spark, {repo_id: json.dumps({"schema_version": "v1", **observations})})
    return dataclasses.replace(program, provenance=keep(provenance.checked(program, observed)))


def compile_repository_context(spark: SparkSession, root: str, query: str, budget: int, embed=None, repo_id: str = "repo") -> DataFrame:
    """One row: the document that fits the budget, with selections, omissions, warnings and confidence."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    queries = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"), F.lit(budget).alias("budget"))
    return compiling.compile_context(repo.scan(spark, root, repo_id), queries, embed)


def _asked(arguments: str) -> dict:
    """The arguments of a call, or ValueError(code, message)."""
    try:
        asked = json.loads(arguments)
    except ValueError as error:
        raise ValueError("invalid_arguments", str(error)) from error
    if not isinstance(asked, dict) or set(asked) - {"repo_root", "query", "budget", "include_document"}:
        raise ValueError("invalid_arguments", "a call has repo_root, query, budget and include_document alone")
    if type(asked.get("repo_root")) is not str or not asked["repo_root"]:
        raise ValueError("invalid_repo_root", "repo_root must be a non-empty string")
    if type(asked.get("query")) is not str:
        raise ValueError("invalid_query", "query must be a string")
    if type(asked.get("budget")) is not int or asked["budget"] <= 0:
        raise ValueError("invalid_budget", "budget must be a positive integer")
    if type(asked.setdefault("include_document", True)) is not bool:
        raise ValueError("invalid_include_document", "include_document must be a boolean")
    return asked


def _sections(program: semantics.Program) -> dict[str, DataFrame]:
    """What an answer lists of a program, each as rows (path, sl, sc, id, row) of its typed fields."""
    span = [F.col(a).alias(b) for a, b in (("sl", "start_line"), ("sc", "start_column"), ("el", "end_line"), ("ec", "end_column"))]
    site = F.struct(F.col("path").alias("file_path"), F.struct(*span).alias("span")).alias("site")
    scope = F.col("scope_id").alias("enclosing_scope_id")
    shape = lambda rows, key, *columns: rows.select("path", "sl", "sc", F.col(key).alias("id"), F.struct(*columns).alias("row"))
    broken = program.facts.where("fact = 'diagnostic'")
    return {
        "unresolved_frontier": shape(program.frontier, "access_id", "access_id", site, "access_text", "context", scope, "reason_code"),
        "unsupported_constructs": shape(program.unsupported, "construct_id", "construct_id", site, "construct_text", scope, "reason_code"),
        "syntax_diagnostics": shape(broken, "id", F.col("id").alias("diagnostic_id"), site, F.col("kind").alias("code"), F.col("text").alias("message")),
    }


def tool_response(spark: SparkSession, arguments: str, embed=None, keep=cut) -> str:
    """A tool call (JSON: repo_root, query, budget, include_document) answered as JSON.

    The answer holds the document (null if not wanted), what it selects and omits, and the open frontier,
    unsupported constructs and syntax errors of the repository, in the order of files and lines. Wrong
    arguments give an error object with a code, and so does a repository that cannot be compiled.
    """
    try:
        asked = _asked(arguments)
    except ValueError as error:
        code, message = error.args
        return json.dumps({"ok": False, "error": message, "error_code": code})
    try:
        program = analyse_repository(spark, asked["repo_root"], keep=keep)
        queries = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(asked["query"]).alias("query"), F.lit(asked["budget"]).alias("budget"))
        row = compiling.results(compiling.pack_units(program, queries, embed, keep), queries).first()
        if row is None:
            raise ValueError("the repository has no unit to compile")
        said = row.asDict(recursive=True)
        answer = {"ok": True, "document": said["document"] if asked["include_document"] else None, **{k: said[k] for k in ("total_tokens", "budget", "confidence")}}
        answer |= {"selected_units": said["selections"], "omitted_unit_ids": said["omitted_unit_ids"]}
        for name, rows in _sections(program).items():
            answer[name] = [r["row"].asDict(recursive=True) for r in rows.orderBy("path", "sl", "sc", "id").collect()]
        answer["optimization_warnings"] = said["warnings"]
    except Exception as error:  # the caller of a tool gets every failure as an answer
        return json.dumps({"ok": False, "error": str(error), "error_code": "compile_failed"})
    return json.dumps(answer, ensure_ascii=False)


def mirror_violations(spark: SparkSession, answer: str, program: semantics.Program) -> DataFrame:
    """(section, id): what an answer of ``tool_response`` leaves out of the program's lists, adds or repeats."""
    said = json.loads(answer)
    keys = {"unresolved_frontier": "access_id", "unsupported_constructs": "construct_id", "syntax_diagnostics": "diagnostic_id"}
    told = spark.createDataFrame([(name, x[key]) for name, key in keys.items() for x in said[name]], "section string, id string")
    parts = [rows.select(F.lit(name).alias("section"), "id") for name, rows in _sections(program).items()]
    held = parts[0].union(parts[1]).union(parts[2])
    return told.exceptAll(held).union(held.exceptAll(told))


#: Provider name -> what makes its packs: the compiled context, or one of the file baselines.
PROVIDERS = {
    "compiled_pack": compiling.pack_units,
    "lexical_top_k_files": evaluation.file_runs,
    "import_neighborhood_files": evaluation.file_runs,
    "file_order_floor": evaluation.file_runs,
}


def write_bundle(ledger: DataFrame, folder: str, plan_id: str) -> dict[str, str]:
    """Ledger, report and manifest of an experiment in one folder; the report's rollups are small."""
    from .sources import ledger as ledgers

    paths = {"ledger": os.path.join(folder, "ledger"), "report": os.path.join(folder, "report"), "manifest": os.path.join(folder, "manifest")}
    ledgers.append(ledger, paths["ledger"])
    spark = ledger.sparkSession
    text = evaluation.render(evaluation.summarise(ledgers.read(spark, paths["ledger"])))
    said = evaluation.manifest(plan_id, ledger, **paths)
    for name, row in (("report", spark.range(1).select(F.lit(text).alias("value"))), ("manifest", said)):
        row.coalesce(1).write.mode("overwrite").text(paths[name])
    return paths
