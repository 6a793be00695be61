"""Strict readers of JSON specifications: oracle tasks, run plans and runtime observations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: The fields that a selector of each kind may have, and those that it must have.
_COMMON = ("kind", "min_detail", "rationale", "expected_primary_capability_tier", "expect_attached_runtime_provenance")
FIELDS = {
    "symbol": ("qualified_name", "role", "symbol_kind"),
    "frontier": ("file_path", "access_text", "context", "reason_code", "enclosing_qualified_name", "source_snippet"),
    "unsupported": ("file_path", "construct_text", "reason_code", "enclosing_qualified_name", "source_snippet"),
}
REQUIRED = {
    "symbol": ("qualified_name", "role", "min_detail"),
    "frontier": ("file_path", "access_text", "context", "reason_code", "min_detail"),
    "unsupported": ("file_path", "construct_text", "reason_code", "min_detail"),
}
DETAILS, ROLES = ("identity", "summary", "source"), ("edit", "support")
PROVIDERS = ("compiled_pack", "lexical_top_k_files", "import_neighborhood_files", "file_order_floor")
GENERATED = ("access_id", "construct_id", "resolved_unit_id", "semantic_unit_id", "symbol_id", "unit_id")
SELECTORS = (
    "task_id string, repo_id string, ord int, kind string, min_detail string, role string, qualified_name string, symbol_kind string, "
    "file_path string, text string, context string, reason_code string, enclosing string, snippet string, tier string, runtime boolean"
)


def _generated(value) -> str | None:
    """The first generated id that a specification names anywhere."""
    if isinstance(value, dict):
        named = next((k for k in value if k.removesuffix("s") in GENERATED), None)
        return named or next((x for v in value.values() if (x := _generated(v))), None)
    return next((x for v in value if (x := _generated(v))), None) if isinstance(value, list) else None


def task_rows(text: str, repo_id: str) -> list[tuple]:
    """The selectors of one oracle task; anything unknown, missing or generated is an error."""
    task = json.loads(text)
    if not isinstance(task, dict) or set(task) != {"task_id", "fixture_id", "expected_selectors"}:
        raise ValueError("a task has task_id, fixture_id and expected_selectors alone")
    if (name := _generated(task)) is not None:
        raise ValueError(f"a task must not name generated ids: {name}")
    if not task["expected_selectors"] or not task["task_id"]:
        raise ValueError("a task needs an id and a selector")
    rows = []
    for i, s in enumerate(task["expected_selectors"]):
        kind = s.get("kind")
        if kind not in FIELDS or set(s) - set(FIELDS[kind]) - set(_COMMON) or any(not s.get(k) for k in REQUIRED[kind]):
            raise ValueError(f"selector {i}: a wrong kind, or fields that are unknown or missing")
        if s["min_detail"] not in DETAILS or kind == "symbol" and s["role"] not in ROLES:
            raise ValueError(f"selector {i}: a wrong detail or role")
        rows.append((task["task_id"], repo_id, i, kind, s["min_detail"], s.get("role"), s.get("qualified_name"), s.get("symbol_kind"), s.get("file_path"), s.get("access_text") or s.get("construct_text"), s.get("context"), s.get("reason_code"), s.get("enclosing_qualified_name"), s.get("source_snippet"), s.get("expected_primary_capability_tier"), s.get("expect_attached_runtime_provenance")))
    return rows


def selectors(spark: SparkSession, tasks: dict[str, str]) -> DataFrame:
    """repo_id -> task JSON, as a table of selectors."""
    return spark.createDataFrame([r for repo, text in tasks.items() for r in task_rows(text, repo)], SELECTORS)


def run_rows(text: str) -> list[tuple]:
    """(run_id, case_id, task_path, query, budget, provider) of a run plan: cases x providers x budgets."""
    plan = json.loads(text)
    if set(plan) != {"plan_id", "cases"} or not plan["plan_id"] or not plan["cases"]:
        raise ValueError("a plan has plan_id and cases alone")
    seen, rows = set(), []
    for case in plan["cases"]:
        if set(case) != {"case_id", "task_path", "query", "budgets", "providers"} or case["case_id"] in seen:
            raise ValueError("a case has its five fields alone, and an id of its own")
        seen.add(case["case_id"])
        path = case["task_path"]
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError("a task path stays inside the root")
        if not case["budgets"] or any(type(b) is not int or b <= 0 for b in case["budgets"]) or not case["providers"] or not set(case["providers"]) <= set(PROVIDERS):
            raise ValueError("budgets are positive integers, providers are known ones")
        rows += [(f"{plan['plan_id']}:{case['case_id']}:{p}:{b}", case["case_id"], path, case["query"], b, p) for p in case["providers"] for b in sorted(case["budgets"])]
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("run ids repeat")
    return rows


def runs(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(run_rows(text), "run_id string, case_id string, task_path string, query string, budget int, provider string")


#: Families of runtime observations: one list each in an observation file.
FAMILIES = ("dynamic_import", "hasattr", "getattr", "vars", "dir", "globals", "locals", "setattr", "delattr", "eval", "exec", "metaclass_behavior")
OBSERVATIONS = (
    "repo_id string, family string, file_path string, sl int, sc int, el int, ec int, snippet string, probe_identifier string, probe_contract_revision string, "
    "snapshot struct<snapshot_kind:string,snapshot_id:string,is_dirty_worktree:boolean>, links array<struct<attachment_id:string,attachment_role:string,description:string>>, "
    "replay_target string, replay_selector string, replay_inputs map<string,string>, runtime_assumptions map<string,string>, normalized_payload map<string,string>, durable string"
)
_OBSERVED = {
    "file_path", "start_line", "start_column", "end_line", "end_column", "source_snippet", "probe_identifier", "probe_contract_revision", "repository_snapshot_basis",
    "attachment_links", "replay_target", "replay_selector", "replay_inputs", "runtime_assumptions", "normalized_payload", "durable_payload_reference",
}


def _pairs(rows: list[dict] | None) -> dict[str, str]:
    out: dict[str, str] = {}
    for r in rows or []:
        if (key := r["key"].strip()) in out:
            raise ValueError(f"key repeats: {key}")
        out[key] = r["value"].strip()
    return out


def observation_rows(text: str, repo_id: str) -> list[tuple]:
    """All families of one observation file, as rows of one table."""
    said = json.loads(text)
    lists = {f"{f}_runtime_observations": f for f in FAMILIES}
    if said.get("schema_version") != "v1" or set(said) - {"schema_version", *lists}:
        raise ValueError("an observation file has schema_version v1 and lists of known families alone")
    rows = []
    for name, family in lists.items():
        for o in said.get(name, []):
            if set(o) - _OBSERVED or _OBSERVED - {"durable_payload_reference"} - set(o):
                raise ValueError(f"{name}: unknown or missing fields")
            rows.append((repo_id, family, o["file_path"], o["start_line"], o["start_column"], o["end_line"], o["end_column"], o["source_snippet"], o["probe_identifier"], o["probe_contract_revision"], o["repository_snapshot_basis"], o["attachment_links"], o["replay_target"], o["replay_selector"], _pairs(o["replay_inputs"]), _pairs(o["runtime_assumptions"]), _pairs(o["normalized_payload"]), o.get("durable_payload_reference")))
    return rows


def observations(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([r for repo, text in files.items() for r in observation_rows(text, repo)], OBSERVATIONS)
