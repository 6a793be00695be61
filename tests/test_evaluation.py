"""Ledger, specifications, selectors, baselines, metrics, provenance and refinement."""

import hashlib
import json
from functools import reduce

import pytest

from factpack.operators import file_packs
from factpack.plans import compile as C
from factpack.plans import evaluation as E
from factpack.plans import experiment
from factpack.plans import provenance, refine, scoring, semantics
from factpack.sources import ledger, repo, specs
from factpack.tables import cut
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = {
    "app.py": "from lib import work, rest\nfrom missing import *\nimport lib\n\ndef edit_me(order):\n    work(order)\n    getattr(order, 'name')\n    eval(source)\n    return unknown(order)\n",
    "lib.py": "def work(order):\n    return order\n\ndef rest():\n    return 'x' * 40\n",
    "zed.py": "def nothing():\n    return 0\n",
}
TASK = {
    "task_id": "t1", "fixture_id": "f",
    "expected_selectors": [
        {"kind": "symbol", "qualified_name": "app.edit_me", "role": "edit", "min_detail": "source", "symbol_kind": "function"},
        {"kind": "symbol", "qualified_name": "lib.work", "role": "support", "min_detail": "identity"},
        {"kind": "frontier", "file_path": "app.py", "access_text": "unknown", "context": "call", "reason_code": "unresolved_name", "min_detail": "identity", "enclosing_qualified_name": "app.edit_me"},
        {"kind": "unsupported", "file_path": "app.py", "construct_text": "getattr(order, 'name')", "reason_code": "reflective_builtin", "min_detail": "identity"},
    ],
}
OBSERVED = {
    "schema_version": "v1",
    "getattr_runtime_observations": [{
        "file_path": "app.py", "start_line": 7, "start_column": 4, "end_line": 7, "end_column": 26, "source_snippet": "getattr(order, 'name')", "probe_identifier": "p", "probe_contract_revision": "1",
        "repository_snapshot_basis": {"snapshot_kind": "git", "snapshot_id": "s", "is_dirty_worktree": False}, "attachment_links": [{"attachment_id": "a", "attachment_role": "log", "description": "d"}],
        "replay_target": "t", "replay_selector": "s", "replay_inputs": [{"key": "b", "value": " 2 "}, {"key": "a", "value": "1"}], "runtime_assumptions": [], "normalized_payload": [{"key": "lookup_outcome", "value": "returned_value"}],
    }],
}


@pytest.fixture(scope="module")
def files(spark):
    return repo.from_texts(spark, {"r": FILES})


@pytest.fixture(scope="module")
def program(files):
    return semantics.analyse(files)


def row(i, provider, score, **more):
    metrics = {"budget_compliant": True, "aggregate_score": score, "edit_coverage": 1.0, "support_coverage": None, "representation_adequacy": 1.0, "uncertainty_honesty": None, "noise_efficiency": 0.5}
    return {"run_id": f"r{i}", "task_id": f"t{i % 2}", "provider_name": provider, "budget": 200, "metrics": metrics | more}


def lines(spark, *rows):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in rows], "line string")


def test_ledger_is_strict(spark):
    good = row(1, "a", 0.5)
    lost = {k: v for k, v in good.items() if k != "task_id"} | {"run_id": "r3"}
    got = ledger.violations(lines(spark, good, good, "", "{oops", lost, row(5, "a", float("nan")), row(6, "a", 0.1)))
    assert sorted(r.reason for r in got.collect()) == ["blank_line", "duplicate_run_id", "malformed", "missing_field", "not_finite"]


def test_ledger_round_trip(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    raw = lines(spark, row(0, "a", 0.5), row(1, "b", 0.5))
    rows = raw.select(F.from_json("line", ledger.SCHEMA).alias("x")).select("x.*")
    ledger.append(rows, path)
    ledger.append(lines(spark, row(2, "a", 0.9)).select(F.from_json("line", ledger.SCHEMA).alias("x")).select("x.*"), path)
    back = ledger.read(spark, path)
    assert sorted((r.run_id, r.aggregate_score) for r in back.collect()) == [("r0", 0.5), ("r1", 0.5), ("r2", 0.9)]
    text = spark.read.text(path).first()[0]
    assert list(json.loads(text)) == sorted(json.loads(text))
    ledger.append(rows, path)
    with pytest.raises(ValueError, match="duplicate_run_id"):
        ledger.read(spark, path)


def test_summary(spark):
    rows = [row(0, "a", 0.5), row(2, "b", 0.5), row(4, "c", 0.4, budget_compliant=False), row(1, "a", 0.2, support_coverage=0.5)]
    rows[0] |= {"provider_metadata": {"selected_units": [{"primary_capability_tier": "heuristic_frontier", "has_attached_runtime_provenance": True}, {"primary_capability_tier": "runtime_backed", "has_attached_runtime_provenance": False}]}}
    rows[1] |= {"resolved_selectors": [{"original_selector": {"expected_primary_capability_tier": "unsupported_opaque", "expect_attached_runtime_provenance": False}, "primary_capability_tier": "unsupported_opaque", "has_attached_runtime_provenance": True}]}
    rows[2] |= {"runtime_provenance_records": [{"record_id": "x", "normalized_payload": {"k": "v"}}]}
    found = {k: {tuple(map(str, r)) for r in v.collect()} for k, v in E.summarise(ledger.typed(lines(spark, *rows))).items()}
    assert found["winners"] == {("t0", "200", "['a', 'b']", "0.5"), ("t1", "200", "['a']", "0.2")}
    assert found["units_by_provider"] == {("a", "2", "1"), ("b", "0", "0"), ("c", "0", "0")}
    assert found["units_by_tier"] == {("heuristic_frontier", "1", "1")}
    assert found["tier_expectations"] == {("unsupported_opaque", "1", "1")} and found["runtime_expectations"] == {("False", "1", "0")}
    assert found["outcomes"] == {("k", "v", "1")} and ("c", "1", "0.0", "0.4", "1.0", "None", "1.0", "None", "0.5") in found["providers"]
    text = E.render(E.summarise(ledger.typed(lines(spark, *rows))))
    assert "| a | 2 | 1.000 | 0.350 | 1.000 | 0.500 | 1.000 | - | 0.500 |" in text


def test_specs_are_strict(spark):
    assert specs.selectors(spark, {"r": json.dumps(TASK)}).count() == 4
    for change in ({"more": 1}, {"expected_selectors": []}, {"expected_selectors": [TASK["expected_selectors"][0] | {"unit_id": "x"}]}, {"expected_selectors": [TASK["expected_selectors"][0] | {"min_detail": "all"}]}):
        with pytest.raises(ValueError):
            specs.task_rows(json.dumps(TASK | change), "r")
    case = {"case_id": "c", "task_path": "t.json", "query": "q", "budgets": [240, 200], "providers": ["compiled_pack", "file_order_floor"]}
    assert [(r[0], r[4]) for r in specs.run_rows(json.dumps({"plan_id": "p", "cases": [case]}))] == [("p:c:compiled_pack:200", 200), ("p:c:compiled_pack:240", 240), ("p:c:file_order_floor:200", 200), ("p:c:file_order_floor:240", 240)]
    for change in ({"budgets": [0]}, {"providers": ["x"]}, {"task_path": "../t"}, {"extra": 1}):
        with pytest.raises(ValueError):
            specs.run_rows(json.dumps({"plan_id": "p", "cases": [case | change]}))
    with pytest.raises(ValueError):
        specs.run_rows(json.dumps({"plan_id": "p", "cases": [case, case]}))
    with pytest.raises(ValueError):
        specs.observation_rows(json.dumps(OBSERVED | {"schema_version": "v2"}), "r")


def test_selectors_resolve_or_say_why(spark, program):
    more = TASK | {"expected_selectors": [*TASK["expected_selectors"], {"kind": "symbol", "qualified_name": "no.such", "role": "edit", "min_detail": "source"}]}
    got = E.resolve_selectors(specs.selectors(spark, {"r": json.dumps(more)}), program)
    assert [(r.ord, r.status) for r in got.orderBy("ord").collect()] == [(0, "resolved"), (1, "resolved"), (2, "resolved"), (3, "resolved"), (4, "unresolved")]
    assert [r.failure for r in E.unresolved_report(got).collect()] == ["selector matched no candidate"]


def brute_take(files, budget, top):
    said = lambda taken: top(len(taken), len(files) - len(taken)) + "".join(f"\n\n## {p}\n{t}" for p, t in taken)
    taken = []
    for f in files:
        if file_packs.tokens(len(said([*taken, f]))) <= budget:
            taken.append(f)
    while taken and file_packs.tokens(len(said(taken))) > budget:
        taken.pop()
    return taken


def test_file_packs_are_brute_force():
    import random

    draw = random.Random(2)
    for _ in range(200):
        files = [(f"f{i}.py", "x" * draw.randrange(60)) for i in range(draw.randrange(14))]
        budget = draw.randrange(30, 140)
        top = lambda taken, left: file_packs.head("b", "t", "q", budget, taken, left, 1)
        assert [files[i] for i in file_packs.take(files, budget, top)] == brute_take(files, budget, top)


def test_runs_and_metrics(spark, program, files):
    runs = spark.createDataFrame([(f"{p}:{b}", "t1", "q", "change edit_me to work on the order", "r", p, b) for p in specs.PROVIDERS for b in (130, 400)], "run_id string, task_id string, query_id string, query string, repo_id string, provider string, budget int")
    packed = E.file_runs(program, files, runs)
    rows = {r.run_id: r for r in packed.collect()}
    assert rows["lexical_top_k_files:400"].files == ["app.py", "lib.py"] and rows["file_order_floor:400"].files == ["app.py", "lib.py", "zed.py"]
    assert rows["import_neighborhood_files:400"].warnings == ["star_import_not_expanded", "import_not_resolved"]
    assert all(r.fits and r.document.startswith("# Baseline Context") for r in rows.values())
    asked = runs.where("provider = 'compiled_pack'").select(F.concat_ws(":", "query_id", "budget").alias("query_id"), "query", "budget")
    done = C.results(C.pack_units(program, asked), asked)
    mine = done.select(F.concat(F.lit("compiled_pack:"), F.col("budget")).alias("run_id"), F.lit("t1").alias("task_id"), "repo_id", F.lit("compiled_pack").alias("provider"), "budget", "total_tokens", F.transform("selections", lambda s: F.struct(s["unit_id"].alias("unit_id"), s["detail"].alias("detail"), s["token_count"].alias("token_count"))).alias("selected"), F.array().cast("array<string>").alias("files"), F.col("omitted_unit_ids").alias("omitted"), F.transform("warnings", lambda w: w["unit_id"]).alias("warned"))
    theirs = packed.join(runs, "run_id").select("run_id", "task_id", "repo_id", "provider", "budget", F.col("total_tokens").cast("long").alias("total_tokens"), F.expr("cast(array() as array<struct<unit_id:string,detail:string,token_count:int>>)").alias("selected"), "files", F.array().cast("array<string>").alias("omitted"), F.array().cast("array<string>").alias("warned"))
    resolved = E.resolve_selectors(specs.selectors(spark, {"r": json.dumps(TASK)}), program)
    got = {r.run_id: r for r in E.run_metrics(resolved, mine.unionByName(theirs), program).collect()}
    assert len(got) == 8
    best, lexical = got["compiled_pack:400"], got["lexical_top_k_files:400"]
    assert best.edit_coverage == 1.0 and best.support_coverage == 1.0 and best.uncertainty_honesty == 1.0
    assert lexical.edit_coverage == 1.0 and lexical.uncertainty_honesty == 0.0
    edit = FILES["app.py"][FILES["app.py"].index("def edit_me"):].rstrip("\n")
    work = "def work(order):\n    return order"
    credit = -(-len(edit) // 4) + -(-len(work) // 4)
    assert lexical.credited_relevant_tokens == credit and lexical.noise_efficiency == pytest.approx(credit / lexical.total_tokens)
    want = (0.35 + 0.25 + 0.15 + 0.10 * lexical.noise_efficiency) / 1.0
    assert lexical.aggregate_score == pytest.approx(want)
    assert best.aggregate_score > lexical.aggregate_score


def test_experiment(spark, files, tmp_path):
    plan = {"plan_id": "p", "cases": [{"case_id": "c", "task_path": "t.json", "query": "change edit_me to work on the order", "budgets": [130, 400], "providers": list(specs.PROVIDERS)}]}
    task = TASK | {"expected_selectors": [*TASK["expected_selectors"][:3], TASK["expected_selectors"][3] | {"expected_primary_capability_tier": "unsupported_opaque", "expect_attached_runtime_provenance": True}]}
    rows = experiment.run(spark, json.dumps(plan), {"t.json": (json.dumps(task), "r")}, files, {"r": json.dumps(OBSERVED)})
    path = f"{tmp_path}/ledger"
    ledger.append(rows, path)
    found = E.summarise(ledger.read(spark, path))
    assert {(r.task_id, r.budget): r.winners for r in found["winners"].collect()}["t1", 400] == ["compiled_pack"]
    means = {r.provider_name: r.avg_aggregate_score for r in found["providers"].collect()}
    assert len(means) == 4 and max(means, key=means.get) == "compiled_pack"
    assert [tuple(r) for r in found["tier_expectations"].collect()] == [("unsupported_opaque", 8, 8)]
    assert [tuple(r) for r in found["runtime_expectations"].collect()] == [(True, 8, 8)]
    assert {(r.key, r.value): r.n for r in found["outcomes"].collect()} == {("lookup_outcome", "returned_value"): 8}
    with pytest.raises(ValueError, match="unresolved"):
        experiment.run(spark, json.dumps(plan), {"t.json": (json.dumps(TASK | {"expected_selectors": [TASK["expected_selectors"][0] | {"qualified_name": "no.such"}]}), "r")}, files)


def test_provenance(spark, program):
    observed = specs.observations(spark, {"r": json.dumps(OBSERVED)})
    assert provenance.unmatched(observed, program).count() == 0 and provenance.violations(observed, program).count() == 0
    records = cut(provenance.attach(program, observed))
    got = records.collect()
    assert len(got) == 1
    detail = json.dumps({"probe_identifier": "p", "probe_contract_revision": "1", "replay_target": "t", "replay_selector": "s", "replay_inputs": {"a": "1", "b": "2"}, "runtime_assumptions": {}, "normalized_payload": {"lookup_outcome": "returned_value"}}, sort_keys=True, separators=(",", ":"))
    assert got[0].origin_detail == detail
    digest = hashlib.sha256(f"unsupported_finding\n{got[0].subject_id}\n{detail}".encode()).hexdigest()[:24]
    assert got[0].record_id == f"prov:runtime:unsupported_finding:{digest}"
    assert provenance.contract_violations(records).count() == 0
    assert provenance.visible(records).count() == 1 and provenance.visible(records.withColumn("visibility", F.array(F.lit("render")))).count() == 0
    broken = {
        "no_subject_id": {"subject_id": F.lit("")}, "no_origin_detail": {"origin_detail": F.lit("  ")}, "no_site": {"sl": F.lit(None).cast("int")},
        "no_visibility": {"visibility": F.expr("cast(array() as array<string>)")}, "visibility_repeats": {"visibility": F.array(F.lit("render"), F.lit("render"))},
        "links_repeat": {"links": F.concat("links", "links")}, "tier_contract": {"origin": F.lit("heuristic_rule")}, "no_links": {"links": F.slice("links", 1, 0)},
    }
    all_broken = reduce(DataFrame.union, [records.withColumns(change | {"repo_id": F.lit(reason)}).select(records.columns) for reason, change in broken.items()])
    assert sorted((r.repo_id, r.reason) for r in provenance.contract_violations(all_broken).collect()) == sorted((x, x) for x in broken)
    static = records.withColumns({"tier": F.lit("statically_proved"), "origin": F.lit("static_derivation_rule"), "replay": F.lit("deterministic_static")})
    assert {r.reason for r in provenance.contract_violations(static).collect()} == {"subject_tier", "snapshot_without_runtime", "links_without_runtime"}
    assert provenance.contract_violations(records.union(records)).collect()[0].reason == "record_repeats"
    one = OBSERVED["getattr_runtime_observations"][0]
    bad = {"schema_version": "v1", "getattr_runtime_observations": [one | {"normalized_payload": [{"key": "lookup_outcome", "value": "returned_default_value"}]}], "hasattr_runtime_observations": [one]}
    seen = specs.observations(spark, {"r": json.dumps(bad)})
    assert [r.reason for r in provenance.violations(seen, program).collect()] == ["outcome_not_allowed"]
    assert [r.family for r in provenance.unmatched(seen, program).collect()] == ["hasattr"]
    shapes = {(r.family, r.argc) for r in provenance.eligible(program).collect()}
    assert shapes == {("getattr", 2), ("eval", 1)}


def test_refinement(spark, program):
    queries = spark.createDataFrame([("q", "rest", 12)], "query_id string, query string, budget int")
    packed, units = C.pack_units(program, queries), cut(scoring.units(program))
    observed = specs.observations(spark, {"r": json.dumps(OBSERVED)})
    traces = cut(provenance.trace_summaries(units, provenance.attach(program, observed)))
    misses = spark.createDataFrame([
        ("m1", "q", "r", "absent_symbol", "edit_me"), ("m2", "q", "r", "edit_to_omitted_path", "/home/x/zed.py"), ("m3", "q", "r", "out_of_pack_trace", 'File "app.py", line 7, in edit_me'),
        ("m4", "q", "r", "absent_symbol", "nobody"), ("m5", "q", "r", "absent_symbol", "getattr(order, 'name')"),
    ], "miss_id string, query_id string, repo_id string, kind string, evidence string")
    found = cut(refine.diagnose(misses, units, packed, traces))
    got = {}
    for r in found.collect():
        got.setdefault(r.miss_id, set()).add((r.unit_id.split(":")[-1], r.status, r.boundary))
    assert got["m1"] == got["m3"] == {("app.edit_me", "omitted", "statically_proved")}
    assert ("zed.nothing", "omitted", "statically_proved") in got["m2"] and "m4" not in got
    assert {x[2] for x in got["m5"]} == {"unsupported_opaque_with_attached_runtime_support"}
    said = {r.miss_id: r.reason for r in refine.reasons(misses, found).collect()}
    assert said["m1"] == "Grounded 1 semantic unit(s). 1 statically proved unit(s) were omitted due to budget pressure."
    assert said["m4"] == "Could not ground the evidence to accepted semantic unit IDs."
    dense = refine.dense_summary(misses, found)
    assert dense.count() == 5 * 3 * 5 and dense.agg(F.sum("n")).first()[0] == found.count()
    # every variant of the diagnosis is a set of misses of its own, so that one plan tells them all apart
    lost = F.col("miss_id") == "m5"
    variants = {
        "": found, "not_classified": found.where("miss_id != 'm1'"), "statuses_overlap": found.union(found.withColumn("status", F.lit("too_shallow"))),
        "boundary_differs": found.withColumn("boundary", F.when(lost, "statically_proved").otherwise(F.col("boundary"))),
        "unknown_status": found.withColumn("status", F.when(lost, "lost").otherwise(F.col("status"))),
        "not_grounded": found.union(found.where(lost).withColumn("miss_id", F.lit("m4"))),
    }
    mark = lambda rows, name: rows.withColumn("miss_id", F.concat(F.lit(name + ":"), F.col("miss_id"))).select(rows.columns)
    told = reduce(DataFrame.union, [mark(rows, name) for name, rows in variants.items()])
    every = reduce(DataFrame.union, [mark(misses, name) for name in variants])
    got = {tuple(r.miss_id.split(":")) + (r.reason,) for r in refine.violations(every, units, cut(told), traces).collect()}
    assert {(name, reason) for name, _, reason in got} == {(name, name) for name in variants if name}
    assert {miss for name, miss, _ in got if name in ("boundary_differs", "unknown_status")} == {"m5"}
    again, changes = refine.recompile(program, queries, misses, units, packed, traces, 400)
    chosen = {r.unit_id.split(":")[-1]: r.change for r in changes.collect()}
    assert chosen["app.edit_me"] == "newly_selected"
    assert again.where("detail = 'source' and unit_id like '%edit_me'").count() == 1
