"""Runtime evidence: observations joined to the boundaries they explain, as provenance rows.

One equi-join on the site serves all families; what a family may attach to, and what it must say, are
rows of rule tables. Observations of no eligible site are reported, not attached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .semantics import Program

#: Family, reason code it explains, callee (null: any name or .import_module), numbers of arguments.
SHAPES = (
    ("dynamic_import", "dynamic_import", None, None), ("hasattr", "reflective_builtin", "hasattr", [2]), ("getattr", "reflective_builtin", "getattr", [2, 3]),
    ("vars", "reflective_builtin", "vars", [0, 1]), ("dir", "reflective_builtin", "dir", [0, 1]), ("globals", "runtime_mutation", "globals", [0]),
    ("locals", "runtime_mutation", "locals", [0]), ("setattr", "runtime_mutation", "setattr", [3]), ("delattr", "runtime_mutation", "delattr", [2]),
    ("eval", "exec_or_eval", "eval", [1]), ("exec", "exec_or_eval", "exec", [1]), ("metaclass_behavior", "metaclass_behavior", None, None),
)
#: Family, arguments (null: any), payload key, what it may say, whether it must be the only key.
OUTCOMES = (
    ("getattr", 2, "lookup_outcome", ["returned_value", "raised_attribute_error"], True), ("getattr", 3, "lookup_outcome", ["returned_value", "returned_default_value"], True),
    ("vars", 0, "lookup_outcome", ["returned_namespace"], True), ("vars", 1, "lookup_outcome", ["returned_namespace", "raised_type_error"], True),
    ("globals", None, "lookup_outcome", ["returned_namespace"], False), ("locals", None, "lookup_outcome", ["returned_namespace"], False),
    ("setattr", None, "mutation_outcome", ["returned_none"], False), ("delattr", None, "mutation_outcome", ["deleted_attribute"], False),
    ("eval", None, "evaluation_outcome", ["returned_value"], False), ("exec", None, "execution_outcome", ["completed"], False),
    ("metaclass_behavior", None, "class_creation_outcome", ["created_class"], False),
)
DURABLE = ("dir", "setattr", "eval", "exec", "metaclass_behavior")
SOURCE_SHAPES = {"eval": "literal_expression", "exec": "literal_statement"}
#: What a capability tier implies.
TIERS = {
    "statically_proved": ("static_derivation_rule", "deterministic_static"), "runtime_backed": ("runtime_probe_identity", "reproducible_runtime"),
    "heuristic_frontier": ("heuristic_rule", "non_proof_heuristic"), "unsupported_opaque": ("unsupported_reason_code", "opaque_boundary"),
}
#: The steps a record is visible to unless it says less, and the tiers that some kinds of subject are bound to.
VISIBILITY = ("render", "compile", "diagnose")
SUBJECT_TIERS = {"frontier_item": ["heuristic_frontier", "runtime_backed"], "unsupported_finding": ["unsupported_opaque", "runtime_backed"]}
_AT = ["file_path", "sl", "sc", "el", "ec"]


def eligible(program: Program) -> DataFrame:
    """(repo_id, family, construct_id, argc, site): the boundaries that a family may explain."""
    spark = program.facts.sparkSession
    rules = F.broadcast(spark.createDataFrame(list(SHAPES), "family string, reason_code string, callee string, argcs array<int>"))
    calls = program.facts.where("fact = 'call'").select("repo_id", F.concat(F.lit("unsupported:"), F.col("id")).alias("construct_id"), F.col("el").alias("cel"), F.col("ec").alias("cec"), F.col("text").alias("callee_text"), F.col("n").alias("argc"), F.col("flag").alias("plain"), F.size("attrs").alias("hops"), F.try_element_at("attrs", F.lit(-1)).alias("last"))
    rows = program.unsupported.join(calls, ["repo_id", "construct_id"], "left").where("cel is null or (cel = el and cec = ec)").join(rules, "reason_code")
    named = (F.col("callee_text") == F.col("callee")) & F.array_contains("argcs", F.col("argc")) & (~F.col("family").isin("eval", "exec") | F.col("plain"))
    dynamic = (F.col("hops") == 0) | (F.col("last") == "import_module")
    ok = F.when(F.col("family") == "metaclass_behavior", F.col("callee_text").isNull()).when(F.col("family") == "dynamic_import", dynamic).otherwise(named)
    return rows.where(ok).select("repo_id", "family", "construct_id", "argc", F.col("path").alias("file_path"), "sl", "sc", "el", "ec", F.col("snippet").alias("site_snippet"))


def unmatched(observed: DataFrame, program: Program) -> DataFrame:
    """Observations of no eligible site, or whose snippet is not the site's text."""
    rows = observed.join(eligible(program), ["repo_id", "family", *_AT], "left")
    return rows.where("construct_id is null or snippet != site_snippet").select("repo_id", "family", *_AT, F.when(F.col("construct_id").isNull(), "no_eligible_site").otherwise("snippet_differs").alias("reason"))


def violations(observed: DataFrame, program: Program) -> DataFrame:
    """Matched observations that may not be attached, with the first reason."""
    spark = program.facts.sparkSession
    rules = F.broadcast(spark.createDataFrame(list(OUTCOMES), "family string, rule_argc int, payload_key string, allowed array<string>, alone boolean"))
    rows = observed.join(eligible(program), ["repo_id", "family", *_AT]).join(rules, "family", "left").where("rule_argc is null or rule_argc = argc")
    said = F.element_at("normalized_payload", F.col("payload_key"))
    blank = [F.trim(c) == "" for c in ("probe_identifier", "probe_contract_revision", "replay_target", "replay_selector")]
    ids = F.transform("links", lambda x: x["attachment_id"])
    shape = F.create_map(*[F.lit(x) for kv in SOURCE_SHAPES.items() for x in kv])
    wanted = F.element_at(shape, F.col("family"))
    reason = (
        F.when(blank[0] | blank[1] | blank[2] | blank[3], "empty_identity")
        .when(F.col("snapshot").isNull(), "no_snapshot").when(F.coalesce(F.size("links"), F.lit(0)) < 1, "no_links")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "links_repeat")
        .when((F.size("normalized_payload") == 0) & F.col("durable").isNull(), "no_payload")
        .when(F.col("family").isin(*DURABLE) & (F.coalesce(F.trim("durable"), F.lit("")) == ""), "no_durable_reference")
        .when(F.col("payload_key").isNotNull() & F.coalesce(~F.array_contains("allowed", said), F.lit(True)), "outcome_not_allowed")
        .when(F.coalesce("alone", F.lit(False)) & (F.size("normalized_payload") != 1), "payload_has_more")
        .when(wanted.isNotNull() & F.coalesce(F.element_at("replay_inputs", F.lit("source_shape")) != wanted, F.lit(True)), "source_shape")
        .when(wanted.isNotNull() & ~F.coalesce(X.is_digest(F.element_at("replay_inputs", F.lit("source_sha256"))), F.lit(False)), "source_sha256")
    )
    return rows.select("repo_id", "family", "construct_id", reason.alias("reason")).where("reason is not null")


def checked(program: Program, observed: DataFrame) -> DataFrame:
    """``attach``, or ValueError with up to three observations that have no site or may not be attached."""
    bad = unmatched(observed, program).select("family", "reason").union(violations(observed, program).select("family", "reason")).limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.family}: {r.reason}" for r in bad))
    return attach(program, observed)


def attach(program: Program, observed: DataFrame) -> DataFrame:
    """Provenance rows (repo_id, record_id, subject_id, family, tier, origin, ...) of the observations.

    The record id is a digest of the subject and of the canonical JSON of what was observed.
    """
    rows = observed.join(eligible(program).drop("site_snippet"), ["repo_id", "family", *_AT])
    quoted = lambda c: F.to_json(F.array(F.trim(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.trim(c)))) - 2)
    parts = [F.concat(F.lit('"normalized_payload":'), X.canonical_json(F.col("normalized_payload"))), F.concat(F.lit('"probe_contract_revision":'), quoted("probe_contract_revision")), F.concat(F.lit('"probe_identifier":'), quoted("probe_identifier")), F.concat(F.lit('"replay_inputs":'), X.canonical_json(F.col("replay_inputs"))), F.concat(F.lit('"replay_selector":'), quoted("replay_selector")), F.concat(F.lit('"replay_target":'), quoted("replay_target")), F.concat(F.lit('"runtime_assumptions":'), X.canonical_json(F.col("runtime_assumptions")))]
    durable = F.when(F.col("durable").isNotNull(), F.concat(F.lit('"durable_payload_reference":'), quoted("durable")))
    detail = F.concat(F.lit("{"), F.concat_ws(",", durable, *parts), F.lit("}"))
    kind = F.lit("unsupported_finding")
    rows = rows.withColumn("origin_detail", detail)
    return rows.select("repo_id", X.digest_id("prov:runtime:unsupported_finding:", kind, F.col("construct_id"), F.col("origin_detail")).alias("record_id"), F.col("construct_id").alias("subject_id"), kind.alias("subject_kind"), "family", F.lit("runtime_backed").alias("tier"), F.lit(TIERS["runtime_backed"][0]).alias("origin"), F.lit(TIERS["runtime_backed"][1]).alias("replay"), "origin_detail", "snapshot", "links", "normalized_payload", F.col("file_path").alias("path"), "sl", "sc", "el", "ec", F.array(*[F.lit(x) for x in VISIBILITY]).alias("visibility"))


def visible(records: DataFrame, to: str = "compile") -> DataFrame:
    """The records that a later step (render, compile or diagnose) may see."""
    return records.where(F.array_contains("visibility", to))


def trace_summaries(units: DataFrame, records: DataFrame) -> DataFrame:
    """Each unit's primary tier and its runtime records in order, of the records that compiling may see."""
    tier = F.when(F.col("kind") == "proven_symbol", "statically_proved").when(F.col("kind") == "unresolved_frontier", "heuristic_frontier").otherwise("unsupported_opaque")
    attached = visible(records).groupBy("repo_id", F.col("subject_id").alias("unit_id")).agg(F.array_sort(F.collect_set(F.when(F.col("tier") == "runtime_backed", F.col("record_id")))).alias("runtime_records"), F.min(F.when(F.col("tier") != "runtime_backed", F.struct("record_id", "tier"))).alias("first"))
    rows = units.select("repo_id", "unit_id", "kind").join(attached, ["repo_id", "unit_id"], "left")
    ids = F.coalesce("runtime_records", F.array().cast("array<string>"))
    return rows.select("repo_id", "unit_id", F.coalesce("first.tier", tier).alias("primary_tier"), (F.size(ids) > 0).alias("has_runtime"), ids.alias("runtime_records"))


def contract_violations(records: DataFrame) -> DataFrame:
    """(repo_id, record_id, reason): a row for each promise that a record breaks, or whose id repeats.

    records are rows as ``attach`` makes them, of any tier. Nulls count as empty.
    """
    tiers = F.create_map(*[F.lit(x) for k, (o, r) in TIERS.items() for x in (k, f"{o}|{r}")])
    subjects = F.create_map(*[y for k, v in SUBJECT_TIERS.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    repeats = lambda xs: F.coalesce(F.size(F.array_distinct(xs)) < F.size(xs), F.lit(False))
    backed = F.coalesce(F.col("tier") == "runtime_backed", F.lit(False))
    promises = {
        "no_record_id": F.coalesce("record_id", F.lit("")) == "",
        "no_subject_id": F.coalesce("subject_id", F.lit("")) == "",
        "no_origin_detail": blank("origin_detail"),
        "no_site": F.col("path").isNull() | F.col("sl").isNull(),
        "no_visibility": size("visibility") < 1,
        "visibility_repeats": repeats(F.col("visibility")),
        "links_repeat": repeats(F.transform("links", lambda x: x["attachment_id"])),
        "tier_contract": F.coalesce(F.element_at(tiers, F.col("tier")) != F.concat_ws("|", "origin", "replay"), F.lit(True)),
        "subject_tier": ~F.coalesce(F.array_contains(F.element_at(subjects, F.col("subject_kind")), F.col("tier")), F.lit(True)),
        "no_snapshot": backed & F.col("snapshot").isNull(),
        "no_links": backed & (size("links") < 1),
        "snapshot_without_runtime": ~backed & F.col("snapshot").isNotNull(),
        "links_without_runtime": ~backed & (size("links") > 0),
    }
    broken = F.filter(F.array(*[F.when(c, k) for k, c in promises.items()]), lambda x: x.isNotNull())
    wrong = records.select("repo_id", "record_id", F.explode(broken).alias("reason"))
    again = records.groupBy("repo_id", "record_id").agg(F.count("*").alias("n")).where("n > 1").select("repo_id", "record_id", F.lit("record_repeats").alias("reason"))
    return wrong.unionByName(again)
