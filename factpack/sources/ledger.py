"""The run ledger: JSON lines, read strictly and appended with sorted keys.

A row must parse, have every required field of its type, finite numbers and a run id of its own; a blank
line is an error. ``violations`` tells each offending line with its reason; ``read`` raises on any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = ("aggregate_score", "edit_coverage", "support_coverage", "representation_adequacy", "uncertainty_honesty", "noise_efficiency")
NULLABLE = ("support_coverage", "uncertainty_honesty")
SCHEMA = (
    "run_id string, task_id string, provider_name string, budget int, "
    "provider_metadata struct<selected_units:array<struct<primary_capability_tier:string,has_attached_runtime_provenance:boolean>>>, "
    "resolved_selectors array<struct<original_selector:struct<expected_primary_capability_tier:string,expect_attached_runtime_provenance:boolean>,primary_capability_tier:string,has_attached_runtime_provenance:boolean>>, "
    "runtime_provenance_records array<struct<record_id:string,normalized_payload:map<string,string>>>, "
    "metrics struct<budget_compliant:boolean," + ",".join(f"{c}:double" for c in SCORES) + ">"
)


def _parsed(lines: DataFrame) -> DataFrame:
    """(line, row): a line that does not parse as the schema has a null row."""
    row = F.from_json("line", SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"})
    return lines.select("line", row.alias("row"))


def _faults(row) -> F.Column:
    m = row["metrics"]
    required = [row[c] for c in ("run_id", "task_id", "provider_name", "budget")] + [m["budget_compliant"]] + [m[c] for c in SCORES if c not in NULLABLE]
    missing = [x.isNull() for x in required]
    odd = [F.isnan(m[c]) | F.abs(m[c]).isin(float("inf")) for c in SCORES]
    fold = lambda parts: F.exists(F.array(*[F.coalesce(x, F.lit(False)) for x in parts]), lambda x: x)
    return (
        F.when(F.trim("line") == "", "blank_line")
        .when(row["_bad"].isNotNull() | row.isNull(), "malformed")
        .when(fold(missing), "missing_field")
        .when(fold(odd), "not_finite")
    )


def violations(lines: DataFrame) -> DataFrame:
    """(line, reason) of the lines (line) that no ledger may have."""
    rows = _parsed(lines)
    bad = rows.select("line", _faults(F.col("row")).alias("reason")).where("reason is not null")
    again = rows.where("row.run_id is not null").groupBy("row.run_id").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n > 1")
    return bad.unionByName(again.select("line", F.lit("duplicate_run_id").alias("reason")))


def typed(lines: DataFrame) -> DataFrame:
    """Typed rows of clean lines; missing nested blocks are empty."""
    rows = _parsed(lines).select("row.*").drop("_bad")
    empty = lambda c, inner: F.coalesce(inner, F.from_json(F.lit("[]"), F.lit(c)))
    units = "array<struct<primary_capability_tier:string,has_attached_runtime_provenance:boolean>>"
    return rows.select(
        "run_id", "task_id", "provider_name", "budget",
        empty(units, F.col("provider_metadata.selected_units")).alias("selected_units"),
        F.coalesce("resolved_selectors", F.expr("cast(array() as array<struct<original_selector:struct<expected_primary_capability_tier:string,expect_attached_runtime_provenance:boolean>,primary_capability_tier:string,has_attached_runtime_provenance:boolean>>)")).alias("resolved_selectors"),
        F.coalesce("runtime_provenance_records", F.expr("cast(array() as array<struct<record_id:string,normalized_payload:map<string,string>>>)")).alias("runtime_provenance_records"),
        "metrics.*",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    bad = violations(lines).limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.reason}: {r.line[:80]}" for r in bad))
    if not lines.limit(1).count():
        raise ValueError("the ledger is empty")
    return typed(lines)


def append(rows: DataFrame, path: str) -> None:
    """Append rows as compact JSON lines with the fields of each object in order of their names."""
    ordered = rows.select(*sorted(rows.columns))
    ordered.write.mode("append").option("ignoreNullFields", "false").json(path)
