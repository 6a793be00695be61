"""The ledger as a stream (an extension: run files arrive, rollups follow).

New JSON-line files under a folder are read as they come; each provider's counts and means are kept as
state that is one row a provider. ``late_runs`` keeps a watermark on the time of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ledger


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the clean lines that arrive in a folder."""
    lines = spark.readStream.schema("line string").text(folder)
    rows = lines.select("line", F.from_json("line", ledger.SCHEMA).alias("row")).where("row.run_id is not null and row.metrics.aggregate_score is not null")
    return rows.select("row.*").select("run_id", "task_id", "provider_name", "budget", "metrics.*")


def rollup(stream: DataFrame) -> DataFrame:
    """Runs, compliance and mean scores of each provider so far (output mode: update or complete)."""
    rate = F.avg(F.col("budget_compliant").cast("double")).alias("compliance_rate")
    return stream.groupBy("provider_name").agg(F.count("*").alias("n_runs"), rate, *[F.avg(c).alias(f"avg_{c}") for c in ledger.SCORES])


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts by key and sliding window of event time; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"))
