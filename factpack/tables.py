"""Tables in the shared folder of the cluster, to cut a lineage or to share a stage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


@atexit.register
def _delete_all() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: replicated storage, and a short plan for what reads it many times.

    The table is deleted by ``drop``, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factpack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._factpack_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._factpack_path)
        _scratch.remove((df.sparkSession, df._factpack_path))
