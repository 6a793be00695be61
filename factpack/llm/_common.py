"""What the operators of this subpackage share: the shared scratch folder, tables and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A pass over texts works on so many bytes at once (a longer document is worked on alone).
CHUNK_BYTES = 1 << 19

#: Rows that a window of ``ranked`` holds, about.
RANK_ROWS = 512

_scratch: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset, and the executors live in the driver's process, is a local folder used.
    """
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


#: Spark's settings while a table is written: a query's shuffle files go when it ends, and a batch for a Python
#: worker has so many bytes (a longer row is a batch of its own), of which both sides hold some copies.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a replicated cut of the lineage.

    The shuffle files of the write go when it ends, as nothing reads them after.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factpack-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._factpack_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that no later plan reads."""
    for df in tables:
        path = df._factpack_path
        _delete(df.sparkSession, path)
        _scratch.remove((df.sparkSession, path))


def null_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch of at most ``limit`` bytes of text, or of one row."""
    texts = batch.column(column)
    sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back: Python workers are used again by later stages, and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ranked(df: DataFrame, keys: list[str], order: list[str], largest: int, name: str = "rank") -> DataFrame:
    """df with the column ``name`` (long, from 0): the place of a row among the rows with its keys.

    Rows are dealt by a hash of the ``order`` columns into buckets, ranked in their bucket, and
    moved on by the sizes of the buckets before: no window holds all rows of a key. Places follow the
    bucket, then ``order``; rows that are alike in all of ``order`` are interchangeable. ``largest`` is
    the number of rows of the largest key, of which the number of buckets follows. df has no column
    whose name begins with ``_``.
    """
    from pyspark.sql import Window

    buckets = 1 + largest // RANK_ROWS
    at = [*keys, "_bucket"]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*at).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(at)], F.coalesce(before, F.lit(0)).alias("_before"))
    placed = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(at)]
    out = placed.join(sizes, same)
    rank = (F.col("_before") + F.col("_row") - 1).cast("long")
    return out.select(*df.columns, rank.alias(name))
