"""A training-corpus pipeline of five stages, each an operator of ``factpack.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of docs, whatever those are: a row
travels as one struct, so columns named like an operator's own are safe.

1. quality: documents that the ordinal classifier rejects go.
2. exact dedup: of equal texts (without white space) one row stays.
3. near dedup: of each component of the 5-word-shingle Jaccard join at 0.8 one document stays.
4. mixing: all documents, in the Pfair order of their sources: the files and the rows in them follow
   the schedule, so every prefix has each source within a block of its share until one runs out.
5. packing: the pieces of all documents with their sequences, which are numbered in the mixed order: every
   prefix of the sequences has the documents of a prefix of the order, but for one window of the packing.
"""

from __future__ import annotations

import itertools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factpack.llm import _common, cuckoo_dedup, mixing, ngram_join, ordinal_quality, packing


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = ordinal_quality.classify(_rows(docs, "doc_id", "text"), labels, rated_docs=docs)
    return rated.where("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = cuckoo_dedup.dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = _rows(docs, F.col("doc_id").cast("long").alias("_doc"), F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", ""), 256).alias("_digest"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    # rows that repeat an id and a text: one stays, the longest as it is written
    one = F.row_number().over(Window.partitionBy("_doc", "_digest").orderBy(F.length("row.text").desc()))
    return rows.join(kept, same, "left_semi").withColumn("_n", one).where("_n = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.join_ngrams(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = _rows(docs, F.col("doc_id").cast("long").alias("_doc"))
    return rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_rows(docs, "doc_id", "text", "source"))
    return mixed.select("row", "slot", "place").repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def _positions(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and position (the place of a row in the order of the files and of their rows), and the last one.

    Rows that are not read from Parquet are written in their order first.
    """
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        docs = _common.table(docs.select("doc_id", "text"))
    at = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", at["file_name"].alias("file"), at["row_index"].alias("row"))
    # a row for each file, which the driver lists anyway
    sizes = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect())
    ends = [0, *itertools.accumulate(n for _, n in sizes)]
    begins = docs.sparkSession.createDataFrame([(file, end) for (file, _), end in zip(sizes, ends, strict=False)], "file string, begin long")
    return rows.join(F.broadcast(begins), "file").select("doc_id", "text", (F.col("begin") + F.col("row")).alias("position")), ends[-1] - 1


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(*_positions(docs))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier's fit nor the packing: tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; a stage's folder goes when the next one is written, the last one at exit."""
    docs, before = _common.documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = _common.table(stage(spark, docs, sf_dir))
        if before is not None:
            _common.drop(before)
        before = docs
    return docs
