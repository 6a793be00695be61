"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a text's
digest is the SHA-256 of that in UTF-8. The index is a table with one row for each of its buckets:

* the *cuckoo filter* of the bucket: slots of four 16-bit fingerprints; a digest may lie in slot
  ``i`` or in ``i ^ hash(fingerprint)``, and an insertion moves others between their two slots;
* the *bucketed content*: the live digests themselves, each with its count of live rows and the
  best row that was inserted (most code points, then smallest id).

A digest that the filter does not hold is new; one that it seems to hold is verified against the
bucket's content, so false positives cost a look-up and never a document. An insertion that finds no
place after ``KICKS`` moves makes the filter grow: twice the slots, filled anew from the stored keys.
An index whose buckets hold ``BUCKET_ROWS`` digests twice over, on average, is dealt to more buckets.
Beside the buckets stand the live rows, a plain table. Deletion takes rows off it and counts what is left
of their digests: a digest gets its best live row anew, and at none its key and its fingerprint go. ``insert``, ``delete`` and
``probe`` take tables of any size: rows are summed up by digest within a task first, so a group of
copies reaches its bucket as one row from each task, and buckets are worked on apart.

Results: nulls count as empty texts, and empty texts are equal to each other. A null id comes after
every other id; rows that repeat an id and a text are the same document and get the same verdict. Very
long texts are hashed whole. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, null_text, table

SLOT, KICKS, START = 4, 200, 64
DELETED = bytes([32, 9, 10, 11, 12, 13])
NO_ID = (1 << 63) - 1
#: Digests that a bucket is meant for.
BUCKET_ROWS = 50_000

_DIGESTS = "doc_id long, digest binary, n_chars long"
_STATE = "bucket int, size long, slots binary, digests binary, counts binary, chars binary, ids binary"


class CuckooFilter:
    """Fingerprints of 256-bit digests; the caller keeps the digests for ``grown``."""

    def __init__(self, slots: np.ndarray | None = None):
        self.slots = np.zeros((START, SLOT), np.uint16) if slots is None else slots
        self.turn = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        print_ = int.from_bytes(digest[8:10], "little") or 1
        return print_, int.from_bytes(digest[10:18], "little") & len(self.slots) - 1

    def _other(self, at: int, print_: int) -> int:
        return at ^ (print_ * 0x5BD1E995 & len(self.slots) - 1)

    def __contains__(self, digest: bytes) -> bool:
        print_, at = self._place(digest)
        return print_ in self.slots[at] or print_ in self.slots[self._other(at, print_)]

    def add(self, digest: bytes) -> bool:
        """False: no place was found, and one fingerprint is lost; the filter must grow."""
        print_, at = self._place(digest)
        for _ in range(KICKS):
            for place in (at, self._other(at, print_)):
                free = np.flatnonzero(self.slots[place] == 0)
                if len(free):
                    self.slots[place, free[0]] = print_
                    return True
            at, self.turn = self._other(at, print_), self.turn + 1
            print_, self.slots[at, self.turn % SLOT] = int(self.slots[at, self.turn % SLOT]), print_
        return False

    def remove(self, digest: bytes) -> None:
        print_, at = self._place(digest)
        for place in (at, self._other(at, print_)):
            held = np.flatnonzero(self.slots[place] == print_)
            if len(held):
                self.slots[place, held[0]] = 0
                return

    def grown(self, digests) -> CuckooFilter:
        size = len(self.slots)
        while True:
            size *= 2
            bigger = CuckooFilter(np.zeros((size, SLOT), np.uint16))
            if all(bigger.add(x) for x in digests):
                return bigger


class Bucket:
    """One bucket: its filter, and digest -> [live rows, code points, id] of its content."""

    def __init__(self, row: dict | None = None):
        self.filter, self.content = CuckooFilter(), {}
        if row:
            self.filter = CuckooFilter(np.frombuffer(row["slots"], np.uint16).reshape(-1, SLOT).copy())
            keys, numbers = row["digests"], (np.frombuffer(row[k], np.int64).tolist() for k in ("counts", "chars", "ids"))
            self.content = {keys[32 * i : 32 * i + 32]: list(v) for i, v in enumerate(zip(*numbers, strict=True))}

    def insert(self, digest: bytes, count: int, chars: int, id_: int) -> None:
        if digest in self.filter and (held := self.content.get(digest)):
            held[0] += count
            if (-chars, id_) < (-held[1], held[2]):
                held[1:] = chars, id_
            return
        self.content[digest] = [count, chars, id_]
        if not self.filter.add(digest):
            self.filter = self.filter.grown(self.content)

    def put(self, digest: bytes, count: int, chars: int, id_: int) -> None:
        """What is left of a live digest after a deletion; with no row it goes."""
        if digest in self.filter and digest in self.content:
            if count:
                self.content[digest] = [count, chars, id_]
            else:
                del self.content[digest]
                self.filter.remove(digest)

    def probe(self, digest: bytes) -> list | None:
        return self.content.get(digest) if digest in self.filter else None

    def row(self, bucket: int) -> dict:
        numbers = np.array(list(self.content.values()), np.int64).reshape(-1, 3)
        rest = {k: [np.ascontiguousarray(numbers[:, i]).tobytes()] for i, k in enumerate(("counts", "chars", "ids"))}
        return {"bucket": [bucket], "size": [len(self.content)], "slots": [self.filter.slots.tobytes()], "digests": [b"".join(self.content)]} | rest


def _arrow(columns: dict, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and n_chars (code points of the original text) of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = [hashlib.sha256(x.as_buffer().to_pybytes().translate(None, DELETED)).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()), pa.compute.utf8_length(texts).cast(pa.int64())], names=["doc_id", "digest", "n_chars"])

    return null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _DIGESTS)


def _bucket(digest: str, buckets: int):
    """The bucket of a digest: its first seven bytes, most significant first."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _summed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows summed up by digest within a task: (bucket, digest, n, n_chars, doc_id)."""

    def out(held: dict) -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = {"bucket": [int.from_bytes(k[:7], "big") % buckets for k in keys], "digest": keys}
        columns |= {c: [v[i] for v in values] for i, c in enumerate(("n", "n_chars", "doc_id"))}
        return _arrow(columns, "bucket int, digest binary, n long, n_chars long, doc_id long").to_batches()[0]

    def run(batches):
        held: dict = {}
        for batch in batches:
            x = batch.to_pydict()
            for digest, chars, id_ in zip(x["digest"], x["n_chars"], x["doc_id"], strict=True):
                id_ = NO_ID if id_ is None else id_
                if (now := held.get(digest)) is None:
                    held[digest] = [1, chars, id_]
                else:
                    now[0] += 1
                    if (-chars, id_) < (-now[1], now[2]):
                        now[1:] = chars, id_
            if len(held) >= 200_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return rows.mapInArrow(run, "bucket int, digest binary, n long, n_chars long, doc_id long")


class CuckooIndex:
    """A distributed index; every method that changes it returns another index.

    ``state`` has a row for each bucket, ``rows`` the live rows (doc_id, digest, n_chars).
    """

    def __init__(self, state: DataFrame, rows: DataFrame, buckets: int):
        self.state, self.rows, self.buckets = state, rows, buckets

    @classmethod
    def empty(cls, spark, rows: int = 0) -> CuckooIndex:
        """An index meant for about ``rows`` digests; with more it is dealt to more buckets."""
        return cls(spark.createDataFrame([], _STATE), spark.createDataFrame([], _DIGESTS), max(16, rows // BUCKET_ROWS + 1))

    def _changed(self, summed: DataFrame, rows: DataFrame, change: str) -> CuckooIndex:
        def run(state: pa.Table, added: pa.Table) -> pa.Table:
            rows_ = state.to_pylist()
            bucket = Bucket(rows_[0] if rows_ else None)
            x = added.to_pydict()
            act = bucket.insert if change == "insert" else bucket.put
            for digest, n, chars, id_ in zip(x["digest"], x["n"], x["n_chars"], x["doc_id"], strict=True):
                act(digest, n, chars, id_)
            return _arrow(bucket.row(rows_[0]["bucket"] if rows_ else x["bucket"][0]), _STATE)

        new = self.state.groupBy("bucket").cogroup(summed.groupBy("bucket")).applyInArrow(run, _STATE)
        return CuckooIndex(table(new), rows, self.buckets)._resized()

    def _resized(self) -> CuckooIndex:
        """The same index in more buckets, where these hold too much."""
        held = self.state.agg(F.sum("size")).first()[0] or 0
        if held <= 2 * BUCKET_ROWS * self.buckets:
            return self
        buckets = held // BUCKET_ROWS + 1
        live = self.content().select(_bucket("digest", buckets).alias("bucket"), "digest", F.col("group_size").alias("n"), F.col("keep_chars").alias("n_chars"), F.col("keep_id").alias("doc_id"))
        return CuckooIndex(self.state.limit(0), self.rows, buckets)._changed(live, self.rows, "insert")

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """Add the rows (doc_id, digest, n_chars), a table that stays: it is read again by later deletions."""
        return self._changed(_summed(rows, self.buckets), self.rows.unionByName(rows.select(*self.rows.columns)), "insert")

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """Take rows off; of repeated rows as many go as are given, and rows that are not there are no matter."""
        keys = ["digest", "doc_id", "n_chars"]
        gone = rows.groupBy(*keys).agg(F.count("*").alias("gone"))
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
        held = self.rows.groupBy(*keys).agg(F.count("*").alias("n")).alias("l").join(gone.alias("g"), same, "left")
        live = table(held.select(*[f"l.{k}" for k in keys], (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0"))
        best = F.min(F.struct(-F.col("n_chars"), F.coalesce("doc_id", F.lit(NO_ID))))
        asked = rows.select("digest").distinct()
        left = live.join(asked, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"), best.alias("best"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        left = asked.join(left, "digest", "left").select(_bucket("digest", self.buckets).alias("bucket"), "digest", zero(F.col("n")).alias("n"), zero(-F.col("best.col1")).alias("n_chars"), zero(F.col("best.col2")).alias("doc_id"))
        each = live.select("doc_id", "digest", "n_chars", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
        return self._changed(left, each, "put")

    def content(self) -> DataFrame:
        """digest, group_size, keep_chars and keep_id of every live digest, as the filter finds it."""

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    bucket = Bucket(row)
                    found = [(k, *v) for k in bucket.content if (v := bucket.probe(k))]
                    columns = dict(zip(("digest", "group_size", "keep_chars", "keep_id"), zip(*found, strict=True), strict=True)) if found else {k: [] for k in ("digest", "group_size", "keep_chars", "keep_id")}
                    yield from _arrow(columns, "digest binary, group_size long, keep_chars long, keep_id long").to_batches()

        return self.state.mapInArrow(run, "digest binary, group_size long, keep_chars long, keep_id long")

    def probe(self, rows: DataFrame) -> DataFrame:
        """The rows with what the index holds of their digests; rows of no live digest have nulls."""
        return rows.join(self.content(), "digest", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars of every row, by a new index."""
    rows = table(digests(docs))
    index = CuckooIndex.empty(docs.sparkSession, rows.count()).insert(rows)
    keep = F.when(F.col("keep_id") == NO_ID, F.lit(None)).otherwise(F.col("keep_id"))
    found = index.probe(rows).withColumn("keep_id", keep)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def op5_cuckoo_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("n_chars")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
