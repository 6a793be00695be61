"""N-gram Jaccard join by PartEnum signatures, exact at its threshold.

A document's set holds the distinct n-word shingles of its lower-cased words. Two sets link when
``100 * |A & B| >= percent * |A | B|``. Linked sets of a and b shingles differ in at most
``(a + b) * (100 - percent) / (100 + percent)`` shingles, so the join works on Hamming distance:

1. *Size bands.* A band's largest size is its least size over the threshold, so linked sets lie in one
   band or in two neighbouring ones. A set signs for its own band and for the next.
2. *Partition the feature domain.* For a band with distance k, the hash domain is cut into n1 ranges.
   A band of small k (up to ``ENUMERATED``) has n1 = 1 and n2 = 2k + 1 second-level ranges; it
   *enumerates* every subset that leaves k of them out. A larger band has n1 > k ranges, n2 = 1.
3. *Signatures.* A set signs the first ranges that hold a shingle of it, one more than its own largest
   distance to a linked set: a linked set differs in fewer of them, and so signs one of them alike.
   A set with too few such ranges also signs its empty ones. No linked pair is without a signature.
4. *Candidates.* Sets that share a signature are chained: each with its predecessor and with the first
   one, so a group of n sets gives 2n candidates, not n * n. A lower bound from parity sketches drops
   hopeless candidates; the rest are verified on the shingles of the texts themselves.
5. *What chains leave.* Members of one signature that lie in different components after that are
   compared in blocks by the same lower bound, all of them, and the survivors verified. So the
   components are exact, though copies and near copies never expand into all pairs.

Equal sets are one vertex throughout. Nulls: a null text is empty, an empty set links with nothing,
and a row with a null id links with nothing and has itself (null) as component. Rows that repeat an
id are one vertex with several sets.
"""

from __future__ import annotations

import itertools
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._common import documents, drop, null_text, pieces, release, table
from ._graph import components

WORDS, PERCENT = 5, 80
#: Up to this distance a band enumerates subsets of second-level ranges.
ENUMERATED = 3
#: Members of one signature that are compared at once; a larger group is compared by pairs of blocks.
BLOCK = 1024


def bands(percent: int, last: int) -> np.ndarray:
    """The least sizes of the bands, from 1 to beyond ``last``."""
    lows = [1]
    while lows[-1] <= last:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, np.int64)


def distance(a, b, percent: int):
    """The largest Hamming distance of linked sets of a and b shingles."""
    return (a + b) * (100 - percent) // (100 + percent)


def parameters(k: int) -> tuple[int, int, int]:
    """n1, n2 and the second-level ranges that a subset leaves out, for a band with distance k."""
    if k <= ENUMERATED:
        return 1, 2 * k + 1, k
    return k + 1 + k // 6 + 1, 1, 0


def signatures(one: np.ndarray, percent: int, lows: np.ndarray) -> np.ndarray:
    """The signatures of one sorted set of hashes."""
    size, out = len(one), []
    own = int(np.searchsorted(lows, size, side="right")) - 1
    for band in (own, own + 1):
        top = int(lows[band + 1]) - 1
        partner = min(top, size * 100 // percent)
        if band > own and partner < lows[band]:
            continue
        n1, n2, without = parameters(int(distance(top, top, percent)))
        ranges = n1 * n2
        place = ((one >> T.U(32)) * T.U(ranges)) >> T.U(32)
        tag = T.U(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if without or n1 == 1:
            sums = np.zeros(ranges, np.uint64)
            np.add.at(sums, place.astype(np.int64), T.mix(one))
            for left in itertools.combinations(range(n2), without):
                with np.errstate(over="ignore"):
                    total = sums.sum() - sums[list(left)].sum() if left else sums.sum()
                out.append(T.mix(np.array([total ^ tag], np.uint64) + T.U(1 + sum(1 << x for x in left))))
            continue
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        held = place[begins]
        needed = int(distance(size, partner, percent)) + 1
        sums = np.add.reduceat(T.mix(one), begins)[:needed]
        out.append(T.mix((sums ^ tag) + T.mix(held[:needed] + T.U(1))))
        if len(held) < needed:
            empty = np.setdiff1d(np.arange(ranges, dtype=np.uint64), held)
            out.append(T.mix(T.mix(empty + T.U(1)) ^ tag))
    return np.concatenate(out)


def sketch(one: np.ndarray) -> bytes:
    """The parity of the set's shingles in each of 2**p ranges of their low bits, 2**p > 2 * size."""
    width = max(64, 1 << int(2 * len(one)).bit_length())
    bits = np.bincount((one & T.U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _fold(bits: np.ndarray, to: int) -> np.ndarray:
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _hopeful(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the sets surely don't link: by their sizes, or by the parities that differ.

    Sketches of two widths compare after folding: a bit of the narrow one is the parity of bits of the
    wide one, as both take low bits. packbits keeps that order.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    to = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, to) ^ _fold(y, to)).sum()) <= distance(na, nb, percent)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, key (64 bits of it) and parity sketch of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                h, bounds = T.shingle_sets(part.column("text"), words)
                digests, sketches = [], []
                for a, b in itertools.pairwise(bounds.tolist()):
                    digests.append(blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    sketches.append(sketch(h[a:b]) if b > a else None)
                keys = [None if x is None else _key(x) for x in digests]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "key", "sketch"])

    docs = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, key long, sketch binary")


def sign(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(sig, key) for every signature of every set; a task leaves out sets that it has just signed."""

    def run(batches):
        lows, seen = bands(percent, 1 << 40), set()
        for batch in batches:
            for part in pieces(batch, "text"):
                h, bounds = T.shingle_sets(part.column("text"), words)
                sigs, keys = [], []
                for a, b in itertools.pairwise(bounds.tolist()):
                    if b > a and (key := _key(blake2b(h[a:b].tobytes(), digest_size=16).digest())) not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(key)
                        sigs.append(signatures(h[a:b], percent, lows))
                        keys.append(np.full(len(sigs[-1]), key, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    docs = null_text(docs.where("doc_id is not null").select("text"))
    return docs.mapInArrow(run, "sig long, key long")


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(sig, key, prev) of the signatures that two sets or more have, in the order of the keys.

    The window streams: it looks one row back or ahead and holds no group. A signature has one row of
    a set at most, of the hundreds that a set has, so that the most common one stays a small part.
    """
    by = Window.partitionBy("sig").orderBy("key")
    once = signed.withColumn("before", F.lag("key").over(by)).where("before is null or before != key")
    near = once.withColumn("prev", F.lag("key").over(by)).withColumn("next", F.lead("key").over(by))
    return near.where("prev is not null or next is not null").select("sig", "key", "prev")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that sizes and sketches allow."""

    def run(batches):
        for batch in batches:
            x = batch.to_pydict()
            keep = [_hopeful(*v, percent) for v in zip(x["sa"], x["sb"], x["na"], x["nb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts' sets link."""
    pairs = table(pairs)
    rep = sets.select("key", "rep")
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct().join(rep, "key")
    texts = null_text(docs.select(F.col("doc_id").cast("long").alias("rep"), "text")).join(needed.select("rep").distinct(), "rep", "left_semi")
    # the digest picks the right text where rows repeat an id
    texts = table(texts.dropDuplicates(["rep", "text"]).join(needed, "rep").select("key", "text"))

    def run(batches):
        for batch in batches:
            rows = max(1, min(256, T_ROWS(batch)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                (x, xb), (y, yb) = (T.shingle_sets(part.column(c), words) for c in ("ta", "tb"))
                keep = []
                for i in range(part.num_rows):
                    p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    side = lambda c: texts.select(F.col("key").alias(c), F.col("text").alias(f"t{c}"))
    linked = table(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())
    drop(pairs, texts)
    return linked


def T_ROWS(batch: pa.RecordBatch) -> int:
    """Rows of a batch of pairs to work on at once, so that their texts take some megabytes."""
    return int(batch.num_rows * (1 << 20) / max(1, batch.nbytes))


def _across(shared: DataFrame, sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """The plausible pairs of one signature whose sets are not in one component yet."""
    label = components(linked).select(F.col("a").alias("key"), F.col("b").alias("c"))
    known = shared.select("sig", "key").join(label, "key", "left").select("sig", "key", F.coalesce("c", "key").alias("c"))
    known = table(known)
    open_ = known.groupBy("sig").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    total = open_.agg(F.sum("n")).first()[0] or 0
    blocks = (F.col("n") / BLOCK).cast("int") + 1
    rows = known.join(open_.select("sig", blocks.alias("blocks")), "sig").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # a row goes to each pair of blocks that has its own: (i, j) with i <= j
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other")
    rows = rows.select("sig", "key", "c", "block", "blocks", other)
    # signatures with few members share a group, so that a group is a thousand rows or two (a sketch has kilobytes)
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("sig"), F.lit(1 + total // BLOCK))).otherwise(F.col("sig")).alias("cell")
    rows = rows.select(cell, "sig", "key", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(sets.select("key", "sketch", "n_shingles"), "key")

    def compare(key, c, block, n, raw, crossed):
        """Pairs of places in one signature's (part of a) group."""
        widths = np.array([len(s) for s in raw])
        for at in range(len(raw) - 1):
            ok = c[at + 1 :] != c[at]
            if crossed:
                ok &= block[at + 1 :] != block[at]
            ok &= 100 * np.minimum(n[at + 1 :], n[at]) >= percent * np.maximum(n[at + 1 :], n[at])
            some = at + 1 + np.flatnonzero(ok)
            for width in np.unique(widths[some]).tolist():
                those = some[widths[some] == width]
                to = min(width, int(widths[at]))
                theirs = _fold(np.frombuffer(b"".join([raw[k] for k in those]), np.uint8).reshape(len(those), width), to)
                apart = np.bitwise_count(theirs ^ _fold(np.frombuffer(raw[at], np.uint8), to)).sum(axis=1, dtype=np.int64)
                for k in those[apart <= distance(n[those], n[at], percent)].tolist():
                    yield (key[at], key[k]) if key[at] < key[k] else (key[k], key[at])

    def run(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("sig")
        sig, key, c, block, n, i, j = (cells.column(x).to_numpy() for x in ("sig", "key", "c", "block", "n_shingles", "i", "j"))
        raw, found = cells.column("sketch").to_pylist(), set()
        cuts = [0, *(np.flatnonzero(sig[1:] != sig[:-1]) + 1).tolist(), len(sig)]
        for a, b in itertools.pairwise(cuts):
            found.update(compare(key[a:b], c[a:b], block[a:b], n[a:b], raw[a:b], i[a] != j[a]))
        del raw, cells
        release()
        return pa.table({"a": pa.array([int(x) for x, _ in found], pa.int64()), "b": pa.array([int(x) for _, x in found], pa.int64())})

    return rows.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, described: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (key, digest, rep, n_shingles, sketch) and verified links (a, b) of keys.

    The links connect exactly the sets that the similarity graph connects; of a group of near copies
    they hold a spanning part, not every pair. ``described`` is ``describe(docs)``, as a table.
    """
    held = described.where("digest is not null and doc_id is not null")
    sets = table(held.groupBy("digest", "key", "n_shingles", "sketch").agg(F.min("doc_id").alias("rep")))
    shared = table(shared_signatures(sign(docs, words, percent)))
    first = shared.groupBy("sig").agg(F.min("key").alias("a"))
    first = shared.where("prev is not null").join(first, "sig").select("a", F.col("key").alias("b"))
    chained = shared.where("prev is not null").select(F.col("prev").alias("a"), F.col("key").alias("b"))
    pairs = _plausible(chained.union(first).distinct(), sets, percent)
    linked = _verified(pairs, sets, docs, words, percent)
    across = _plausible(_across(shared, sets, linked, percent), sets, percent)
    more = _verified(across, sets, docs, words, percent)
    drop(shared)
    return sets, linked.union(more)


def join_ngrams(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and n_links, per row.

    n_links counts the verified links at the row's set: links of a spanning part, see ``links``.
    """
    described = table(describe(docs, words))
    sets, linked = links(docs, described, words, percent)
    # rows that repeat an id with another text are one vertex: their sets are linked too
    ids = described.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("hi"))
    twins = described.join(ids.where("a != hi").select("doc_id", "a"), "doc_id").where("key is not null").select("a", F.col("key").alias("b"))
    label = components(linked.union(twins)).select(F.col("a").alias("key"), F.col("b").alias("c"))
    member = sets.select("key", "rep").join(label, "key", "left").select("key", "rep", F.coalesce("c", "key").alias("c"))
    least = member.groupBy("c").agg(F.min("rep").alias("least"))
    degree = linked.union(linked.select("b", "a")).groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n_links"))
    found = table(member.join(least, "c").select("key", "least").distinct().join(degree, "key", "left"))
    out = described.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    reached = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "doc_id"))
    alone = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0)))
    return out.select("doc_id", "n_shingles", reached.cast("long").alias("component_id"), alone.cast("long").alias("n_links"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_ngrams(documents(spark, sf_dir)).drop("n_links")


#: The same over whole tables; the recursion spreads ids along links, so it suits small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), c AS (
  SELECT g FROM e GROUP BY g HAVING count(*) > 1
), f AS (
  SELECT e.* FROM e JOIN c USING (g)
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.g = y.g AND x.doc_id <> y.doc_id AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN m ON m.a = s.doc_id
"""
