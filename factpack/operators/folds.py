"""Ordered folds and picks: top-k, take-if-it-fits, and text assembled in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions import text as X


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key and task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


#: Probes and rows of a block: each pair of blocks is one task's group.
PROBE_BLOCK, ROW_BLOCK = 4096, 16384
#: Pairs that are bounded, and pairs that are worked out, at once.
_BOUNDED, _EXACT = 1 << 21, 1 << 16


def nearest(rows: DataFrame, id_: str, vector: str, probes: DataFrame, probe: str, probe_vector: str, k: int) -> DataFrame:
    """(probe, id, score): the k rows of the highest cosine for each probe of a stated set.

    Probes and rows are dealt into blocks of a bounded size that meet by their numbers, so neither side has to fit a task.
    Within a pair of blocks a product of matrices, with a bound on its rounding error, leaves the pairs that can be among a probe's
    first k; their cosines are worked out as ``text.cosine`` does, in its order, and k rows a probe go on to the last pick.
    A null vector has a null score, which comes last.
    """
    probes, rows = probes.select(probe, probe_vector), rows.select(id_, vector)
    n, m = 1 + probes.count() // PROBE_BLOCK, 1 + rows.count() // ROW_BLOCK
    deal = lambda df, key, blocks, mine, other, others: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = deal(rows.where(F.col(id_).isNotNull()), id_, m, "_row", "_probe", n)
    right = deal(probes.where(F.col(probe).isNotNull()), probe, n, "_probe", "_row", m)

    def run(r: pa.Table, p: pa.Table) -> pa.Table:
        if not r.num_rows or not p.num_rows:
            return pa.table({probe: r.column(id_).slice(0, 0) if not p.num_rows else p.column(probe).slice(0, 0), id_: r.column(id_).slice(0, 0), "score": pa.array([], pa.float64())})
        r = r.take(pa.compute.sort_indices(r.column(id_)))
        at, to, score = first_by_cosine(p.column(probe_vector), r.column(vector), p.column(probe), r.column(id_), k)
        return pa.table({probe: p.column(probe).take(at), id_: r.column(id_).take(to), "score": score})

    types = {c: t for df in (probes, rows) for c, t in df.dtypes}
    met = right.groupBy("_row", "_probe").cogroup(left.groupBy("_row", "_probe"))
    scored = met.applyInArrow(lambda p, r: run(r, p), f"`{probe}` {types[probe]}, `{id_}` {types[id_]}, score double")
    return top_k(scored, [probe], [F.col("score").desc(), F.col(id_)], k)


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of doubles (zeros behind the shorter ones), their lengths (-1: null), and whether an element is null."""
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pa.compute.fill_null(pa.compute.list_value_length(held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(held)
    gaps = pa.compute.is_null(flat).to_numpy(zero_copy_only=False)
    values = pa.compute.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    full = np.maximum(sizes, 0)
    out = np.zeros((len(sizes), max(1, int(full.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), full)
    column = np.arange(len(values)) - np.repeat(np.cumsum(full) - full, full)
    out[row, column] = values
    return out, sizes, np.bincount(row[gaps], minlength=len(sizes)) > 0


def first_by_cosine(probes: pa.ChunkedArray, vectors: pa.ChunkedArray, own: pa.ChunkedArray, ids: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of probes and vectors and their cosines, to six decimals: k pairs a probe, or all. Vectors are in the order of their ids."""
    (a, na, ga), (b, nb, gb) = _matrix(probes), _matrix(vectors)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    # a probe does not meet itself
    groups = pa.compute.dictionary_encode(pa.chunked_array([*ids.chunks, *own.cast(ids.type).chunks])).combine_chunks()
    code = groups.indices.to_numpy()
    mine, theirs = code[len(ids) :], code[: len(ids)]

    def norms(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for d in range(width):
            total += x[:, d] * x[:, d]
        return np.sqrt(total)

    with np.errstate(all="ignore"):
        la, lb = norms(a), norms(b)
        plain = lambda x, size, gap, n: (size >= 0) & ~gap & np.isfinite(x).all(axis=1) & (n > 1e-100) & (n < 1e100)
        fa, fb = plain(a, na, ga, la), plain(b, nb, gb, lb)
        ua = np.where(fa[:, None], a / la[:, None], 0).astype(np.float32)
        ub = np.where(fb[:, None], b / lb[:, None], 0).astype(np.float32)
        # twice the error of a product of unit vectors in single precision, and a unit of the sixth decimal
        margin = np.float32(2e-6 + 4 * (width + 4) * 2.0**-23)
        found = []
        step = max(1, _BOUNDED // max(1, len(b)))
        for start in range(0, len(a), step):
            rough = ua[start : start + step] @ ub.T
            rough[mine[start : start + step, None] == theirs[None, :]] = -np.inf
            # the k-th of the first vectors is a lower bound on the k-th of all
            some = rough[:, fb][:, : 64 * k] if not fb.all() else rough[:, : 64 * k]
            least = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - margin if some.shape[1] > k else np.full(len(rough), -np.inf, np.float32)
            able = (rough >= least[:, None]) | ~fb[None, :] | ~fa[start : start + step, None]
            i, j = np.nonzero(able)
            keep = mine[start + i] != theirs[j]
            i, j = start + i[keep], j[keep]
            score, void = np.zeros(len(i)), np.zeros(len(i), bool)
            for s in range(0, len(i), _EXACT):
                p, q = i[s : s + _EXACT], j[s : s + _EXACT]
                dot, x, y = np.zeros(len(p)), a[p], b[q]
                common = np.minimum(na[p], nb[q])
                for d in range(width):
                    dot += np.where(d < common, x[:, d] * y[:, d], 0.0)
                zero = ga[p] | gb[q] | (la[p] == 0) | (lb[q] == 0)
                score[s : s + _EXACT] = np.where(zero, 0.0, dot / (la[p] * lb[q]))
                void[s : s + _EXACT] = (na[p] < 0) | (nb[q] < 0)
            score[void] = 0.0
            whole = np.floor(np.abs(score) * 1e6)
            whole += np.abs(score) * 1e6 - whole >= 0.5
            score = np.copysign(whole, score) / 1e6 + 0.0
            # as Spark orders: NaN is the greatest, null the last
            order = np.lexsort((j, -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), void, i))
            rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            order = order[rank < k]
            found.append((i[order], j[order], score[order], void[order]))
    i, j, score, void = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, pa.array(score, mask=void)


def greedy_fit(df: DataFrame, keys: list[str], order: list[Column], item: str, cost: str, budget: int) -> DataFrame:
    """Items in order, each taken if it still fits its key's budget: (keys, item, running). No cost is negative.

    What is used only grows, so of the items of one cost c the taken ones are the first ones, budget / c
    at most: all others leave by a rank within (key, cost), of which Spark keeps ``budget`` rows a task before the
    shuffle. So few are left (budget * ln(budget) for a key, whatever its size) that an ordered aggregate folds them in
    one row. Items without cost are always taken; they look up how far the fold has come.
    """
    names = [f"_o{i}" for i in range(len(order))]
    given = df.select(*keys, *[c.alias(n) for n, c in zip(names, order, strict=True)], F.col(item).alias("item"), F.col(cost).cast("long").alias("cost"))
    rank = F.row_number().over(Window.partitionBy(*keys, "cost").orderBy(*names, "item"))
    able = given.where((F.col("cost") > 0) & (F.col("cost") <= budget)).withColumn("_rank", rank).where((F.col("_rank") <= budget) & (F.col("_rank") * F.col("cost") <= budget))
    place = F.struct(*names, "item")
    rows = able.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "cost"))).alias("rows"))
    kind = rows.schema["rows"].dataType.elementType["place"].dataType
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(ArrayType(StructType([StructField("place", kind), StructField("running", LongType())]))).alias("taken"))

    def step(state, row):
        used = state["used"] + row["cost"]
        taken = F.concat(state["taken"], F.array(F.struct(row["place"].alias("place"), used.alias("running"))))
        return F.when(used <= budget, F.struct(used.alias("used"), taken.alias("taken"))).otherwise(state)

    folded = rows.select(*keys, F.aggregate("rows", start, step, lambda s: s["taken"]).alias("taken"))
    picked = folded.select(*keys, F.inline("taken")).select(*keys, F.col("place.item").alias(item), "running")
    free = given.where("cost = 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], place.alias("_place"), "item")
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    before = F.array_max(F.transform(F.filter("taken", lambda x: x["place"] < F.col("_place")), lambda x: x["running"]))
    beside = free.join(folded, same, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("item").alias(item), F.coalesce(before, F.lit(0)).cast("long").alias("running"))
    return picked.unionByName(beside)


def assemble(df: DataFrame, keys: list[str], section: str, order: list[str], content: str, title: str = "# Context") -> DataFrame:
    """A text for each key: its sections in order, each with its contents in order.

    A document is one string, as its reader takes it; packs keep it to a token budget.
    """
    parts = df.groupBy(*keys, section).agg(F.array_sort(F.collect_list(F.struct(*order, content))).alias("rows"))
    body = F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.array_join(F.col(f"rows.{content}"), "\n"))
    whole = parts.select(*keys, section, body.alias("body")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(section, "body"))).alias("parts"))
    return whole.select(*keys, F.concat(F.lit(title + "\n"), F.array_join("parts.body", "\n\n")).alias("document"))


#: Words of a long phrase's key, and characters of a short one's.
KEY_WORDS, KEY_CHARS = 4, 3


def phrases(items: DataFrame, item: str, phrase: str, docs: DataFrame, doc: str, body: str) -> DataFrame:
    """(item, doc, phrase, body) of the phrases that a body contains; an empty phrase is in every body.

    Not a theta join. A phrase's first word may begin, and its last may end, inside a body's word, so its inner
    words are its key: ``KEY_WORDS`` of them, or one. A phrase without an inner word has its first ``KEY_CHARS``
    characters as its key, and bodies give their distinct windows of as many; shorter ones are keyed by all of
    their characters. A body gives only windows that some phrase's kind of key needs. Where keys meet, the phrase is looked for.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    p, n = F.col(phrase), F.size(words(F.col(phrase)))
    kind = F.when(n >= KEY_WORDS + 2, "w4").when(n >= 3, "w1").otherwise(F.concat(F.lit("c"), F.least(F.length(p), F.lit(KEY_CHARS)).cast("string")))
    inner = F.when(n >= KEY_WORDS + 2, KEY_WORDS).otherwise(1)
    key = F.when(n >= 3, F.array_join(F.slice(words(p), F.lit(2), inner), " ")).otherwise(F.substring(p, 1, KEY_CHARS))
    keyed = items.select(item, phrase, F.concat_ws(":", kind, key).alias("_key"), kind.alias("_kind")).where(p.isNotNull())
    kinds = {r[0] for r in keyed.select("_kind").distinct().collect()}  # six at most
    b = F.col(body)
    chars = lambda k: F.regexp_extract_all(b, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    windows = {"w4": X.ngrams(words(b), KEY_WORDS), "w1": words(b), "c0": F.array(F.lit(""))} | {f"c{k}": chars(k) for k in range(1, KEY_CHARS + 1)}

    def tagged(k: str) -> Column:
        return F.transform(F.array_distinct(windows[k]), lambda x: F.concat(F.lit(f"{k}:"), x))

    given = [tagged(k) for k in sorted(kinds)]
    if not given:
        return items.join(docs).where(F.lit(False)).select(item, doc, phrase, body)
    grams = docs.where(b.isNotNull()).select(doc, F.explode(F.concat(*given)).alias("_key"))
    hits = grams.join(keyed.select(item, "_key"), "_key").select(item, doc).distinct()
    return hits.join(items, item).join(docs, doc).where(F.contains(body, p)).select(item, doc, phrase, body)
