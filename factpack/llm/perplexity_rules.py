"""Quality rules by n-gram perplexity, beside plain rules on words.

The language model is modified Kneser-Ney over n-grams of ``ORDER`` code points, as they are: no letter,
case or script is folded into another, so what the model gathers grows with the corpus. A document is
scored by the other half of its language's documents: texts are dealt into two folds by a hash (of
their characters but white space, so that copies share a fold), and each fold is the model of the
other. A text's own n-grams tell nothing about it, so gibberish stays surprising however much of it there is.

1. *Counting.* Documents of a language and fold form blocks of some megabytes by a hash. A block gives its distinct n-grams with
   their numbers; Spark sums them up by language and fold. Lower orders count the distinct histories
   of their n-grams, one aggregation each.
2. *Smoothing* runs over distinct n-grams, order by order: sums over an n-gram's context (a window of as
   many rows as there are characters that follow it) give discounts and back-off weights, and a join on its
   suffix the lower order's probability. Discounts come from the counts of counts by language and fold.
3. *Sorted hash arrays.* The surprises, -log p, of all n-grams are stored as a table of parts: the hashes of a range
   in order, and their surprises beside them. A part is a bounded range, so the arrays grow by parts.
4. *Scoring.* A block's n-grams are looked up in the parts, and the block's texts meet the answers, which
   come in the order of the block's own hashes. A document's score is the mean surprise of its code points.

Neither the model nor a language is ever in one task or on the driver. The middle and the spread (median absolute
deviation) of each language's scores, over the documents that pass the plain rules, give the
language's lower and upper band, ``LOWER`` robust deviations below the middle and ``UPPER`` above; a document beyond
its band is rejected. Scores are gathered as histograms of ``CELL`` wide cells. Languages are
two-letter codes and ``und`` for all else: 677 at most. One with fewer than ``LEAST_DOCS`` documents that pass has no bands.

Results: a null text has no words; it fails the plain rules (fewer than 50 words). A null or odd
language is ``und``. Very long texts are read whole. Rows with equal ids each get a row; an empty table gives none.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._common import documents, drop, null_text, pieces, table

ORDER = 5
#: Bits of a code point, and all there can be: the lowest order spreads its weight over them evenly.
BITS, ALPHABET = 21, 0x110000
#: Robust deviations from a language's middle to its bands: 3.5 is the usual bound of outliers by median and MAD.
LOWER, UPPER, CELL, CELLS = 3.5, 3.5, 0.005, 4000
LEAST_SPREAD, LEAST_DOCS = 0.02, 100
#: Bytes of text of a block, about, and n-grams of a part of the sorted arrays.
BLOCK_BYTES, PART_ROWS = 16 << 20, 1 << 18
#: Bytes of text that are in arrays at once; a code point takes some 100 bytes there.
PIECE_BYTES = 1 << 19
_SPREAD, _SPREAD_LOW = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "#*$%&|<>"]] = True


def language(column: str = "lang"):
    low = F.lower(F.col(column))
    return F.when(low.rlike("^[a-z]{2}$"), low).otherwise(F.lit("und"))


class Grams:
    """The n-gram that ends at each code point of a column of texts (zeros stand before a text).

    ``hi`` has its first three code points and ``lo`` its last two; ``bounds`` has len + 1 places;
    ``key`` is the hash of each n-gram with the language and the fold of the texts.
    """

    def __init__(self, texts: pa.Array, lang: str, fold: int):
        data, offsets = T.buffer(texts)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        starts, sizes = self.bounds[:-1], np.diff(self.bounds)

        def behind(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros_like(values)
            out[k:] = values[:-k] if len(values) > k else 0
            for j in range(k):
                out[starts[sizes > j] + j] = 0
            return out

        self.lo = behind(codes, 1) << T.U(BITS) | codes
        self.hi = behind(codes, 4) << T.U(2 * BITS) | behind(self.lo, 2)
        tag = T.mix(np.array([int.from_bytes(lang.encode(), "little") * 2 + fold + 1], np.uint64))
        self.key = T.mix(self.hi * T.U(_SPREAD) + self.lo * T.U(_SPREAD_LOW) + tag)


class SortedKeys:
    """A sorted array of distinct hashes: a hash is looked for from where its upper bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, len(keys).bit_length())
        self.first = np.searchsorted(keys >> T.U(64 - self.bits), np.arange(1 << self.bits, dtype=np.uint64))

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The places of hashes that are all there."""
        at = self.first[wanted >> T.U(64 - self.bits)]
        left = np.flatnonzero(self.keys[at] != wanted)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != wanted[left]]
        return at


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and the place among them of each given one."""
    ordered = np.sort(keys)
    ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered
    which = SortedKeys(ordered).places(keys) if len(ordered) else np.zeros(0, np.int64)
    at = np.zeros(len(ordered), np.int64)
    at[which] = np.arange(len(keys))
    return ordered, at, which


def fold(column: str = "text"):
    """0 or 1: texts that are alike but for white space share a fold."""
    return F.xxhash64(F.translate(F.col(column), " \t\n\x0b\x0c\r", "")).bitwiseAND(F.lit(1)).cast("int")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, fold, text and block of every row; a block is of one language and fold, and some megabytes."""
    docs = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("lang"), "text")).withColumn("fold", fold())
    # a row for each language and fold: 1,354 at most
    sizes = sorted(docs.groupBy("lang", "fold").agg(F.sum(F.octet_length("text"))).collect())
    most = min(BLOCK_BYTES, 1 + sum(r[2] for r in sizes) // (2 * docs.sparkSession.sparkContext.defaultParallelism))
    first, held = 0, []
    for lang, f, size in sizes:
        n = 1 + size // most
        held += [F.lit(f"{lang}{f}"), F.array(F.lit(first).cast("long"), F.lit(n).cast("long"))]
        first += n
    if not held:
        return docs.withColumn("block", F.lit(0).cast("long"))
    of = F.element_at(F.create_map(*held), F.concat("lang", F.col("fold").cast("string")))
    return docs.withColumn("of", of).withColumn("block", F.col("of")[0] + F.pmod(F.xxhash64("doc_id", "text"), F.col("of")[1])).drop("of")


def count_grams(dealt: DataFrame) -> DataFrame:
    """(lang, fold, hi, lo, key, n, block): the distinct n-grams of each block."""

    def summed(found: list[tuple]) -> tuple:
        """Distinct keys with hi, lo and the sum of n."""
        keys, hi, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, at, which = distinct(keys)
        return keys, hi[at], lo[at], np.bincount(which, n, minlength=len(at)).astype(np.int64)

    def run(rows: pa.Table) -> pa.Table:
        lang, f, block = (rows.column(c)[0].as_py() for c in ("lang", "fold", "block"))
        found, held = [], 0
        for batch in rows.to_batches():
            for part in pieces(batch, "text", PIECE_BYTES):
                g = Grams(part.column("text"), lang, f)
                found.append(summed([(g.key, g.hi, g.lo, np.ones(len(g.key), np.int64))]))
                held += len(found[-1][0])
                if held > 1 << 20:
                    found, held = [summed(found)], 0
        keys, hi, lo, n = summed(found)
        same = {"lang": pa.array([lang] * len(keys), pa.string()), "fold": np.full(len(keys), f, np.int32)}
        return pa.table(same | {"hi": hi.view(np.int64), "lo": lo.view(np.int64), "key": keys.view(np.int64), "n": n, "block": np.full(len(keys), block, np.int64)})

    return dealt.groupBy("block").applyInArrow(run, "lang string, fold int, hi long, lo long, key long, n long, block long")


def _below(level: DataFrame, n: int) -> DataFrame:
    """The types of order n - 1: each counts its distinct histories, in either fold."""
    keep = max(0, n - 3)  # code points of hi that stay
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * keep) - 1)) if keep else F.lit(0).cast("long")
    lo = F.col("lo") if n > 2 else F.col("lo").bitwiseAND(F.lit((1 << BITS) - 1))
    count = lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(c)
    return level.groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(count("n0"), count("n1"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(found))


def _discounts(levels: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """Of each order: (lang, d01, d02, d03, d11, d12, d13), the discounts by fold; 677 languages at most."""
    spark = levels[1].sparkSession
    count = [F.count(F.when(F.col(f"n{f}") == i, 1)).alias(f"c{f}{i}") for f in (0, 1) for i in (1, 2, 3, 4)]
    every = [x.groupBy("lang").agg(F.lit(n).alias("order"), *count) for n, x in levels.items()]
    rows = every[0]
    for x in every[1:]:
        rows = rows.union(x)
    found: dict[int, list] = {n: [] for n in levels}
    for r in rows.collect():
        found[r["order"]].append((r["lang"], *[x for f in (0, 1) for x in discounts(*[r[f"c{f}{i}"] for i in (1, 2, 3, 4)])]))
    schema = "lang string, " + ", ".join(f"d{f}{i} double" for f in (0, 1) for i in (1, 2, 3))
    return {n: F.broadcast(spark.createDataFrame(x, schema)) for n, x in found.items()}


def surprises(grams: DataFrame) -> DataFrame:
    """(lang, hi, lo, p0, p1): the probability of each n-gram's last code point in a document of fold 0, and of fold 1."""
    of = lambda f: F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}")
    levels = {ORDER: table(grams.groupBy("lang", "hi", "lo").agg(of(0), of(1)))}
    for n in range(ORDER, 1, -1):
        levels[n - 1] = table(_below(levels[n], n))
    held = _discounts(levels)
    below = None
    for n in range(1, ORDER + 1):
        # the context: all but the last code point
        context = Window.partitionBy("lang", "hi", F.shiftright("lo", BITS))
        x = levels[n].join(held[n], "lang")
        for f in (0, 1):
            c = F.col(f"n{f}")
            taken = F.when(c == 0, 0.0).when(c == 1, F.col(f"d{f}1")).when(c == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3"))
            x = x.withColumns({f"t{f}": F.sum(c).over(context), f"g{f}": F.sum(taken).over(context), f"a{f}": c - taken})
        if below is None:
            x = x.withColumns({"q0": F.lit(1 / ALPHABET), "q1": F.lit(1 / ALPHABET)})
        else:
            keep = max(0, n - 3)
            hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * keep) - 1)) if keep else F.lit(0).cast("long")
            lo = F.col("lo") if n > 2 else F.col("lo").bitwiseAND(F.lit((1 << BITS) - 1))
            lower = below.select("lang", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            x = x.withColumns({"_hi": hi, "_lo": lo}).join(lower, ["lang", "_hi", "_lo"])
        # fold 0 is scored by the counts of fold 1, and the other way round
        p = {f: F.when(F.col(f"t{g}") > 0, (F.col(f"a{g}") + F.col(f"g{g}") * F.col(f"q{f}")) / F.col(f"t{g}")).otherwise(F.col(f"q{f}")) for f, g in ((0, 1), (1, 0))}
        below = table(x.select("lang", "hi", "lo", p[0].alias("p0"), p[1].alias("p1")))
    drop(*levels.values())
    return below


def _part(parts: int):
    """The part of a key: equal ranges of its upper bits."""
    return F.shiftright(F.shiftrightunsigned("key", 32) * parts, 32).cast("int").alias("part")


def arrays(grams: DataFrame, parts: int) -> DataFrame:
    """(part, keys, values): the hashes of a range in order, and their surprises, as binary columns."""
    said = surprises(grams)
    p = F.when(F.col("fold") == 0, F.col("p0")).otherwise(F.col("p1"))
    each = grams.select("lang", "fold", "hi", "lo", "key").distinct().join(said, ["lang", "hi", "lo"]).select("key", (-F.log(p)).cast("float").alias("s"))

    def run(rows: pa.Table) -> pa.Table:
        keys, values = rows.column("key").to_numpy().view(np.uint64), rows.column("s").to_numpy()
        order = np.argsort(keys)
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "keys": pa.array([keys[order].tobytes()], pa.binary()), "values": pa.array([values[order].tobytes()], pa.binary())})

    return each.select(_part(parts), "key", "s").groupBy("part").applyInArrow(run, "part int, keys binary, values binary")


def answers(grams: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """(block, part, values): the surprises of each block's n-grams in the order of their hashes, looked up part by part.

    A block has its own n-grams, so the hashes need not travel back.
    """

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        blocks_, wanted = asked.column("block").to_numpy(), asked.column("key").to_numpy().view(np.uint64)
        keys, values = (np.frombuffer(held.column(c)[0].as_py(), t) for c, t in (("keys", np.uint64), ("values", np.float32)))
        order = np.lexsort((wanted, blocks_))
        found = values[SortedKeys(keys).places(wanted[order])]
        each, first = np.unique(blocks_[order], return_index=True)
        ends = [*first[1:].tolist(), len(found)]
        raw = [found[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)]
        return pa.table({"block": each, "part": np.full(len(each), held.column("part")[0].as_py(), np.int32), "values": pa.array(raw, pa.binary())})

    asked = grams.select(_part(parts), "block", "key")
    return model.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, "block long, part int, values binary")


def word_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    words = T.Words(texts)
    rows = len(words.offsets) - 1
    data, offsets = words.data, words.offsets
    of = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    out = {"n_words": np.diff(words.bounds)}
    out["word_chars"] = of(~T.SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = of(_PUNCTUATION[data])
    h, at = words.windows(3)
    key = T.mix(h + words.doc[at].astype(np.uint64) * T.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(key), bool)
    if len(key):
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    again = at[order[same]]
    covered = np.zeros(len(words.start) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(words.doc[covered[: len(words.start)]], minlength=rows) if len(words.start) else np.zeros(rows, np.int64)
    dup = np.zeros(rows, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if "\n" in text:
            seen = set()
            for line in text.split("\n"):
                if line in seen:
                    dup[i] += bool(line.strip(" \t\n\v\f\r"))
                else:
                    seen.add(line)
    out["n_dup_lines"] = dup
    return out


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the measures of words, and the mean surprise (null: empty text), as a table."""
    dealt = blocks(docs)
    grams = table(count_grams(dealt))
    parts = int(1 + grams.count() // PART_ROWS)
    model = table(arrays(grams, parts))
    said = table(answers(grams, model, parts))
    drop(grams, model)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        lang, f = rows.column("lang")[0].as_py(), rows.column("fold")[0].as_py()
        held, out = [np.zeros(0, np.uint64)], []
        for batch in rows.to_batches():
            for part in pieces(batch, "text", PIECE_BYTES):
                held.append(distinct(Grams(part.column("text"), lang, f).key)[0])
                if sum(map(len, held)) > 1 << 20:
                    held = [np.unique(np.concatenate(held))]
        # the answers follow the hashes: parts are ranges of them, in order
        keys = SortedKeys(np.unique(np.concatenate(held)))
        said_ = sorted(zip(found.column("part").to_pylist(), found.column("values").to_pylist(), strict=True))
        values = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(x, np.float32) for _, x in said_]])
        for batch in rows.to_batches():
            for part in pieces(batch, "text", PIECE_BYTES):
                texts = part.column("text")
                g = Grams(texts, lang, f)
                total = np.concatenate([[0.0], np.cumsum(values[keys.places(g.key)], dtype=np.float64)])
                sizes = np.diff(g.bounds)
                mean = np.diff(total[g.bounds]) / np.maximum(sizes, 1)
                measures = word_measures(texts)
                out.append(pa.table({"doc_id": part.column("doc_id"), "lang": part.column("lang")} | {k: measures[k].astype(np.int64) for k in _MEASURES} | {"surprise": pa.array(mean, mask=sizes == 0)}))
        return pa.concat_tables(out)

    scored = table(dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(run, "doc_id long, lang string, " + ", ".join(f"{k} long" for k in _MEASURES) + ", surprise double"))
    drop(said)
    return scored


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> dict[str, tuple[float, float]]:
    """Each language's lowest and highest surprise, from a histogram of the documents that pass."""
    cell = F.least(F.lit(CELLS - 1), (F.col("surprise") / CELL).cast("int")).alias("cell")
    counts: dict[str, np.ndarray] = {}
    for row in scored.where("not base_failed and surprise is not null").groupBy("lang", cell).count().collect():
        counts.setdefault(row["lang"], np.zeros(CELLS, np.int64))[row["cell"]] = row["count"]
    out, middles = {}, (np.arange(CELLS) + 0.5) * CELL
    median = lambda values, n: float(values[np.searchsorted(np.cumsum(n), n.sum() / 2)])
    for lang, n in counts.items():
        if n.sum() < LEAST_DOCS:
            continue
        middle = median(middles, n)
        apart = np.abs(middles - middle)
        order = np.argsort(apart, kind="stable")
        spread = max(LEAST_SPREAD, 1.4826 * median(apart[order], n[order]))
        out[lang] = middle - lower * spread, middle + upper * spread
    return out


def judge(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """doc_id, the measures, base_failed, kept, perplexity and the language's bands, per row."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = score(docs).withColumn("base_failed", failed)
    found = bands(scored, lower, upper)
    both = F.create_map(*[F.lit(x) for k, (lo, hi) in found.items() for x in (k, [lo, hi])]) if found else None
    band = F.element_at(both, F.col("lang")) if found else F.lit(None).cast("array<double>")
    out = scored.withColumn("band", band)
    inside = F.coalesce(F.col("surprise").between(F.col("band")[0], F.col("band")[1]), F.lit(True))
    return out.select("doc_id", *_MEASURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.exp("surprise").alias("perplexity"), F.exp(F.col("band")[0]).alias("lowest"), F.exp(F.col("band")[1]).alias("highest"))


def op6_perplexity_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
