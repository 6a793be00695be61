"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade from 0 to G - 1. One weight vector over hashed text features is shared by all
grades, and ordered thresholds t_1 < ... < t_(G-1) give ``P(grade >= j) = sigmoid(w . x - t_j)``, so
that a document gets its expected grade and the tail probability that selection uses.

Features are binary: the distinct lower-cased words of the whole text without the punctuation, the distinct
last two bytes of its words, and whether a word follows two equal ones, hashed into ``2 ** BITS`` places. A place has a weight other than 0 only if
``LEAST`` training texts have it, and the share of them at or above some grade is ``SCREEN`` standard
errors from that of all: rare and neutral words, of which a long text has many, add no noise. Training uses at most ``MAX_RATED`` rated documents, those of the least hash
of their id (a documented bound on a labelled sample; everything else covers all rows). The driver
fits them by full-batch gradient steps (Adam) with an L2 penalty; scoring is one pass without shuffle.

Ratings from ``labels(doc_id, quality, toxic)``: toxic 0, else poor quality 1, else 2; a document is
kept when P(grade >= 2) is at least one half. Null ratings are not used; without any rating every
document is kept with the top grade. A null text has no features and is scored by the thresholds
alone; the row keeps its null. A text of any length is read whole. Rows that repeat an id each get a row;
an id with several labels trains once for each. An empty ``documents`` gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import _text as T
from ._common import documents, drop, null_text, pieces, table

BITS, LEAST, SCREEN, MAX_RATED, GRADES = 18, 5, 5.0, 20_000, 3
STEPS, RATE, PENALTY = 150, 0.05, 2e-4


#: Bytes that are taken off either end of a word: ASCII punctuation.
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature places of each row, and len + 1 bounds into them."""
    words = T.Words(texts, lower=True)
    rows = len(words.offsets) - 1
    tails = words.data[words.end - 1].astype(np.uint64) << T.U(8)
    longer = words.end - words.start > 1
    tails[longer] |= words.data[words.end[longer] - 2]
    # words that follow two equal ones
    again = np.zeros(len(words.hash), bool)
    again[2:] = (words.hash[2:] == words.hash[1:-1]) & (words.hash[2:] == words.hash[:-2]) & (words.doc[2:] == words.doc[:-2])
    inner = T.Words(texts, lower=True, skip=_EDGE)
    runs = np.full(int(again.sum()), 1 << 41, np.uint64)
    places = np.concatenate([inner.hash, T.mix(tails + T.U(1 << 40)), T.mix(runs)]) >> T.U(64 - BITS)
    owner = np.concatenate([inner.doc, words.doc, words.doc[again]])
    keys = np.unique(owner.astype(np.int64) << BITS | places.astype(np.int64))
    return (keys & (1 << BITS) - 1).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(rows + 1))


def sums(places: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    held = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
    return held[bounds[1:]] - held[bounds[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade >= j) of each row, for j from 1 on."""
        return _sigmoid(sums(places, bounds, self.weights)[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, places: np.ndarray, bounds: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> OrdinalModel:
        """Maximum penalised likelihood; thresholds are a first one and positive gaps (their logs)."""
        size, rows = 1 << BITS, len(grades)
        held = np.bincount(places, minlength=size)
        apart = np.zeros(size)
        for j in range(1, n_grades):
            above = (grades >= j).astype(np.float64)
            pull = np.bincount(places, np.repeat(above - above.mean(), np.diff(bounds)), minlength=size)
            error = np.sqrt(np.maximum(held * (1 - held / rows) * above.var(), 1e-12))
            apart = np.maximum(apart, np.abs(pull) / error)
        used = (held >= LEAST) & (apart >= SCREEN)
        number = np.cumsum(used) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))[used[places]]
        column = number[places[used[places]]]
        share = np.clip(np.array([(grades >= j).mean() if rows else 0.5 for j in range(1, n_grades)]), 0.01, 0.99)
        start = np.log(1 - share) - np.log(share)
        gaps = np.log(np.maximum(np.diff(start), 0.1))
        x = np.concatenate([np.zeros(int(used.sum())), start[:1], gaps])
        n_words = int(used.sum())
        first, second = np.zeros_like(x), np.zeros_like(x)
        edge = lambda t, j: np.full(rows, 1.0) if j == 0 else np.zeros(rows) if j == n_grades else t[:, j - 1]
        for step in range(1, STEPS + 1):
            steps = np.exp(x[n_words + 1 :])
            thresholds = x[n_words] + np.concatenate([[0.0], np.cumsum(steps)])
            score = np.bincount(row, x[:n_words][column], minlength=rows)
            tail = _sigmoid(score[:, None] - thresholds[None, :])
            slope = np.concatenate([np.zeros((rows, 1)), tail * (1 - tail), np.zeros((rows, 1))], axis=1)
            edges = np.stack([edge(tail, j) for j in range(n_grades + 1)], axis=1)
            at = np.arange(rows)
            p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
            d_score = -(slope[at, grades] - slope[at, grades + 1]) / p / max(rows, 1)
            d_threshold = np.array([((grades == j) * slope[:, j] / p - (grades == j - 1) * slope[:, j] / p).sum() for j in range(1, n_grades)]) / max(rows, 1)
            gradient = np.concatenate([
                np.bincount(column, d_score[row], minlength=n_words) + PENALTY * x[:n_words],
                [d_threshold.sum()],
                steps * d_threshold[::-1].cumsum()[::-1][1:],
            ])
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            x = x - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(size, np.float32)
        weights[used] = x[:n_words]
        return cls(weights, x[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_words + 1 :]))]))


def rated(docs: DataFrame, labels: DataFrame, most: int = MAX_RATED, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of at most ``most`` rated documents, of the places that the screen leaves.

    Spark counts each place by grade, and screens places by the counts; only those left are gathered.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                places, bounds = features(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), found], names=["doc_id", "grade", "places"])

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).cast("int")
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null")
    some = some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)  # MAX_RATED rows at most: may be broadcast
    texts = null_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).join(F.broadcast(some), "doc_id")
    rows = table(texts.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, places array<int>"))
    above = [F.sum((F.col("grade") >= j).cast("double")).alias(f"n{j}") for j in range(1, grades)]
    total = rows.agg(F.count("*").alias("n"), *above).first()
    counts = rows.select("grade", F.explode("places").alias("place")).groupBy("place").agg(F.count("*").cast("double").alias("n"), *above)
    apart = F.lit(0.0)
    for j in range(1, grades):
        share = (total[f"n{j}"] or 0.0) / max(total["n"], 1)
        error = F.sqrt(F.greatest(F.col("n") * (1 - F.col("n") / max(total["n"], 1)) * (share * (1 - share)), F.lit(1e-12)))
        apart = F.greatest(apart, F.abs(F.col(f"n{j}") - F.col("n") * share) / error)
    used = table(counts.where((F.col("n") >= LEAST) & (apart >= SCREEN)).select("place"))  # 2 ** BITS places at most: may be broadcast
    kept = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "grade", F.explode_outer("places").alias("place"))
    kept = kept.join(F.broadcast(used.withColumn("used", F.lit(True))), "place", "left").groupBy("row", "doc_id", "grade").agg(F.array_sort(F.collect_list(F.when(F.col("used"), F.col("place")))).alias("places"))
    held = sorted((r["doc_id"], r["grade"], r["places"]) for r in kept.collect())
    drop(rows, used)
    places = np.array(list(itertools.chain.from_iterable(x for _, _, x in held)), np.int32)
    return places, np.concatenate([[0], np.cumsum([len(x) for _, _, x in held])]).astype(np.int64), np.array([g for _, g, _ in held], np.int64)


def classify(docs: DataFrame, labels: DataFrame, grade: int = 2, least: float = 0.5, rated_docs: DataFrame | None = None) -> DataFrame:
    """docs with expected_grade, tail_probability (of ``grade`` or better) and kept.

    Columns of these names in docs are replaced, all others stay as they are, whatever their names. The
    ratings' texts come from ``rated_docs`` (docs).
    """
    docs = docs.drop("expected_grade", "tail_probability", "kept")
    places, bounds, grades = rated(docs if rated_docs is None else rated_docs, labels)
    model = OrdinalModel.fit(places, bounds, grades) if len(grades) else OrdinalModel(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -50.0))
    # only weights other than 0 go to the tasks
    at = np.flatnonzero(model.weights)
    values, thresholds = model.weights[at], model.thresholds

    def run(batches):
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        model = OrdinalModel(weights, thresholds)
        for batch in batches:
            for part in pieces(batch, "text"):
                tails = model.tails(*features(part.column("text")))
                columns = [*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, grade - 1]), pa.array(tails[:, grade - 1] >= least)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "expected_grade", "tail_probability", "kept"])

    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in (("expected_grade", DoubleType()), ("tail_probability", DoubleType()), ("kept", BooleanType())))])
    return docs.mapInArrow(run, schema)


def op7_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "expected_grade", "tail_probability", "kept")
