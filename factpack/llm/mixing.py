"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash, form blocks of ``BLOCK`` documents. With target weight w
the block i (from 1) of a source is *released* at slot floor((i - 1) / w) and has its *deadline* at slot
ceil(i / w). At every slot the released block of the earliest deadline is taken (ties: the heavier
source, then the name). As the weights add up to one, every block lies between its release and its
deadline, so at every slot each source is less than one block from its share.

Weights are fractions of ``UNIT`` (largest remainders, one at least), and all times are whole numbers
from them, so nothing is rounded to a period. The schedule is cut into periods that are made at the same
time, one row each. Where a period begins, the blocks begun by then are given, and as many of them as
there are slots before are done, those of the earliest deadlines first: from there, earliest deadline first meets all
deadlines, so a first fold over the period before gives a state that can be both reached and left. A second
fold goes from one such state to the next. All rows are kept: a source that has run out leaves its
slots empty, and the others keep their rates to each other. A heavy source with a small weight makes
many periods: their number is that of the last deadline.

Only DataFrame functions are used. A document's rank in its source comes from ``_common.ranked``, which
never gathers a source in one task; slots reach the documents by a join on source and block.

Results: a null source is a source of its own; null and very long texts and repeated rows are documents
like others (a text is only hashed); sources without a target weight raise an error; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, ranked, table

BLOCK, PERIOD, POWER = 16, 1024, 0.5
#: Weights are whole numbers of this; below 2**32 slots, products of them and slots fit a long.
UNIT = 1 << 31


def natural_weights(docs: DataFrame, power: float = POWER) -> DataFrame:
    """(source, weight): the sources' numbers of documents to a power, so that small ones gain."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def given_weights(spark, weights: dict[str | None, float]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).cast("string").alias("source"), F.lit(float(v)).alias("weight")) for k, v in weights.items()])
    return spark.range(1).select(F.inline(rows))


def fractions(weights: DataFrame) -> DataFrame:
    """One row (or none): sources, heaviest first, and w, their weights in units that add up to UNIT."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("heavy"), F.coalesce("source", F.lit("")).alias("name"), "source")))
    one = weights.where("weight > 0").agg(rows.alias("rows"), F.sum("weight").alias("total")).where("size(rows) > 0")
    one = one.withColumn("exact", F.transform("rows", lambda x: -x["heavy"] / F.col("total") * UNIT))
    one = one.withColumn("floors", F.transform("exact", lambda x: F.greatest(F.floor(x).cast("long"), F.lit(1).cast("long"))))
    order = F.array_sort(F.transform("exact", lambda x, i: F.struct((F.floor(x) - x).alias("r"), i.alias("i"))))
    one = one.withColumn("more", F.lit(UNIT) - F.aggregate("floors", F.lit(0).cast("long"), lambda s, x: s + x))
    one = one.withColumn("lucky", F.transform(F.slice(order, F.lit(1), F.greatest(F.col("more"), F.lit(0)).cast("int")), lambda x: x["i"]))
    # units that very light sources got for nothing are the heaviest one's
    w = F.transform("floors", lambda x, i: x + F.when(F.array_contains("lucky", i), 1).otherwise(0) + F.when(i == 0, F.least("more", F.lit(0))).otherwise(0))
    return one.select(F.transform("rows", lambda x: x["source"]).alias("sources"), w.alias("w"))


def _release(done, w):
    return F.call_function("div", done * F.lit(UNIT), w)


def _deadline(done, w):
    return F.call_function("div", (done + 1) * F.lit(UNIT) + w - 1, w)


def _earliest_first(start: str, cap: str | None = None):
    """The fold over a period's slots from done blocks ``start``: done, and order (source i, block from 0) by slot."""

    def take(state, slot):
        def block(w, i):
            done = F.element_at(state["done"], i + 1)
            able = _release(done, w) <= slot
            if cap:
                able &= done < F.element_at(cap, i + 1)
            # a block of the period is due at its end
            due = F.least(_deadline(done, w), F.col("t") + F.col("size")) if cap else _deadline(done, w)
            return F.when(able, F.struct(due.alias("d"), i.alias("i"), done.alias("done")))

        best = F.array_min(F.transform("w", block))
        done = F.transform(state["done"], lambda x, i: F.when(i == best["i"], x + 1).otherwise(x))
        order = F.concat(state["order"], F.array(F.struct(best["i"].alias("i"), best["done"].alias("done")))) if cap else state["order"]
        return F.struct(done.alias("done"), order.alias("order"))

    first = F.struct(F.col(start).alias("done"), F.array().cast("array<struct<i:int,done:bigint>>").alias("order"))
    return F.aggregate(F.sequence("t", F.col("t") + F.col("size") - 1), first, take)


def slots(weights: DataFrame, last: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, block from 0, release, deadline, slot) up to the deadlines of the sources' ``last`` (source, blocks)."""
    spark = weights.sparkSession
    one = table(fractions(weights).withColumn("size", F.greatest(F.lit(period), F.size("w") * 4).cast("long")))
    each = one.select("size", F.inline(F.arrays_zip("sources", "w")))
    ends = each.join(last, F.col("sources").eqNullSafe(F.col("source"))).agg(F.max(_deadline(F.col("blocks") - 1, F.col("w"))), F.max("size")).first()
    periods = -(-(ends[0] or 0) // (ends[1] or 1))
    if periods * (ends[1] or 1) >= 1 << 32:
        raise ValueError("a source's weight is too small for its documents: 2**32 slots are the most")
    # begun blocks of the earliest deadlines are done at a period's begin
    at = spark.range(periods).crossJoin(F.broadcast(one)).withColumn("t", F.col("id") * F.col("size"))
    at = at.withColumn("floors", F.transform("w", lambda w: F.shiftright(w * F.col("t"), 31)))
    due = F.transform("w", lambda w, i: F.struct(_deadline(F.element_at("floors", i + 1), w).alias("d"), i.alias("i"), F.pmod(w * F.col("t"), F.lit(UNIT)).alias("part")))
    ahead = F.slice(F.array_sort(F.filter(due, lambda x: x["part"] > 0)), F.lit(1), (F.col("t") - F.aggregate("floors", F.lit(0).cast("long"), lambda s, x: s + x)).cast("int"))
    at = at.withColumn("ahead", F.transform(ahead, lambda x: x["i"]))
    at = at.withColumn("begin", F.transform("floors", lambda x, i: x + F.when(F.array_contains("ahead", i), 1).otherwise(0)))
    reached = table(at.select("id", "t", "size", "sources", "w", _earliest_first("begin")["done"].alias("end")))
    before = reached.select((F.col("id") + 1).alias("id"), F.col("end").alias("from"))
    both = reached.join(before, "id", "left").withColumn("from", F.coalesce("from", F.transform("w", lambda x: F.lit(0).cast("long"))))
    both = both.repartition(max(1, min(periods, 200)), "id").withColumn("order", _earliest_first("from", "end")["order"])
    rows = both.select("t", "sources", "w", F.posexplode("order").alias("at", "x"))
    w, done = F.element_at("w", F.col("x.i") + 1), F.col("x.done")
    return rows.select(F.element_at("sources", F.col("x.i") + 1).alias("source"), done.alias("block"), _release(done, w).alias("release"), _deadline(done, w).alias("deadline"), (F.col("t") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs with block (from 1), release, deadline and slot (the mixed order), and place in the block.

    Columns of these names in docs are replaced; a row travels as one struct, so any others can be there.
    """
    docs = docs.drop("block", "release", "deadline", "slot", "place")
    counts = table(docs.groupBy("source").agg(F.count("*").alias("n")))
    given = weights if weights is not None else counts.select("source", F.pow(F.col("n").cast("double"), F.lit(POWER)).alias("weight"))
    last = counts.select("source", F.ceil(F.col("n") / block).alias("blocks"))
    plan = table(slots(given, last, period).join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where("block < blocks").drop("_s", "blocks"))
    columns = [c for c in ("doc_id", "text") if c in docs.columns]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*columns).alias("key"), *[F.col(c).alias("id") for c in columns if c == "doc_id"], F.col("source").alias("of"))
    placed = ranked(rows, ["of"], [c for c in ("key", "id") if c in rows.columns], counts.agg(F.max("n")).first()[0] or 0)
    placed = placed.select("row", "of", F.floor(F.col("rank") / block).alias("at"), (F.col("rank") % block).alias("place"))
    out = placed.join(plan, F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("block")), "left")
    slot = F.when(F.col("slot").isNull(), F.raise_error(F.lit("a source has no target weight"))).otherwise(F.col("slot"))
    return out.select("row.*", (F.col("at") + 1).alias("block"), "release", "deadline", slot.cast("long").alias("slot"), "place")


def op2_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source"))
