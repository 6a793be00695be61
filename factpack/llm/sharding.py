"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size M in an order of its own: ``(offset + j * skip)
mod M``, offset and skip from two hashes of its name. Shards take turns; at its turn a shard claims
the first slot of its order that no one has. So shards own M / S slots each, to within one, and a
shard that comes or goes moves little more than its own share. A row is placed by the slot of its
key's hash: one broadcast look-up in M slots, whatever the number of rows (M is a parameter and the
bound of what is broadcast), no shuffle.

Everything is DataFrame functions: the table is an ``aggregate`` fold over M turns in one row.
Results: a null key is hashed like a value of its own; equal keys share a shard; texts, however long,
pass through; an empty table gives no rows; other columns are kept and can have any names but those that are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

SLOTS, SHARDS = 2039, 16


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table of ``slots`` (a prime) rows."""
    if slots < 2 or any(slots % x == 0 for x in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards must be distinct, one at least and no more than there are slots")
    m = F.lit(slots)
    offset = F.transform("names", lambda x: F.pmod(F.xxhash64(F.lit("offset"), x), m).cast("int"))
    skip = F.transform("names", lambda x: (F.pmod(F.xxhash64(F.lit("skip"), x), m - 1) + 1).cast("int"))
    one = spark.range(1).select(F.array(*[F.lit(x) for x in sorted(shards)]).alias("names")).withColumns({"offsets": offset, "skips": skip})

    def claim(state, turn):
        shard = turn % len(shards)
        at, step, owner = F.element_at("offsets", shard + 1), F.element_at("skips", shard + 1), state["owner"]
        # the places of the shard's order from where it stands, up to the first that is free
        begun = F.element_at(state["next"], shard + 1)
        free = F.filter(F.sequence(begun, begun + F.lit(WINDOW)), lambda j: F.element_at(owner, F.pmod(at + j.cast("long") * step, m).cast("int") + 1) < 0)
        rest = F.filter(F.sequence(begun, F.lit(slots - 1)), lambda j: F.element_at(owner, F.pmod(at + j.cast("long") * step, m).cast("int") + 1) < 0)
        j = F.when(F.size(free) > 0, F.element_at(free, 1)).otherwise(F.element_at(rest, 1))
        slot = F.pmod(at + j.cast("long") * step, m).cast("int")
        put = lambda array, place, value: F.concat(F.slice(array, 1, place), F.array(value), F.slice(array, place + 2, F.size(array)))
        return F.struct(put(owner, slot, shard.cast("int")).alias("owner"), put(state["next"], shard, (j + 1).cast("int")).alias("next"))

    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), len(shards)).alias("next"))
    filled = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, claim, lambda s: s["owner"])
    return one.select("names", filled.alias("owner")).select("names", F.posexplode("owner").alias("slot", "at")).select("slot", F.element_at("names", F.col("at") + 1).alias("shard"))


#: So many places of a shard's order are looked at before all the rest of it is.
WINDOW = 24


def shard(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with ``slot`` and ``shard`` of the column ``key``; columns of these names in df are replaced.

    A row travels as one struct, so that df's columns can have any names.
    """
    # exactly ``slots`` rows: a parameter bounds what is broadcast
    found = F.broadcast(lookup_table(df.sparkSession, shards, slots))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns if c not in ("slot", "shard")]).alias("row"), F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("at"))
    return rows.join(found, F.col("at") == F.col("slot")).select("row.*", "slot", "shard")


def op8_permutation_sharding(spark, sf_dir: str) -> DataFrame:
    names = [f"shard-{i:02d}" for i in range(SHARDS)]
    return shard(documents(spark, sf_dir).select("doc_id"), "doc_id", names)
