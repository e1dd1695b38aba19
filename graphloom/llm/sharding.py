"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard follows from its key and the number of shards, without a table of the ring: with one more shard, the expected 1 / (n + 1) of
the keys move, all of them into the new shard. The hash is that of Lamping and Veach: a 64-bit linear congruential step for each jump. Spark's
bigints raise on overflow under ANSI rules, so the step is done on 32-bit halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import materialize

#: Fixed values of the published jump hash: the multiplier of its generator, as high and low 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
#: Rows that are numbered together within a shard; a power of two.
BLOCK_ROWS = 1 << 16


def _low32(x: Column, c: int) -> Column:
    """The low 32 bits of x * c, for x and c below 2^32."""
    return ((x.bitwiseAND(0xFFFF) * c) + F.shiftleft((F.shiftright(x, 16) * c).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2^64, on halves."""
    p = low.bitwiseAND(0xFFFF) * MULTIPLIER_LOW + 1
    q = F.shiftright(low, 16) * MULTIPLIER_LOW + F.shiftright(p, 16)
    up = F.shiftright(q, 16) + _low32(high, MULTIPLIER_LOW) + _low32(low, MULTIPLIER_HIGH)
    return up.bitwiseAND(0xFFFFFFFF), F.shiftleft(q.bitwiseAND(0xFFFF), 16).bitwiseOR(p.bitwiseAND(0xFFFF))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint key that isn't null.

    Each round jumps ahead at least one shard, so as many rounds as shards end every walk; a walk that has ended stays as it is.
    """
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(0xFFFFFFFF).alias("low"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next")
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        on = s["next"] < shards
        return F.struct(
            F.when(on, high).otherwise(s["high"]).alias("high"), F.when(on, low).otherwise(s["low"]).alias("low"), F.when(on, s["next"]).otherwise(s["shard"]).alias("shard"), F.when(on, ahead).otherwise(s["next"]).alias("next")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump, lambda s: s["shard"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard among `shards`, its place in the shard, and its shard among one more.

    Integer keys are hashed as they are, others by xxhash64. A null key counts as the hash of null, so all such rows share a shard. Size is the
    text's UTF-8 bytes plus one; a null text has size 1 and the CRC of no bytes. Repeated rows each get a place of their own. An empty table
    gives an empty result. Other columns aren't read, whatever their names.

    Places are numbered without bringing a shard together: the narrow rows are written once with their order of writing, counted by shard and
    block of that order, and numbered within blocks of at most BLOCK_ROWS rows.
    """
    k = F.col(key)
    whole = k.cast("long") if isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else F.xxhash64(k.cast("string"))
    whole = F.coalesce(whole, F.xxhash64(F.lit(None).cast("string")))
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        k.alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), jump_hash(whole, shards).alias("shard"), jump_hash(whole, shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("_at")
    )
    rows = materialize(narrow).withColumn("_block", F.shiftright("_at", BLOCK_ROWS.bit_length() - 1))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_at")) - 1)
    return inside.join(offsets, ["shard", "_block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_in")).alias("slot"), "grown_shard")
