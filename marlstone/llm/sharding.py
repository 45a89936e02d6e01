"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, placed

#: Fixed values of the published generator: next = state * MULTIPLIER + 1 modulo 2^64.
MULTIPLIER = 2862933555777941757
MODULUS = 18446744073709551616


def stable_key(key: Column) -> Column:
    """The first 64 bits of the MD5 of the key's text, as an unsigned decimal; null counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shards(seed: Column, shards: int, grown: int) -> tuple[Column, Column]:
    """Shard of each seed among `shards` and among `grown` >= shards.

    A seed's jumps do not depend on the number of shards: its shard among n is the last jump below n. So one walk serves
    both counts, and a shard added at the end takes rows only into itself. A walk has at most `grown` jumps, because
    every jump goes up.
    """

    def step(acc: Column, _: Column) -> Column:
        state = ((acc["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")
        draw = (F.floor(state / F.lit("8589934592").cast("decimal(20,0)")) + 1).cast("double")
        jump = F.floor((acc["to"] + 1) * (F.lit(2147483648.0) / draw)).cast("bigint")
        going = acc["to"] < grown
        return F.struct(
            F.when(going, state).otherwise(acc["state"]).alias("state"),
            F.when(going, jump).otherwise(acc["to"]).alias("to"),
            F.when(going & (jump < shards), jump).otherwise(acc["small"]).alias("small"),
            F.when(going & (jump < grown), jump).otherwise(acc["large"]).alias("large"),
        )

    start = F.struct(seed.alias("state"), F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("small"), F.lit(0).cast("bigint").alias("large"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(grown)), start, step)
    return walk["small"].cast("int"), walk["large"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, text: str | None = None) -> DataFrame:
    """Shard, slot and grown shard of every row of df.

    Returns key, shard int, slot long (0, 1, ... in each shard), grown_shard int (with one more shard) and, if `text` is
    named, size long (its UTF-8 bytes plus 1; 1 for null) and text_crc32 long (that of the empty text for null).
    Only the key and the number of shards decide: equal keys meet in a shard, and a null key counts as the empty key.
    Repeated rows each get a slot. Other columns are not read, whatever their names; an empty table gives no rows.
    Texts are read once; what is known of each row is written to the shared folder. No shard or key is gathered in one
    task, even if all rows have the same key: slots come from runs of rows that one task wrote.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    out = [F.col(key).alias("key")]
    if text:
        data = F.coalesce(F.col(text), F.lit("")).cast("binary")
        out += [(F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")]
    small, large = jump_shards(stable_key(F.col("key")), shards, shards + 1)
    rows = df.select(*out).withColumn("_walk", F.struct(small.alias("s"), large.alias("g")))
    rows = rows.withColumns({"shard": F.col("_walk.s"), "grown_shard": F.col("_walk.g")}).drop("_walk")
    return number_within(placed(rows, "shards"), ["shard"], "slot").withColumnRenamed("key", key)
