"""Jump consistent hashing (Lamping and Veach, 2014): stable keys to shards without a ring table.

Null keys are one key like any other; equal keys share a shard. Texts may be null, empty or long: only their size and
checksum are used. Columns of the input other than the ones named stay out, so clashing names cannot arise.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ready, slots


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0 to shards - 1 of each unsigned 64-bit key.

    A key jumps from shard to shard; the next jump target follows from a linear congruential generator seeded by the
    key. With one more shard a key either stays or goes to the new one.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    here = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        here[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        reach = (here[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[live] = np.minimum(reach, 2.0**62).astype(np.int64)
        live = live[ahead[live] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column (any type); the key is hashed to 64 bits first, null included."""

    @F.pandas_udf("int")
    def jumps(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jumps(F.xxhash64(key))


def with_slots(rows: DataFrame, order: list[Column], blocks: int | None = None) -> DataFrame:
    """``rows`` with ``slot``: the gapless place, from 0, of a row in its shard.

    Rows of a shard are placed by a 64-bit hash and then by ``order``. Blocks of the hash range are numbered apart and
    moved by the counts of the blocks before them, so that no task holds a shard; their number does not change the
    result. The counts are shards x blocks rows.
    """
    bits = max(6, ((blocks or slots(rows.sparkSession, 4)) - 1).bit_length())
    names = rows.columns
    placed = rows.withColumn("_at", F.xxhash64(*order)).withColumn("_block", F.shiftright("_at", 64 - bits))
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy("_at", *order)
    return (
        placed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_block"])
        .select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: its shard, its gapless slot there, and its shard with one shard more.

    ``docs`` needs ``doc_id`` and ``text``. Law ``key``: doc_id and the number of shards decide alone. Repeated rows
    take slots of their own. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
