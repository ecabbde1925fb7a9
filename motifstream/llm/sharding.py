"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; there is no ring table. With one shard more, a row either stays or
moves into the new shard, and 1 / (n + 1) of the keys move. Every row also gets a slot, gapless within its shard, in the
order of the keys: rows are sorted by ranges of (shard, key, row), so that a hot key is cut apart too, and a slot is a
row's position in its range, behind those that earlier ranges hold of its shard. The table of these counts has a row
for each range and each shard in it.

A key of a whole-number type is its own hash input; any other is hashed to 64 bits. A null key is the key 0; equal keys
share a shard, so a key that repeats a lot makes its shard large, as the law asks. Repeated rows get slots of their own.
A null text counts as empty. An empty table gives an empty table. Columns of the input with the names of result columns
are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import forget, saved

def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. A key's jumps visit at most ``shards`` shards; about log(shards) on average."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard, jump = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        shard[active] = jump[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[active] = np.floor((shard[active] + 1) * (2.0**31 / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0)))
        active = active[jump[active] < shards]
    return shard


def hash_input(docs: DataFrame, key: str) -> Column:
    """The 64-bit number that a key is hashed by: itself where it is a whole number; 0 for null."""
    column = F.col(f"`{key}`")
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    return F.coalesce(column.cast("long") if whole else F.when(column.isNotNull(), F.xxhash64(column)), F.lit(0).cast("long"))


def shard_of(number: Column, shards: int) -> Column:
    """Shard of a 64-bit number; of null, that of 0."""

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return jumped(F.coalesce(number, F.lit(0).cast("long")))


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add slot bigint: 0, 1, ... within each shard, in the order of the columns ``order``. ``rows`` and their order are
    saved first, so slots do not change when tasks rerun."""
    rows = saved(rows.withColumn("__row", F.monotonically_increasing_id()))
    # The ids of a sorted table hold the range in their upper bits and the position in the lower ones.
    placed = saved(rows.orderBy(shard, *order, "__row").withColumn("__at", F.monotonically_increasing_id()).drop("__row"))
    forget(rows)
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy(shard, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("__shard"), F.col("__range").alias("__of"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    met = placed.join(first, (F.col(shard) == F.col("__shard")) & (F.col("__range") == F.col("__of")))
    return met.withColumn("slot", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shard", "__of", "__shift")


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the key alone unless given), size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    keep = [c for c in ([key] if keep is None else keep) if c not in own or c == key]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{key}`").alias("__key"),
        (F.octet_length(plain) + 1).cast("long").alias("size"),
        F.crc32(plain.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(hash_input(docs, key), shards).alias("shard"),
        shard_of(hash_input(docs, key), shards + 1).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["__key"])
    return out.select(*[F.col(f"`{c}`") for c in keep], "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """Write each row into the folder of its shard. No shuffle: every task writes to the shards that its rows need."""
    docs.withColumn("shard", shard_of(hash_input(docs, key), shards)).write.partitionBy("shard").parquet(path)
