"""Exact de-duplication by progressive refinement, with DataFrame functions only.

Rows are refined in three steps: by length, by a hash of the start of the text, by a hash of the whole text. A step
looks only at rows whose key of the step before came more than once. Which keys came more than once is held in a
bitmap of about eight bits a row, ``MOST_BITS`` at most, so it may be broadcast however large the corpus is; two keys on
one bit only mean that a few rows more go on to the next step, where the next key tells them apart. Texts are never shuffled: the
last step moves hashes and row numbers. The largest group may hold a third of the rows: groups are aggregated before
they are shuffled, and the join that brings each row its group is one that adaptive execution splits.

Texts are equal when they are identical after lower-casing A-Z only. Of equal texts the row with the largest key stays;
a null key is the smallest, and of repeated rows with one key exactly one stays. A null text counts as empty, so null
and empty texts form one group. An empty table gives an empty table. ``group_table`` returns its own columns only, and
``dedup`` exactly those of its input, so no name can clash; names that begin with two underscores are the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sizes of the bitmaps of repeated keys, in bits: 128 KiB to 128 MiB. Broadcast once for each of two steps.
LEAST_BITS, MOST_BITS = 2**20, 2**30
#: Characters that the second step hashes.
PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """A-Z in lower case. Where a text has ASCII only, lower() does the same faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: eight for each, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys - 1).bit_length())) if keys else LEAST_BITS


def repeated_bits(rows: DataFrame, key: Column, bits: int) -> DataFrame:
    """(__bucket, __bitmap) of the hash positions to which more than one row's key leads; at most bits / 8 bytes."""
    once = rows.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("p")).groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    return once.groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bitmap"))


def bits_of(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(__bucket, __bitmap) of the hash positions of all keys."""
    once = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("p")).distinct()
    return once.groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bitmap"))


def only_repeated(rows: DataFrame, key: Column, bitmaps: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add boolean ``flag``: whether the key's bit is set. The bitmaps are of bounded size and broadcast."""
    rows = rows.withColumn("__p", F.pmod(F.xxhash64(key), F.lit(bits)))
    rows = rows.withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(bitmaps), "__bucket", "left")
    position = F.bitmap_bit_position("__p")
    byte = F.conv(F.hex(F.substring("__bitmap", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn(flag, hit).drop("__p", "__bucket", "__bitmap")


def refined(docs: DataFrame, text: str, filter_bits: int | None) -> DataFrame:
    """``docs`` with boolean __again: whether a row's length and start came more than once (or share a bit that did).

    filter_bits: size of the bitmaps; from the number of rows unless given.
    """
    filter_bits = bits_for(docs.count()) if filter_bits is None else filter_bits
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    length, start = F.struct(F.octet_length(plain)), F.struct(F.octet_length(plain), normalised(F.substring(plain, 1, PREFIX_CHARS)))
    by_length = only_repeated(docs, length, repeated_bits(docs, length, filter_bits), filter_bits, "__again_length")
    left = by_length.where("__again_length")
    by_start = only_repeated(by_length, start, repeated_bits(left, start, filter_bits), filter_bits, "__again_start")
    return by_start.withColumn("__again", F.col("__again_length") & F.col("__again_start")).drop("__again_length", "__again_start")


def group_table(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int | None = None, hash_all: bool = False) -> DataFrame:
    """One row for every row: ``key``, keep_id, group_size, kept, content_hash (SHA-256 of the normalised text).

    content_hash is null where a step before the last set the row apart, unless ``hash_all``.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    full = F.sha2(normalised(F.col("__text")), 256)
    rows = refined(rows, "__text", filter_bits).select("__key", "__again", (full if hash_all else F.when(F.col("__again"), full)).alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    rows = saved(rows)  # keys, hashes and row numbers, a few dozen bytes a row; the numbers are fixed from here on
    again = rows.where("__again")
    groups = again.groupBy("__hash").agg(F.first("__hash").alias("__same"), F.count("*").alias("__n"), F.max(F.struct(F.col("__key").isNotNull().alias("known"), "__key", "__row")).alias("__best"))
    # The join is on another column than the aggregate's key: both sides are shuffled for it, so a hot group is split.
    groups = groups.where("__n > 1").select("__same", "__n", "__best")
    met = again.join(groups, F.col("__hash") == F.col("__same"), "left").select(
        F.col("__key").alias(key),
        F.when(F.col("__n").isNull(), F.col("__key")).otherwise(F.col("__best.__key")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__best.__row") == F.col("__row"), F.lit(True)).alias("kept"),
        F.col("__hash").alias("content_hash"),
    )
    alone = rows.where("NOT __again").select(F.col("__key").alias(key), F.col("__key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__hash").alias("content_hash"))
    return met.unionByName(alone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int | None = None) -> DataFrame:
    """``docs`` without its duplicates. Rows that are set apart early pass straight through; of each group one row is
    chosen before the shuffle and after it. Of rows with one key and text, that with the largest hash of all columns stays."""
    columns = docs.columns
    rows = refined(docs, text, filter_bits)
    order = F.struct(F.col(f"`{key}`").isNotNull(), F.col(f"`{key}`"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    again = rows.where("__again").select(F.sha2(normalised(F.col(f"`{text}`")), 256).alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__kept"), order.alias("__order"))
    best = again.groupBy("__hash").agg(F.max_by("__kept", "__order").alias("__kept")).select(*[F.col(f"__kept.`{c}`") for c in columns])
    return rows.where("NOT __again").select(*[F.col(f"`{c}`") for c in columns]).unionByName(best)
