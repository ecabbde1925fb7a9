"""Bitmaps of a relation's edges: rows that no edge can close are dropped before they are shuffled.

Each edge sets one bit in each of two bitmaps of eight bits an edge, ``MOST_BITS`` at most, so they may be broadcast
however large the relation is. A row whose bits are set by other edges passes, one in eighty where the bitmaps have
their full size; the join that follows decides, so results do not depend on the bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap: 128 KiB to 32 MiB. A row of a bitmap has BUCKET of them.
LEAST_BITS, MOST_BITS, BUCKET = 2**20, 2**28, 2**15


def _places(src: Column, dst: Column, buckets: int) -> list[Column]:
    """Bucket and the place in it in each bitmap: different bits of one hash."""
    h = F.xxhash64(src, dst)
    return [h.bitwiseAND(F.lit(buckets - 1)), *[F.shiftrightunsigned(h, n).bitwiseAND(F.lit(BUCKET - 1)) for n in (16, 40)]]


def _words(bitmap: str) -> Column:
    """A bitmap's bytes, eight to a number: single numbers are read without a copy of the whole."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 64 - 1)), lambda i: F.conv(F.hex(F.substring(F.col(bitmap), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _set(words: str, place: str) -> Column:
    word = F.get(F.col(words), F.shiftright(place, 6).cast("int"))
    byte = F.shiftright(place, 3).bitwiseAND(F.lit(7))
    return F.getbit(word, (F.lit(56) - byte * 8 + F.col(place).bitwiseAND(F.lit(7))).cast("int")) == 1


def sieved(rows: DataFrame, a: str, b: str, edges: DataFrame, size: float) -> DataFrame:
    """``rows`` without most of those whose (a, b) is no (src, dst) of ``edges``, about ``size`` rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * max(1, int(size)) - 1).bit_length()))
    bucket, first, second = _places(F.col("src"), F.col("dst"), bits // BUCKET)
    keys = edges.select(bucket.alias("__bucket"), first.alias("p"), second.alias("q")).repartition("__bucket")
    maps = keys.groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("p"), F.bitmap_construct_agg("q").alias("q"))
    maps = maps.select("__bucket", _words("p").alias("__first"), _words("q").alias("__second"))
    columns = rows.columns
    bucket, first, second = _places(F.col(a), F.col(b), bits // BUCKET)
    met = rows.select("*", bucket.alias("__at"), first.alias("__p"), second.alias("__q")).join(F.broadcast(maps), F.col("__at") == F.col("__bucket"))
    return met.where(_set("__first", "__p") & _set("__second", "__q")).select(*columns)
