"""Expressions over the columns of embeddings: images m0, m1, .. and edge batches b0, b1, .."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.pattern import Pattern


def edge_key(a: Column, b: Column) -> Column:
    """An undirected edge as a value that compares by (smaller id, larger id)."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def latest(columns: list[str]) -> Column:
    """The largest of the batches."""
    return F.col(columns[0]) if len(columns) == 1 else F.greatest(*map(F.col, columns))


def seed_edge(pattern: Pattern, batch: Column) -> Column:
    """The pattern edge whose image is the smallest among the edges that are new in ``batch``."""
    each = [F.struct(edge_key(F.col(f"m{u}"), F.col(f"m{w}")).alias("key"), F.lit(i).alias("edge"), F.col(f"b{i}").alias("of")) for i, (u, w, _) in enumerate(pattern.edges)]
    return F.array_min(F.filter(F.array(*each), lambda x: x["of"] == batch))["edge"]


def batch_of_month(day: Column, start: int) -> Column:
    """0 before January of ``start`` or without a date, then the number of the month."""
    months = ((F.year(day) - start) * 12 + F.month(day)).cast("int")
    return F.when(day.isNull() | (F.year(day) < start), F.lit(0)).otherwise(months)
