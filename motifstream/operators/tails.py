"""Trailing leaves of a matching order: counted, expanded, or counted without being expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.planner import Plan, plan
from ..sources.graph import Graph
from .matching import grow, seeds


def core(graph: Graph, pattern: Pattern, order: Plan) -> DataFrame:
    """Embeddings of the pattern without its trailing leaves."""
    relation = lambda a, b: graph.relation(pattern.triple(a, b))
    rows = seeds(pattern, relation, *order.seed, "none")
    return grow(rows, pattern, order.steps[: order.tail - 2], relation, list(order.seed), "none")


def tail_cardinality(graph: Graph, pattern: Pattern, order: Plan | None = None) -> DataFrame:
    """Core embeddings and n: the product of the leaves' numbers of neighbours, before images are asked to differ."""
    order = order or plan(pattern, leaves_last=True)
    rows = core(graph, pattern, order).withColumn("n", F.lit(1).cast("long"))
    for step in order.steps[order.tail - 2 :]:
        by = step.backward[0]
        degree = graph.relation(pattern.triple(by, step.vertex)).groupBy("src").agg(F.count("*").alias("__n"))
        rows = rows.join(degree, F.col(f"m{by}") == F.col("src")).drop("src").withColumn("n", F.col("n") * F.col("__n")).drop("__n")
    return rows


def count_factorised(graph: Graph, pattern: Pattern, order: Plan | None = None) -> DataFrame:
    """One row n: the number of embeddings. Leaves are multiplied, not expanded, where their label is no other
    vertex's; the rest are matched."""
    order = order or plan(pattern, leaves_last=True)
    tail = [s.vertex for s in order.steps[order.tail - 2 :]]
    lone = [v for v in tail if not pattern.must_differ(v, range(len(pattern.labels)))]
    relation = lambda a, b: graph.relation(pattern.triple(a, b))
    rows = seeds(pattern, relation, *order.seed, "none")
    rows = grow(rows, pattern, [s for s in order.steps if s.vertex not in lone], relation, list(order.seed), "none")
    rows = rows.withColumn("n", F.lit(1).cast("long"))
    for step in order.steps:
        if step.vertex in lone:
            by = step.backward[0]
            degree = relation(by, step.vertex).groupBy("src").agg(F.count("*").alias("__n"))
            rows = rows.join(degree, F.col(f"m{by}") == F.col("src")).drop("src").withColumn("n", F.col("n") * F.col("__n")).drop("__n")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
