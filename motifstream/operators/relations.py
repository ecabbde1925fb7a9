"""Relations of the directed edges of a pattern: rows, sizes, degrees, sorted neighbour lists, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.planner import Size
from ..session import shuffles_removed
from ..sources.graph import Graph


def directed_relations(graph: Graph, pattern: Pattern) -> DataFrame:
    """(qe, src, dst, batch): an edge appears under every directed pattern edge whose labels it carries."""
    parts = [graph.relation(pattern.triple(u, w)).select(F.lit(i).alias("qe"), "src", "dst", "batch") for i, (u, w) in enumerate(pattern.directed())]
    return reduce(DataFrame.unionByName, parts)


def relation_sizes(graph: Graph, pattern: Pattern) -> DataFrame:
    """(qe, n)."""
    return directed_relations(graph, pattern).groupBy("qe").agg(F.count("*").alias("n"))


def statistics(graph: Graph, pattern: Pattern) -> DataFrame:
    """(qe, cardinality, sources, new): new counts the rows after the initial graph.

    Each relation is read once, for both of its directions: its rows are counted by end, then the ends.
    """
    uses: dict = {}
    for i, (u, w) in enumerate(pattern.directed()):
        uses.setdefault(pattern.triple(u, w), []).append(i)
    parts, numbers = [], {t: k for k, t in enumerate(uses)}
    for (source, label, target), k in numbers.items():
        back = numbers[target, label, source]
        if back < k:
            continue  # read with the other direction
        ends = [F.struct(F.lit(k).alias("t"), F.col("src").alias("v"))]
        if back != k:
            ends.append(F.struct(F.lit(back).alias("t"), F.col("dst").alias("v")))
        parts.append(graph.relation((source, label, target)).select((F.col("batch") > 0).alias("late"), F.explode(F.array(*ends)).alias("e")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("e.t", "e.v").agg(F.count("*").alias("d"), F.count(F.when(F.col("late"), True)).alias("late"))
    total = rows.groupBy("t").agg(F.sum("d").alias("cardinality"), F.count("*").alias("sources"), F.sum("late").alias("new"))
    edges = graph.vertices.sparkSession.createDataFrame([(i, numbers[t]) for t, many in uses.items() for i in many], "qe int, __t int")
    return edges.join(total, F.col("__t") == F.col("t"), "left").select("qe", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cardinality", "sources", "new")])


def sizes_for_planning(graph: Graph, pattern: Pattern) -> dict[tuple[int, int], Size]:
    """Sizes along directed edges, for ``plan``; two rows for each edge of the pattern come to the driver."""
    with shuffles_removed(graph.vertices.sparkSession):
        rows = {r["qe"]: Size(r["cardinality"], r["sources"], r["new"]) for r in statistics(graph, pattern).collect()}
    return {d: rows[i] for i, d in enumerate(pattern.directed())}


def neighbour_counts(adjacency: DataFrame) -> DataFrame:
    """(src, el, dl, degree)."""
    return adjacency.groupBy("src", "el", "dl").agg(F.count("*").alias("degree"))


def neighbour_lists(adjacency: DataFrame) -> DataFrame:
    """(src, el, dl, neighbours): sorted ids as one string. A list is as long as the vertex's degree."""
    listed = F.array_sort(F.collect_list("dst"))
    return adjacency.groupBy("src", "el", "dl").agg(F.concat_ws(",", listed.cast("array<string>")).alias("neighbours"))
