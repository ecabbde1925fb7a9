"""Candidates: vertices with enough neighbours of each kind to be an image, and the edges between them.

The counts are a lossless filter, since images of different neighbours differ. Candidates only ever grow, so the batch
in which a vertex becomes one is the last of the batches in which its requirements are met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..sources.graph import Graph


def candidates(graph: Graph, pattern: Pattern) -> DataFrame:
    """(qv, id, since): since when (batch) a vertex can be an image of pattern vertex qv.

    For a requirement of k neighbours that is the k-th smallest batch of the vertex's edges of that kind; neighbours
    are counted by batch first, so a vertex of very many neighbours is a row for each batch.
    """
    parts = []
    for v in range(len(pattern.labels)):
        met = None
        for (label, target), k in sorted(pattern.requirements(v).items()):
            each = graph.relation((pattern.labels[v], label, target)).groupBy("src", "batch").agg(F.count("*").alias("n"))
            # The batch in which the running count reaches k.
            counted = each.withColumn("c", F.sum("n").over(Window.partitionBy("src").orderBy("batch")))
            one = counted.where((F.col("c") >= k) & (F.col("c") - F.col("n") < k)).select(F.col("src").alias("id"), F.col("batch").alias("since"))
            if met is None:
                met = one
            else:
                met = met.join(one.withColumnRenamed("since", "__other"), "id").select("id", F.greatest("since", "__other").alias("since"))
        parts.append(met.select(F.lit(v).alias("qv"), "id", "since"))
    return reduce(DataFrame.unionByName, parts)


def candidate_edges(graph: Graph, pattern: Pattern, found: DataFrame | None = None) -> DataFrame:
    """(qe, src, dst, batch, since) of edges both of whose ends are candidates, for each directed pattern edge (its
    index). since: when the edge came to be usable; it is later than ``batch`` where an end qualified later."""
    found = candidates(graph, pattern) if found is None else found
    parts = []
    for i, (u, w) in enumerate(pattern.directed()):
        a = found.where(F.col("qv") == u).select(F.col("id").alias("src"), F.col("since").alias("__a"))
        b = found.where(F.col("qv") == w).select(F.col("id").alias("dst"), F.col("since").alias("__b"))
        rows = graph.relation(pattern.triple(u, w)).join(a, "src").join(b, "dst")
        parts.append(rows.select(F.lit(i).alias("qe"), "src", "dst", "batch", F.greatest("batch", "__a", "__b").alias("since")))
    return reduce(DataFrame.unionByName, parts)


def seed_edges(graph: Graph, pattern: Pattern, found: DataFrame | None = None) -> DataFrame:
    """(batch, seed_edge, src, dst): new edges of each batch whose ends were candidates by then, in the pattern's direction."""
    rows = candidate_edges(graph, pattern, found).where((F.col("batch") > 0) & (F.col("since") == F.col("batch")) & (F.col("qe") % 2 == 0))
    return rows.select("batch", (F.col("qe") / 2).cast("int").alias("seed_edge"), "src", "dst")


class PrunedGraph(Graph):
    """A graph whose relations hold candidate edges only, for one pattern."""

    def __init__(self, graph: Graph, pattern: Pattern):
        super().__init__(graph.vertices, graph.edges)
        found = candidates(graph, pattern)
        self._allowed = {}
        for u, w in pattern.directed():
            self._allowed.setdefault(pattern.triple(u, w), []).append((u, w))
        self._graph, self._found = graph, found

    def relation(self, triple) -> DataFrame:
        rows = self._graph.relation(triple)
        pairs = self._allowed.get(triple)
        if not pairs:
            return rows
        for column, side in (("src", 0), ("dst", 1)):
            ids = self._found.where(F.col("qv").isin(*sorted({p[side] for p in pairs}))).select(F.col("id").alias(column)).distinct()
            rows = rows.join(ids, column, "left_semi")
        return rows
