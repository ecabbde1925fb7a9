"""Embeddings of a pattern: all of them, or those that a batch of new edges brings.

Four strategies give the same rows. ``full``: match the whole graph once; an embedding belongs to the latest batch of
its edges, so one run answers all batches. ``since_start``: all batches again, grown from the edges after the initial
graph; ``deltas`` and ``count_by_batch`` take it where statistics say that it makes fewer rows. ``telescoped``: for one batch, a union over pattern edges i of old edges
before i, new ones at i, all after i; each embedding comes once by construction. ``canonical``: grow from every new
edge over all edges and keep an embedding only at its smallest new edge.

All joins are equi-joins on vertex ids; that images differ is a residual condition of the join and is asked only of
vertices with equal labels. The batch of each edge is folded into a running maximum, so a partial embedding holds its
images and one number.

Where a vertex is bound by several relations and the first would make very many rows, ``full`` either joins the first two
at that vertex and then with the rows on both ends (wedge), if that makes far fewer, or drops rows that the others
cannot close by bitmaps of their edges before anything is shuffled (sieve).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge_key, latest, seed_edge
from ..plans.pattern import Pattern
from ..plans.planner import Plan, Step, by_union, plan
from ..plans.symmetry import automorphisms, breaking
from ..sources.graph import Graph
from .sieve import sieved

#: Estimated rows of a join from which ``full`` looks for a way to make or move fewer.
MANY = 10_000_000

Relation = Callable[[int, int], DataFrame]


def _columns(pattern: Pattern) -> list[str]:
    return [f"m{v}" for v in range(len(pattern.labels))]


def grow(rows: DataFrame, pattern: Pattern, steps, relation: Relation, bound: list[int], keep: str, less: list[tuple[int, int]] = (), ways: dict[int, str] | None = None, sizes=None) -> DataFrame:
    """Bind the vertices of ``steps`` one after the other.

    keep: 'latest' folds edge batches into column batch, 'each' keeps b<i> of every edge, 'none' drops them.
    less: pairs (a, b) of vertices whose images must be in that order.
    ways: 'wedge' or 'sieve' for vertices that are not bound by plain joins; sizes: of the relations, for sieves.
    """
    bound = list(bound)
    for step in steps:
        v, way = step.vertex, (ways or {}).get(step.vertex)
        if way == "wedge":
            rows = _met(rows, pattern, step, relation, bound, keep, less)
        for nth, b in enumerate(step.backward):
            if way == "wedge" and nth < 2:
                continue
            if way == "sieve" and nth == 1:
                for x in step.backward[1:]:
                    rows = sieved(rows, f"m{x}", f"m{v}", relation(x, v), sizes[x, v].rows)
            edge = relation(b, v).select(F.col("src").alias("__s"), F.col("dst").alias("__d"), *([] if keep == "none" else [F.col("batch").alias("__b")]))
            if nth == 0:
                on = F.col(f"m{b}") == F.col("__s")
                for x in pattern.must_differ(v, bound):
                    on = on & (F.col(f"m{x}") != F.col("__d"))
                for a, c in less:
                    if v in (a, c) and (a in bound or c in bound):
                        on = on & ((F.col("__d") < F.col(f"m{c}")) if v == a else (F.col(f"m{a}") < F.col("__d")))
                rows = rows.join(edge, on).withColumnRenamed("__d", f"m{v}").drop("__s")
            else:
                on = (F.col(f"m{b}") == F.col("__s")) & (F.col(f"m{v}") == F.col("__d"))
                rows = rows.join(edge, on, "left_semi" if keep == "none" else "inner").drop("__s", "__d")
            if keep == "latest":
                rows = rows.withColumn("batch", F.greatest("batch", "__b")).drop("__b")
            elif keep == "each":
                rows = rows.withColumnRenamed("__b", f"b{pattern.edge_index(b, v)}")
        bound.append(v)
    return rows


def _met(rows: DataFrame, pattern: Pattern, step: Step, relation: Relation, bound: list[int], keep: str, less: list[tuple[int, int]]) -> DataFrame:
    """Bind a vertex by the join of its first two relations, which meets ``rows`` on both of its ends."""
    v, (a, b) = step.vertex, step.backward[:2]
    pairs = grow(seeds(pattern, relation, v, a, keep, less), pattern, [Step(b, (v,))], relation, [v, a], keep, less)
    pairs = pairs.withColumnsRenamed({f"m{a}": "__a", f"m{b}": "__z", "batch": "__b"})
    on = (F.col(f"m{a}") == F.col("__a")) & (F.col(f"m{b}") == F.col("__z"))
    for x in pattern.must_differ(v, bound):
        on = on & (F.col(f"m{x}") != F.col(f"m{v}"))
    for x, y in less:
        if v in (x, y) and (x in bound or y in bound):
            on = on & (F.col(f"m{x}") < F.col(f"m{y}"))
    rows = rows.join(pairs, on).drop("__a", "__z")
    return rows.withColumn("batch", F.greatest("batch", "__b")).drop("__b") if keep == "latest" else rows


def seeds(pattern: Pattern, relation: Relation, u: int, w: int, keep: str, less: list[tuple[int, int]] = ()) -> DataFrame:
    """Images of one pattern edge."""
    edge = relation(u, w)
    if pattern.labels[u] == pattern.labels[w]:
        edge = edge.where("src <> dst")
        if (u, w) in less or (w, u) in less:
            edge = edge.where("src < dst" if (u, w) in less else "dst < src")
    name = {"latest": "batch", "each": f"b{pattern.edge_index(u, w)}"}.get(keep)
    return edge.select(F.col("src").alias(f"m{u}"), F.col("dst").alias(f"m{w}"), *([F.col("batch").alias(name)] if name else []))


def full(graph: Graph, pattern: Pattern, order: Plan | None = None, keep: str = "latest", less: list[tuple[int, int]] = ()) -> DataFrame:
    """Every embedding: m0.., and batch, b0.. or nothing more as ``keep`` says."""
    order = order or plan(pattern)
    relation: Relation = lambda a, b: graph.relation(pattern.triple(a, b))
    ways, many = {}, False
    for step, (before, made, wedge) in zip(order.steps, order.widths()):
        # Behind a large join too: where edges cluster, more is left than images taken as independent would leave.
        many = many or made >= MANY
        if many and len(step.backward) > 1:
            ways[step.vertex] = "wedge" if made >= MANY and 2 * (before + wedge) < made else "sieve"
    rows = seeds(pattern, relation, *order.seed, keep, less)
    rows = grow(rows, pattern, order.steps, relation, list(order.seed), keep, less, ways, order.sizes)
    more = {"latest": ["batch"], "each": [f"b{i}" for i in range(len(pattern.edges))], "none": []}[keep]
    return rows.select(*_columns(pattern), *more)


def full_by_symmetry(graph: Graph, pattern: Pattern, order: Plan | None = None) -> DataFrame:
    """``full``, from one embedding of each set of symmetric ones, which share their edges and so their batch."""
    rows, maps = full(graph, pattern, order, "latest", breaking(pattern)), automorphisms(pattern)
    if len(maps) == 1:
        return rows
    ids = _columns(pattern)
    images = [F.struct(*[F.col(f"m{x}").alias(c) for c, x in zip(ids, m)]) for m in maps]
    return rows.select(F.explode(F.array(*images)).alias("e"), "batch").select("e.*", "batch")


def since_start(graph: Graph, pattern: Pattern, sizes=None, keep: str = "latest", less: list[tuple[int, int]] = ()) -> DataFrame:
    """Every embedding that some batch brought, with columns as ``full`` has them.

    A union over pattern edges i: edges before i of the initial graph, i of a later batch, edges after i of any. Rows
    start from what is new, so a large graph with few insertions is not matched as a whole.
    """
    parts = []
    for i, (u, w, _) in enumerate(pattern.edges):
        order = plan(pattern, (u, w), sizes)

        def relation(a: int, b: int, at: int = i) -> DataFrame:
            k, edges = pattern.edge_index(a, b), graph.relation(pattern.triple(a, b))
            return edges.where("batch = 0") if k < at else edges.where("batch > 0") if k == at else edges

        rows = grow(seeds(pattern, relation, u, w, keep, less), pattern, order.steps, relation, [u, w], keep, less)
        more = {"latest": ["batch"], "each": [f"b{k}" for k in range(len(pattern.edges))], "none": []}[keep]
        parts.append(rows.select(*_columns(pattern), *more))
    return reduce(DataFrame.unionByName, parts)


def count_by_batch(graph: Graph, pattern: Pattern, order: Plan | None = None, sizes=None, initial: bool = True) -> DataFrame:
    """(batch, n) of all embeddings, 0 being the initial graph; without that batch unless ``initial``.

    One embedding of each set of symmetric ones is matched; they share their edges and so their batch.
    """
    if not initial and order is None and sizes is not None and by_union(pattern, sizes):
        rows = since_start(graph, pattern, sizes, "latest", breaking(pattern))
    else:
        rows = full(graph, pattern, order or plan(pattern, None, sizes), "latest", breaking(pattern))
        rows = rows if initial else rows.where("batch > 0")
    return rows.groupBy("batch").agg((F.count("*") * len(automorphisms(pattern))).cast("long").alias("n"))


def telescoped(graph: Graph, pattern: Pattern, batch: int, sizes=None) -> DataFrame:
    """(m0.., seed_edge) of the embeddings that ``batch`` brings; seed_edge is the first pattern edge on a new edge."""
    parts = []
    for i, (u, w, _) in enumerate(pattern.edges):
        order = plan(pattern, (u, w), sizes)

        def relation(a: int, b: int, at: int = i) -> DataFrame:
            k, edges = pattern.edge_index(a, b), graph.relation(pattern.triple(a, b))
            seen = F.col("batch")
            return edges.where(seen < batch if k < at else seen == batch if k == at else seen <= batch)

        rows = seeds(pattern, relation, u, w, "none")
        parts.append(grow(rows, pattern, order.steps, relation, [u, w], "none").select(*_columns(pattern), F.lit(i).alias("seed_edge")))
    return reduce(DataFrame.unionByName, parts)


def canonical(graph: Graph, pattern: Pattern, batch: int | None = None, sizes=None, orbits: bool = False) -> DataFrame:
    """(batch, m0.., seed_edge[, weight]) of the embeddings that ``batch`` brings (or that each batch after the initial
    graph does), each at its smallest new edge.

    With ``orbits`` only one pattern edge of each orbit is grown, and weight is the size of the orbit: sums of weights
    are numbers of embeddings.
    """
    from ..plans.symmetry import edge_orbits

    def relation(a: int, b: int) -> DataFrame:
        edges = graph.relation(pattern.triple(a, b))
        return edges if batch is None else edges.where(F.col("batch") <= batch)

    weight = {o[0]: len(o) for o in edge_orbits(pattern)} if orbits else {i: 1 for i in range(len(pattern.edges))}
    parts = []
    for i, size in weight.items():
        u, w, _ = pattern.edges[i]
        order, now = plan(pattern, (u, w), sizes), F.col(f"b{i}")
        rows = seeds(pattern, relation, u, w, "each").where(now > 0 if batch is None else now == batch)
        rows = grow(rows, pattern, order.steps, relation, [u, w], "each")
        seed = edge_key(F.col(f"m{u}"), F.col(f"m{w}"))
        for k, (a, b, _) in enumerate(pattern.edges):
            if k != i:
                rows = rows.where((F.col(f"b{k}") < now) | ((F.col(f"b{k}") == now) & (edge_key(F.col(f"m{a}"), F.col(f"m{b}")) >= seed)))
        parts.append(rows.select(now.alias("batch"), *_columns(pattern), F.lit(i).alias("seed_edge"), *([F.lit(size).alias("weight")] if orbits else [])))
    return reduce(DataFrame.unionByName, parts)


def deltas(graph: Graph, pattern: Pattern, order: Plan | None = None, sizes=None) -> DataFrame:
    """(batch, seed_edge, m0..) of the embeddings of every batch after the initial graph."""
    if order is None and sizes is not None and by_union(pattern, sizes):
        rows = since_start(graph, pattern, sizes, "each")
    else:
        rows = full(graph, pattern, order or plan(pattern, None, sizes), "each")
    rows = rows.withColumn("batch", latest([f"b{i}" for i in range(len(pattern.edges))])).where("batch > 0")
    return rows.select("batch", seed_edge(pattern, F.col("batch")).alias("seed_edge"), *_columns(pattern))
