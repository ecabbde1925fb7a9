"""Graphs as relations.

A graph is (id, label) vertices and undirected (src, dst, label, batch) edges; batch 0 is the initial graph. What
matching needs is one oriented relation (src, dst, batch) for each triple (label of src, edge label, label of dst).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..session import shuffles_removed

Triple = tuple[int, int, int]


def flipped(edges: DataFrame) -> DataFrame:
    """The same edges the other way round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def clean_edges(edges: DataFrame) -> DataFrame:
    """Without loops and second copies of an edge; of copies the first arrival (smallest batch, then seq) stays."""
    canonical = edges.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    order = [c for c in ("batch", "seq") if c in rest] or ["label"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return canonical.groupBy("src", "dst").agg(first.alias("e")).select("src", "dst", *[F.col(f"e.{c}") for c in rest])


@dataclass
class Graph:
    """From two tables. Edges whose ends are not declared drop out of the joins."""

    vertices: DataFrame
    edges: DataFrame

    def labels(self) -> DataFrame:
        """(id, label), the first label where a vertex comes more than once."""
        return self.vertices

    def adjacency(self, pattern: Pattern | None = None) -> DataFrame:
        """(src, dst, el, sl, dl, batch) in both directions; with a pattern, only what carries its labels."""
        v, e = self.labels(), self.edges
        if pattern is not None:
            v = v.where(F.col("label").isin(*sorted(set(pattern.labels))))
            e = e.where(F.col("label").isin(*sorted({x for *_, x in pattern.edges})))
        a = v.select(F.col("id").alias("src"), F.col("label").alias("sl"))
        b = v.select(F.col("id").alias("dst"), F.col("label").alias("dl"))
        one = e.select("src", "dst", F.col("label").alias("el"), "batch").join(a, "src").join(b, "dst").select("src", "dst", "el", "sl", "dl", "batch")
        return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "el", F.col("dl").alias("sl"), F.col("sl").alias("dl"), "batch"))

    def relation(self, triple: Triple) -> DataFrame:
        """(src, dst, batch) of one triple. The labels are filtered before the joins, in each direction apart."""
        source, label, target = triple
        v = self.labels()
        a = v.where(F.col("label") == source).select(F.col("id").alias("src"))
        b = v.where(F.col("label") == target).select(F.col("id").alias("dst"))
        e = self.edges.where(F.col("label") == label).select("src", "dst", "batch")
        return e.unionByName(flipped(e)).join(a, "src", "left_semi").join(b, "dst", "left_semi")

    def upto(self, batch: int) -> Graph:
        return Graph(self.vertices, self.edges.where(F.col("batch") <= batch))


@dataclass
class EndsGraph(Graph):
    """A graph whose edges are at hand with the labels of both ends, too.

    ends: (src, dst, sl, el, dl, batch), each edge once.
    """

    ends: DataFrame

    def relation(self, triple: Triple) -> DataFrame:
        source, label, target = triple
        of = lambda a, b: self.ends.where((F.col("sl") == a) & (F.col("el") == label) & (F.col("dl") == b)).select("src", "dst", "batch")
        return of(source, target).unionByName(flipped(of(target, source)))

    def stored(self, path: str) -> EndsGraph:
        """The same graph, its edges with labels written to ``path`` in the shared folder."""
        spark = self.vertices.sparkSession
        with shuffles_removed(spark):
            self.ends.write.option("compression", "zstd").parquet(path)
        return EndsGraph(self.vertices, self.edges, spark.read.schema(self.ends.schema).parquet(path))

    def upto(self, batch: int) -> EndsGraph:
        return EndsGraph(self.vertices, self.edges.where(F.col("batch") <= batch), self.ends.where(F.col("batch") <= batch))


@dataclass
class TypedGraph(Graph):
    """A graph whose edge labels each join two known vertex labels and whose ends are all declared, as foreign keys are.

    parts: (label of src, edge label, label of dst) to (src, dst, batch); no join is needed to know a row's labels.
    """

    parts: dict[Triple, DataFrame]

    def __init__(self, vertices: DataFrame, parts: dict[Triple, DataFrame]):
        self.parts = parts
        tagged = [e.select("src", "dst", F.lit(t[1]).alias("label"), "batch") for t, e in sorted(parts.items(), key=lambda x: x[0][1])]
        super().__init__(vertices, reduce(DataFrame.unionByName, tagged))

    def relation(self, triple: Triple) -> DataFrame:
        source, label, target = triple
        found = [self.parts[triple]] if triple in self.parts else []
        if (target, label, source) in self.parts:
            found.append(flipped(self.parts[target, label, source]))
        if not found:
            return self.edges.where("false").select("src", "dst", "batch")
        return reduce(DataFrame.unionByName, found)

    def adjacency(self, pattern: Pattern | None = None) -> DataFrame:
        kept = {t: e for t, e in self.parts.items() if pattern is None or ({t[0], t[2]} <= set(pattern.labels) and t[1] in {x for *_, x in pattern.edges})}
        both = []
        for (sl, el, dl), e in sorted(kept.items(), key=lambda x: x[0][1]):
            for rows, a, b in ((e, sl, dl), (flipped(e), dl, sl)):
                both.append(rows.select("src", "dst", F.lit(el).alias("el"), F.lit(a).alias("sl"), F.lit(b).alias("dl"), "batch"))
        return reduce(DataFrame.unionByName, both) if both else super().adjacency(pattern)

    def upto(self, batch: int) -> TypedGraph:
        return TypedGraph(self.vertices, {t: e.where(F.col("batch") <= batch) for t, e in self.parts.items()})
