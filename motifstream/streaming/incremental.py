"""Live matching: every micro-batch of inserted edges is a batch, and its new embeddings are written as they come.

State is the graph so far as an index of half edges: each edge stands under both of its ends with the labels of its own
and of both, in one folder for each batch, and inside by the bucket of the end's id. A batch costs what it touches: it
is held against the buckets of its own edges to find what is news, matching starts from its edges, and vertices are bound
by joins that read the buckets of the images bound so far. Labels are looked up once, when an edge arrives. ``compact`` puts
the folders of old batches together.

Batches and results are overwritten when a batch is run again after a failure, so each embedding is written once. There is
no watermark: nothing expires, and order of arrival defines the batches. Edges to vertices that are not declared bring
nothing; of copies of an edge the first stays.
"""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import grow, seeds
from ..plans.pattern import Pattern
from ..plans.planner import Sizes, plan

EDGES = "src bigint, dst bigint, label int"
#: Half edges: src and its label, the edge's label, dst and its label; the batch of arrival; the bucket of src.
HALVES = "src bigint, dst bigint, el int, sl int, dl int, batch int, bucket int"


class IncrementalMatcher:
    """Keeps a graph under ``folder`` and matches a pattern against each batch of insertions.

    buckets: of the index; a reader of k images opens k of them at most. sizes: statistics for the join orders.
    """

    def __init__(self, spark: SparkSession, vertices: DataFrame, pattern: Pattern, folder: str, buckets: int = 64, sizes: Sizes | None = None):
        self.spark, self.pattern, self.folder = spark, pattern, folder.rstrip("/")
        self.vertices, self.buckets, self.sizes = vertices, buckets, sizes
        #: Of each batch: seconds of indexing and of matching.
        self.seconds: dict[int, tuple[float, float]] = {}
        #: Folders of the index that have been opened: their files are listed once.
        self._opened: dict[str, DataFrame] = {}

    def start(self, initial: DataFrame) -> None:
        """Write the initial graph, batch 0."""
        self._write(self._clean(initial), 0)

    def _clean(self, edges: DataFrame) -> DataFrame:
        ends = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "label")
        return ends.groupBy("src", "dst").agg(F.min("label").alias("label"))

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, edges: DataFrame, batch: int) -> None:
        of = self.vertices.select("id", "label")
        known = edges.join(of.toDF("src", "sl"), "src").join(of.toDF("dst", "dl"), "dst").select("src", "dst", F.col("label").alias("el"), "sl", "dl")
        halves = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "el", F.col("dl").alias("sl"), F.col("sl").alias("dl")))
        halves = halves.withColumns({"batch": F.lit(batch), "bucket": self._bucket("src")})
        self._store(halves, f"batch{batch}")

    def _store(self, halves: DataFrame, name: str) -> None:
        # Each bucket is one sorted file, so that readers skip what lies outside their ids.
        self._opened.pop(name, None)
        halves.repartition("bucket").sortWithinPartitions("bucket", "src").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/edges/{name}")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folders(self) -> dict[str, int]:
        """Folders that make up the index, and the last batch of each."""
        files, path = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        done = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges/{n}/_SUCCESS"))]
        upto = max([int(m[1]) for n in done if (m := re.fullmatch(r"upto(\d+)", n))], default=-1)
        batches = {n: int(m[1]) for n in done if (m := re.fullmatch(r"batch(\d+)", n)) and int(m[1]) > upto}
        return batches | ({f"upto{upto}": upto} if upto >= 0 else {})

    def halves(self, least: int = 0, most: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The half edges of batches ``least`` to ``most``; of some buckets only, if named. Other folders are not opened."""
        some = [n for n, last in self._folders().items() if last >= least and (most is None or n.startswith("upto") or last <= most)]
        if not some:
            return self.spark.createDataFrame([], HALVES)
        rows = reduce(DataFrame.unionByName, [self._open(n) for n in sorted(some)])
        rows = rows.where(F.col("batch") >= least) if most is None else rows.where(F.col("batch").between(least, most))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _open(self, name: str) -> DataFrame:
        """A folder of the index. It does not change once it is written, and listing its buckets is a job of its own."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.schema(HALVES).parquet(f"{self.folder}/edges/{name}")
        return self._opened[name]

    @staticmethod
    def _distinct(rows: DataFrame, bucket: Column) -> list[int]:
        """Buckets in some rows; there are no more of them than the index has."""
        return sorted(r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect())

    def insert(self, edges: DataFrame, batch: int) -> None:
        """Add one batch and write what it brings; edges that are there already are no news."""
        began = time.perf_counter()
        new = self._clean(edges)
        known = self.halves(0, batch - 1, self._distinct(new, self._bucket("src"))).select("src", "dst")
        self._write(new.join(known, ["src", "dst"], "left_anti"), batch)
        indexed = time.perf_counter()
        self.new_matches(batch).write.mode("overwrite").parquet(f"{self.folder}/matches/batch={batch}")
        self.seconds[batch] = (indexed - began, time.perf_counter() - indexed)

    def new_matches(self, batch: int) -> DataFrame:
        """(m0.., seed_edge) of the embeddings that ``batch`` brings: for each pattern edge, what grows from the batch's
        own edges, edges before it older, edges after it as new at most."""
        pattern = self.pattern
        own = self.halves(batch, batch)
        near = self._distinct(own, F.col("bucket"))  # of the ends of new edges
        parts = []
        for i, (u, w, _) in enumerate(pattern.edges):
            order = plan(pattern, (u, w), self.sizes)

            def relation(a: int, b: int, at: int = i, ends: tuple[int, int] = (u, w)) -> DataFrame:
                k, (sl, el, dl) = pattern.edge_index(a, b), pattern.triple(a, b)
                # What joins on an end of a new edge is in its buckets.
                rows = own if k == at else self.halves(0, batch - (k < at), near if a in ends else None)
                return rows.where((F.col("sl") == sl) & (F.col("el") == el) & (F.col("dl") == dl)).select("src", "dst", "batch")

            rows = grow(seeds(pattern, relation, u, w, "none"), pattern, order.steps, relation, [u, w], "none")
            parts.append(rows.select(*[f"m{v}" for v in range(len(pattern.labels))], F.lit(i).alias("seed_edge")))
        return reduce(DataFrame.unionByName, parts)

    def compact(self, upto: int) -> None:
        """Put the batches up to ``upto``, which must be done, into one folder, and remove theirs."""
        old = [n for n, last in self._folders().items() if last <= upto]
        if len(old) < 2:
            return
        self._store(self.halves(0, upto), f"upto{upto}")
        files, _ = self._files()
        for n in old:  # from here on they are not read any more
            self._opened.pop(n, None)
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges/{n}"), True)

    def run(self, stream: DataFrame, checkpoint: str, compact_every: int | None = None, **trigger) -> StreamingQuery:
        """Follow a stream of edges (src, dst, label); batch numbers start at 1. With ``compact_every``, the batches before
        the current one are put together that often."""

        def one(rows: DataFrame, n: int) -> None:
            self.insert(rows, n + 1)
            if compact_every and n and n % compact_every == 0:
                self.compact(n)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def matches(self) -> DataFrame:
        """(m0.., seed_edge, batch) of all batches so far."""
        ids = ", ".join(f"m{v} bigint" for v in range(len(self.pattern.labels)))
        return self.spark.read.schema(f"{ids}, seed_edge int, batch int").parquet(f"{self.folder}/matches")
