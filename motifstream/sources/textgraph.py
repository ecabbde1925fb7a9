"""Graphs in text files: ``v id label`` and ``e id id label`` lines; ``t`` lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from .graph import Graph, clean_edges


class GraphFormatError(ValueError):
    """A file holds lines that it must not hold."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, part): words of each line; lines stand in the order of files, of blocks in a file, and of the
    increasing number nth in a block, in whatever order Spark reads them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.split(F.trim("value"), r"\s+").alias("part"))
    return rows.where(F.col("part")[0].isin("v", "e"))


def _edges(rows: DataFrame) -> DataFrame:
    part = F.col("part")
    return rows.where(part[0] == "e").select("file", "block", "nth", part[1].cast("long").alias("src"), part[2].cast("long").alias("dst"), F.coalesce(F.get(part, F.lit(3)).cast("int"), F.lit(0)).alias("label"))


def numbered(rows: DataFrame, order: str = "nth", parts: tuple[str, ...] = ()) -> DataFrame:
    """Add seq: 0, 1, ... in the order of the columns ``parts``, then of the increasing numbers that Spark gave the rows.

    Without ``parts`` those numbers decide alone; they hold the partition in their upper bits. Positions follow from the
    sizes of parts or partitions: nothing is gathered in one task.
    """
    split = rows.withColumn("__p", F.struct(*parts) if parts else F.shiftright(order, 33))
    sizes = split.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return split.withColumn("__nth", nth).join(before, F.col("__p") == F.col("__q")).withColumn("seq", F.col("__before") + F.col("__nth") - 1).drop("__p", "__q", "__n", "__nth", "__before")


def batches(edges: DataFrame, batch_size: int | None) -> DataFrame:
    """Add batch from seq: 1 for the first ``batch_size`` edges, 2 for the next; one batch if there is no size."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive")
    return edges.withColumn("batch", F.lit(1) if batch_size is None else (F.floor(F.col("seq") / batch_size) + 1).cast("int"))


def load(spark: SparkSession, data: str, update: str | None = None, batch_size: int | None = None, pattern: Pattern | None = None) -> Graph:
    """A graph from a data file and a file of insertions (or a folder of them, in the order of their names). With a pattern, labels that it lacks are left out at once;
    batch numbers count all edge lines all the same."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive")
    rows = _lines(spark, data)
    part = F.col("part")
    vertices = rows.where(part[0] == "v").select("nth", part[1].cast("long").alias("id"), part[2].cast("int").alias("label"))
    if pattern is not None:
        vertices = vertices.where(F.col("label").isin(*sorted(set(pattern.labels))))
    vertices = vertices.groupBy("id").agg(F.min_by("label", "nth").alias("label"))
    edges = _edges(rows).select("src", "dst", "label", F.col("nth").alias("seq"), F.lit(0).alias("batch"))
    if update is not None:
        new = _lines(spark, update)
        if new.where(F.col("part")[0] == "v").limit(1).count():
            raise GraphFormatError("an update file holds edges only")
        edges = edges.unionByName(batches(numbered(_edges(new), "nth", ("file", "block")), batch_size).select("src", "dst", "label", "seq", "batch"))
    if pattern is not None:
        edges = edges.where(F.col("label").isin(*sorted({x for *_, x in pattern.edges})))
    return Graph(vertices, clean_edges(edges))
