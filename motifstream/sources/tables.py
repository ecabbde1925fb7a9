"""Graph views over the test tables: orders and parts (trade), parts bought together (basket), users and events (visits)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import batch_of_month
from .graph import EndsGraph, TypedGraph

# Vertex labels of the trade graph; a vertex's id is SPACE * label + key.
REGION, NATION, CUSTOMER, SUPPLIER, ORDER, PART = range(6)
SPACE = 100_000_000
#: Edges of earlier years are the initial graph; later months are batches.
FIRST_YEAR = 2001


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(label: int, column: str):
    return (F.lit(SPACE * label) + F.col(column)).cast("long")


def trade(spark: SparkSession, folder: str) -> TypedGraph:
    """Edges: 0 region-nation, 1 nation-customer, 2 nation-supplier, 3 customer-order, 4 order-part, 5 supplier-order,
    6 supplier-part. Lines of one order repeat pairs; a pair is as old as its first shipping date."""
    keys = {"region": (REGION, "r_regionkey"), "nation": (NATION, "n_nationkey"), "customer": (CUSTOMER, "c_custkey"), "supplier": (SUPPLIER, "s_suppkey"), "orders": (ORDER, "o_orderkey"), "part": (PART, "p_partkey")}
    vertices = reduce(DataFrame.unionByName, [table(spark, folder, t).select(_id(n, k).alias("id"), F.lit(n).alias("label")) for t, (n, k) in keys.items()])
    lines = table(spark, folder, "lineitem")

    def fixed(name: str, a: tuple[int, str], b: tuple[int, str]) -> DataFrame:
        return table(spark, folder, name).select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(0).alias("batch"))

    def shipped(a: tuple[int, str], b: tuple[int, str]) -> DataFrame:
        pairs = lines.groupBy(a[1], b[1]).agg(F.min("l_shipdate").alias("day"))
        return pairs.select(_id(*a).alias("src"), _id(*b).alias("dst"), batch_of_month(F.col("day"), FIRST_YEAR).alias("batch"))

    placed = table(spark, folder, "orders").select(_id(CUSTOMER, "o_custkey").alias("src"), _id(ORDER, "o_orderkey").alias("dst"), batch_of_month(F.col("o_orderdate"), FIRST_YEAR).alias("batch"))
    return TypedGraph(vertices, {
        (REGION, 0, NATION): fixed("nation", (REGION, "n_regionkey"), (NATION, "n_nationkey")),
        (NATION, 1, CUSTOMER): fixed("customer", (NATION, "c_nationkey"), (CUSTOMER, "c_custkey")),
        (NATION, 2, SUPPLIER): fixed("supplier", (NATION, "s_nationkey"), (SUPPLIER, "s_suppkey")),
        (CUSTOMER, 3, ORDER): placed,
        (ORDER, 4, PART): shipped((ORDER, "l_orderkey"), (PART, "l_partkey")),
        (SUPPLIER, 5, ORDER): shipped((SUPPLIER, "l_suppkey"), (ORDER, "l_orderkey")),
        (SUPPLIER, 6, PART): shipped((SUPPLIER, "l_suppkey"), (PART, "l_partkey")),
    })


def basket(spark: SparkSession, folder: str) -> EndsGraph:
    """Parts, labelled by size modulo 3, joined when one order holds both; as old as the first such order's later line."""
    vertices = table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") % 3).cast("int").alias("label"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("id"), "l_shipdate")

    def pairs(lines: DataFrame, *labels: str) -> DataFrame:
        a = lines.select(F.col("l_orderkey").alias("o"), F.col("id").alias("src"), F.col("l_shipdate").alias("da"), *[F.col(x).alias("sl") for x in labels])
        b = lines.select(F.col("l_orderkey").alias("o"), F.col("id").alias("dst"), F.col("l_shipdate").alias("db"), *[F.col(x).alias("dl") for x in labels])
        met = a.join(b, "o").where("src < dst").groupBy("src", "dst", *[x for _ in labels for x in ("sl", "dl")])
        return met.agg(F.min(F.greatest("da", "db")).alias("day")).withColumn("batch", batch_of_month(F.col("day"), FIRST_YEAR))

    # Each line gets its part's label once: lines are far fewer than pairs.
    labelled = lines.join(vertices, "id")
    ends = pairs(labelled, "label").select("src", "dst", "sl", F.lit(0).alias("el"), "dl", "batch")
    return EndsGraph(vertices, pairs(lines).select("src", "dst", F.lit(0).alias("label"), "batch"), ends)


def visits(spark: SparkSession, folder: str) -> TypedGraph:
    """Users (label 0) and cells of event type and day (label 1); days after the 15th are batches."""
    events = table(spark, folder, "events")
    kinds = F.create_map(*[x for i, k in enumerate(("click", "error", "purchase", "signup"), 1) for x in (F.lit(k), F.lit(i))])
    cell = (F.lit(SPACE) + F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit(5)) * 100 + F.dayofmonth("ts")).cast("long")
    rows = events.select(F.col("user_id").cast("long").alias("src"), cell.alias("dst"), "ts")
    vertices = rows.select(F.col("src").alias("id"), F.lit(0).alias("label")).distinct().unionByName(rows.select(F.col("dst").alias("id"), F.lit(1).alias("label")).distinct())
    pairs = rows.groupBy("src", "dst").agg(F.min("ts").alias("ts"))
    return TypedGraph(vertices, {(0, 0, 1): pairs.select("src", "dst", F.greatest(F.dayofmonth("ts") - 15, F.lit(0)).cast("int").alias("batch"))})
