"""Connected components of a graph of links, by smallest labels.

The links that stand in one partition are first replaced by a spanning forest of them, a star for each of its parts; a
graph that fits one partition is solved by that. Then each round gives every node the smallest label of itself, of its
neighbours and of the node that its label names, and hands the smallest one also to that node, so whole parts
move at once and long chains shorten by half. A round is saved to the shared folder as one table: each table
costs jobs, files and, on a local file system, commands that Hadoop starts to set their rights. A node with very many links
is no obstacle: labels are aggregated before they are shuffled, and the joins are such that adaptive execution splits
hot nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import saved, small_batches

#: Links that a worker holds at once, at least; a partition with more gives several forests.
BLOCK_LINKS = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) of the nodes that are not the smallest of their parts."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))  # always that of a node which is its own label
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(len(ids)))
    return ids[node], ids[label[node]]


def _contracted(pairs: DataFrame) -> DataFrame:
    """(u, v), both ways round, of links that join the same nodes as ``pairs`` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            node, root = forest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((node, root), (root, node))], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_LINKS:
                yield done(held)
                held, rows = [], 0
        if rows:
            yield done(held)

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node of a link; the component is its smallest node. Nodes are of type bigint; null ends
    and loops are dropped."""
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = saved(_contracted(pairs))
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        # ``seen`` equals ``node`` but is no key that the rows are already dealt by: both sides are dealt for the join.
        seen = labels.select(F.col("node").alias("seen"), F.col("label").alias("near"))
        near = both.join(seen, both["v"] == seen["seen"]).groupBy("u").agg(F.min("near").alias("near"))
        closer = labels.join(near, labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("near"))
        offers = F.explode(F.array(F.struct("node", F.col("near").alias("label"), F.col("label").alias("old")), F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).cast("bigint").alias("old"))))
        closer = closer.select(offers.alias("x")).select("x.node", "x.label", "x.old")
        further = labels.join(seen, labels["label"] == seen["seen"]).select("node", F.col("near").alias("label"), F.lit(None).cast("bigint").alias("old"))
        labels = saved(closer.unionByName(further).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
