"""Command line: match a pattern file against a graph file and a file of insertions."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from .operators import matching, relations, results
from .plans.pattern import load_pattern
from .plans.planner import plan
from .sources import textgraph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motifstream", description=__doc__)
    p.add_argument("--query", required=True, help="pattern file")
    p.add_argument("--data", required=True, help="graph file")
    p.add_argument("--update", required=True, help="file of inserted edges")
    p.add_argument("--batch_size", type=int, default=None, help="edge lines in a batch; all if not given")
    p.add_argument("--print_results", action="store_true", help="print the embeddings of each batch")
    p.add_argument("--explain", action="store_true", help="print the matching order")
    p.add_argument("--timings", action="store_true", help="print seconds of each phase")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints the number of new embeddings and returns it."""
    args, spent, began = parser().parse_args(argv), {}, time.perf_counter()

    def phase(name: str) -> None:
        nonlocal began
        spent[name], began = time.perf_counter() - began, time.perf_counter()

    for path in (args.query, args.data, args.update):
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
    spark = spark or SparkSession.builder.appName("motifstream").getOrCreate()
    pattern = load_pattern(args.query)
    graph = textgraph.load(spark, args.data, args.update, args.batch_size, pattern)
    phase("load")
    sizes = relations.sizes_for_planning(graph, pattern)
    order = plan(pattern, sizes=sizes)
    phase("plan")
    if args.explain:
        print(order.explain())
    found = matching.deltas(graph, pattern, sizes=sizes)
    if args.print_results:
        found = found.cache()
    total = found.count()
    phase("match")
    print(f"new embeddings: {total}")
    if args.print_results:
        for row in results.text_rows(found, pattern).orderBy("batch", "embedding").toLocalIterator():
            print(f"{row['batch']}: {row['embedding']}")
        found.unpersist()
    if args.timings:
        print("seconds: " + ", ".join(f"{k} {v:.2f}" for k, v in spent.items()))
    return total


if __name__ == "__main__":
    main()
