"""Results: counts, text rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern


def text_rows(embeddings: DataFrame, pattern: Pattern) -> DataFrame:
    """``batch`` (if there is one) and embedding: ids in the order of pattern vertices, by commas."""
    ids = F.concat_ws(",", *[F.col(f"m{v}").cast("string") for v in range(len(pattern.labels))])
    return embeddings.select(*[c for c in ("batch",) if c in embeddings.columns], ids.alias("embedding"))


def counts(embeddings: DataFrame) -> DataFrame:
    """(batch, n)."""
    return embeddings.groupBy("batch").agg(F.count("*").alias("n"))


def write_csv(embeddings: DataFrame, pattern: Pattern, path: str) -> None:
    embeddings.select("batch", *[f"m{v}" for v in range(len(pattern.labels))]).write.mode("overwrite").csv(path)
