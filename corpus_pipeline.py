"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Results for odd input: a null text counts as empty. All null, empty and wordless texts that are equal are copies of each
other; one stays, a null text stays null, and it is packed as the end token alone. A null doc_id is the first to go among
copies and the last to name a group. Repeated rows are copies. Very long texts are handled whole. Extra columns pass through
the first four stages, whatever their names (those that begin with two underscores apart); the last one returns the document's
id, language and source with its pieces. An empty table gives an empty table. Without labels no document is toxic.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifstream.llm import exact_dedup, ngram_join, packing, pii, toxicity
from motifstream.llm._arrow import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic. It learns from the labelled rows among ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by similarity."""
    return ngram_join.near_dedup(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece, with its tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

#: SQL cannot express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed sequences. Between stages the rows stand in the cluster's shared folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
