"""Helpers shared by the operators of this subpackage: Arrow batches, checkpoints, small sessions."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


#: Rows in an Arrow batch at most: texts are long, and a worker holds a batch in several forms at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows in an Arrow batch to BATCH_ROWS, if it is higher."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return a worker's free memory to the system; workers are kept between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def text_chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of rows of about ``target`` bytes.

    Yields (first row, row after the last, UTF-8 bytes, offsets); offsets start at 0 and have one entry more than
    there are rows. Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + target, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def map_chunks(df: DataFrame, text: str, kernel: Callable, schema: str, keep: list[str]) -> DataFrame:
    """Apply ``kernel(data, offsets) -> list of Arrow arrays`` to a text column, chunk by chunk.

    The result has the columns ``keep`` as they were, then the kernel's columns as ``schema`` names them. Only
    ``keep`` and the text reach Python. A kernel that makes another number of rows returns (index of each row's
    text in the chunk, arrays).
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    own = T.StructType.fromDDL(schema)
    out = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keep] + own.fields)
    n_keep = len(keep)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start, stop, data, offsets in text_chunks(batch.column(n_keep)):
                    kept = [batch.column(i).slice(start, stop - start) for i in range(n_keep)]
                    made = kernel(data, offsets)
                    if isinstance(made, tuple):
                        index, made = made
                        kept = [x.take(pa.array(index)) for x in kept]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=names)
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where all runs on one machine may the session name none; then it is a
    temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["saved_at"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove saved tables that nothing reads any more. Tables saved from them stand on their own."""
    for table in tables:
        path = table.__dict__.pop("saved_at", None)
        if path:
            java = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            java.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(java, True)
