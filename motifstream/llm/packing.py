"""Packing by power-of-two decomposition.

Each document's tokens, with an end token, are cut into pieces whose lengths are powers of two, the largest first: as
many of ``max_len`` as fit, then one for each binary digit of the rest. A piece is a sequence of its own, sequences of
equal length form a bucket, and so no sequence crosses documents and none needs padding. Nothing is shuffled: a piece
depends on its document alone, and ``write_buckets`` lays the buckets out as folders.

Results for odd input: a null or empty text has the end token alone, one piece of length 1; repeated rows are packed
one by one; a very long text gives as many pieces as it needs; an empty table gives an empty table. Columns of the
input other than ``keep`` are dropped, and those of ``keep`` that clash with result columns too.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_chunks
from .bpe import Vocabulary, class_table, encode_chunk, vocabulary

COLUMNS = "start bigint, length bigint, tokens binary, doc_tokens bigint, offset bigint"


@lru_cache(4)
def special_tokens(path: str) -> tuple[tuple[bytes, int], ...]:
    """Texts that the tokenizer file maps to one id before anything else."""
    import json

    if not path.endswith(".json"):
        return ()
    with open(path, encoding="utf-8") as f:
        return tuple((x["content"].encode(), x["id"]) for x in json.load(f).get("added_tokens", ()))


def encode_special(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, specials: tuple[tuple[bytes, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids before each text), with special tokens of the text as their own ids."""
    table, raw = class_table("tokenizers"), data.tobytes()
    if not any(mark in raw for mark, _ in specials):
        return encode_chunk(data, offsets, vocab, table)[:2]
    import re

    split = re.compile(b"(" + b"|".join(re.escape(m) for m, _ in sorted(specials, key=lambda x: -len(x[0]))) + b")")
    known, parts, owner = dict(specials), [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for part in split.split(raw[a:b]):
            parts.append(part)
            owner.append(i)
    plain = [b"" if x in known else x for x in parts]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in plain])])
    ids, splits, *_ = encode_chunk(np.frombuffer(b"".join(plain), np.uint8), cuts, vocab, table)
    pieces = [np.array([known[x]], np.int32) if x in known else ids[a:b] for x, a, b in zip(parts, splits, splits[1:])]
    sizes = np.bincount(np.array(owner, np.int64), [len(x) for x in pieces], len(offsets) - 1).astype(np.int64)
    return np.concatenate([*pieces, np.empty(0, np.int32)]), np.concatenate([[0], np.cumsum(sizes)])


def decompose(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every piece of documents of ``n`` tokens; max_len is a power of two."""
    whole, rest = n // max_len, n % max_len
    bits = max_len.bit_length() - 1
    digit = (rest[:, None] >> np.arange(bits - 1, -1, -1)) & 1 if bits else np.empty((len(n), 0), np.int64)
    count = whole + digit.sum(1)
    document = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(document), max_len, np.int64)
    row, column = np.nonzero(digit)
    length[np.flatnonzero(nth >= whole[document])] = (1 << np.arange(bits - 1, -1, -1))[column] if bits else 0
    before = np.cumsum(length) - length
    return document, before - np.repeat(np.cumsum(n) - n, count), length


def pack(docs: DataFrame, path: str, max_len: int = 2048, end_id: int = 1, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each piece: ``keep``, start, length, tokens (ids as little-endian uint32), doc_tokens, offset,
    bucket (the length, by which sequences are stored) and sequence_id."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    own = {"start", "length", "tokens", "doc_tokens", "offset", "bucket", "sequence_id"}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in own]

    def kernel(data: np.ndarray, offsets: np.ndarray):
        ids, splits = encode_special(data, offsets, vocabulary(path), special_tokens(path))
        n = np.diff(splits) + 1
        flat = np.empty(int(n.sum()), "<u4")
        ends = np.cumsum(n)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        flat[inner], flat[ends - 1] = ids, end_id
        document, start, length = decompose(n, max_len)
        cuts = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
        return document, [pa.array(start), pa.array(length), tokens, pa.array(n[document]), pa.array(np.zeros(len(length), np.int64))]

    packed = map_chunks(docs, text, kernel, COLUMNS, keep)
    return packed.withColumns({"bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id()})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each bucket, so that batches of equal length are read without a filter."""
    packed.write.partitionBy("bucket").parquet(path)
