"""Byte-level BPE encoding and decoding.

Boundaries between pre-tokens are found without a regular expression. Every code point has a class; every class is a
transition function of a small automaton; since composition of functions is associative, the automaton's state before
each character comes from a blocked prefix scan over function numbers (a table holds every product of two functions).
The slices between boundaries go through a cache to pair merging. ``encode`` keeps token offsets, by which
``decode_spans`` decodes the ids of any span of the text; whole texts are decoded by copying pieces to their offsets.

Results for odd input: a null text is an empty text and has no ids; an unpaired surrogate arrives as ``?`` from Spark;
repeated rows are encoded one by one; an empty table gives an empty table. Columns of the input with the names of the
result columns are replaced. A text of any length is one row; work and memory grow with n log n and n.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import list_array, map_chunks

# Classes of characters. A2 and A3: an apostrophe before a contraction of one or two letters.
L, N, O, SPACE, WHITE, A2, A3 = range(7)
#: Added to a class at a document's first character: its function forgets the state.
FIRST = 7
# States: nothing open, letters, numbers, other, a space, other white space, contraction with one or two letters to go.
S_NONE, S_L, S_N, S_O, S_SPACE, S_WHITE, S_C1, S_C2 = range(8)

#: What follows an apostrophe in a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")

#: Entries of a worker's cache of merged slices; a full cache is emptied.
CACHE_ENTRIES = 300_000


def _step(state: int, kind: int) -> int:
    if kind == L:
        return {S_C2: S_C1, S_C1: S_NONE}.get(state, S_L)
    if kind in (A2, A3) and state not in (S_O, S_SPACE):
        return S_C1 if kind == A2 else S_C2
    return {N: S_N, SPACE: S_SPACE, WHITE: S_WHITE}.get(kind, S_O)


def _starts(state: int, kind: int, before_word: bool) -> bool:
    """Whether a token starts at a character of this class. before_word: a character that isn't white space follows."""
    if kind in (SPACE, WHITE):
        return before_word if state in (S_SPACE, S_WHITE) else True
    if kind == L:
        return state not in (S_L, S_SPACE, S_C1, S_C2)
    if kind == N:
        return state not in (S_N, S_SPACE)
    return state not in (S_O, S_SPACE)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function number of each symbol, product table, functions as rows of states, start table)."""
    symbols = [tuple(_step(s, k) for s in range(8)) for k in range(7)]
    symbols += [(f[S_NONE],) * 8 for f in symbols]
    number: dict[tuple, int] = {}
    queue = list(dict.fromkeys(symbols))
    for f in queue:
        number[f] = len(number)
    for f in queue:  # closes the set under products with a symbol
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    size = len(queue)
    product = np.array([[number[tuple(g[x] for x in f)] for g in queue] for f in queue], np.uint16).reshape(-1)
    start = np.array([[[_starts(s, k, w) for w in (False, True)] for k in range(7)] for s in range(8)], bool)
    return np.array([number[f] for f in symbols], np.uint16), product, np.array(queue, np.uint8).reshape(size, 8), start.reshape(-1)


def states_before(symbols: np.ndarray, block: int = 128) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked exclusive scan of transition functions."""
    number, product, table, _ = automaton()
    functions, size, n = number[symbols], len(table), len(symbols)

    def inclusive(f: np.ndarray) -> np.ndarray:
        if len(f) <= block:
            out = f.copy()
            for i in range(1, len(f)):
                out[i] = product[int(out[i - 1]) * size + int(f[i])]
            return out
        rows = -(-len(f) // block)
        padded = np.zeros(rows * block, np.uint16)
        padded[: len(f)] = f
        columns = np.ascontiguousarray(padded.reshape(rows, block).T)
        for j in range(1, block):
            np.take(product, columns[j - 1].astype(np.int32) * size + columns[j], out=columns[j])
        carry = inclusive(columns[-1])[:-1].astype(np.int32) * size
        for j in range(block):
            columns[j, 1:] = product[carry + columns[j, 1:]]
        return columns.T.reshape(-1)[: len(f)]

    out = np.empty(n, np.uint8)
    if n:
        out[0] = S_NONE
        out[1:] = table[inclusive(functions)[:-1], S_NONE]
    return out


@lru_cache(4)
def class_table(library: str = "tiktoken") -> np.ndarray:
    """Class of every code point, as the named library's Unicode tables have it (they differ in new scripts)."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))

    def members(kind: str) -> np.ndarray:
        if library == "tiktoken":
            import tiktoken

            one = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found = bytes(one.encode_ordinary(every)).decode()
        else:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            found = "".join(x for x, _ in Split(Regex(f"(?:{kind})+"), "removed", invert=True).pre_tokenize_str(every))
        return np.frombuffer(found.encode("utf-32-le"), np.uint32)

    table = np.full(0x110000, O, np.uint8)
    for kind, code in ((r"\p{L}", L), (r"\p{N}", N), (r"\s", WHITE)):
        table[members(kind)] = code
    table[ord(" ")] = SPACE
    return table


def boundaries(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts, in texts that stand one after the other in ``data``."""
    if not len(data):
        return np.empty(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[lead].astype(np.uint32) if len(lead) == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = table[code]
    n = len(kind)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True  # a document's first character, or the end
    white = (kind == SPACE) | (kind == WHITE)
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~white[1:]
    before_word &= ~first[1:]
    at = np.flatnonzero(code == ord("'"))
    if len(at):
        pad = np.append(code, [0, 0])
        same1, one, two = ~first[np.minimum(at + 1, n)], pad[at + 1], pad[at + 2]
        same2 = same1 & ~first[np.minimum(at + 2, n)]
        kind[at[same1 & np.isin(one, [ord(x) for x in SHORT])]] = A2
        for x, y in LONG:
            kind[at[same2 & (one == ord(x)) & (two == ord(y))]] = A3
    start = automaton()[3]
    state = states_before(kind + FIRST * first[:-1])
    state[first[:-1]] = S_NONE
    return lead[start[(state.astype(np.int16) * 7 + kind) * 2 + before_word] | first[:-1]]


class PairTable:
    """Products of token pairs, looked up in arrays: hashed slots, with a further table for the pairs that collide."""

    NONE = np.int64(1) << 30

    def __init__(self, pairs: dict[int, int], bits: int = 18):
        keys, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.levels, self.shift = [], np.uint64(64 - bits)
        odd = 0x9E3779B97F4A7C15
        while len(keys):
            factor = np.uint64(odd)
            slot = (keys * factor) >> self.shift
            _, first = np.unique(slot, return_index=True)
            key, value = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, self.NONE)
            key[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((factor, key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
            odd = (odd * 6364136223846793005 + 1442695040888963407) % 2**64 | 1

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), self.NONE)
        for factor, key, value in self.levels:
            slot = (keys * factor) >> self.shift
            hit = key[slot] == keys
            out[hit] = value[slot[hit]]
        return out


class Vocabulary:
    """Pieces, products of pairs (key: left id << 32 | right id; a lower product goes first), and a cache of slices."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int] | None = None):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        if pairs is None:  # ranks alone: two pieces merge if their bytes together are a piece
            pairs = {}
            for piece, rank in ranks.items():
                for i in range(1, len(piece)):
                    left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                    if left is not None and right is not None:
                        pairs[left << 32 | right] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        #: Bytes of all pieces, and where each stands there.
        self.pool = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.size = np.array(list(map(len, self.pieces)), np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.numbers = list(range(len(self.pieces)))  # one object for each id, shared by the cached tuples

    def look_up(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each of some different slices."""
        cache = self.cache
        missing = [x for x in slices if x not in cache]
        if len(cache) + len(missing) > CACHE_ENTRIES:
            cache.clear()
            missing = slices
        short = [x for x in missing if len(x) <= 64]
        cache.update(zip(short, self.merge_all(short)))
        long = {x: self.merge_long(x) for x in missing if len(x) > 64}
        if long:  # not kept: they hardly come again and may be as long as a text
            return [cache[x] if x in cache else long[x] for x in slices]
        return list(map(cache.__getitem__, slices))

    def merge_all(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """Pair merging of many short slices at once: each round joins the leftmost lowest pair of every slice."""
        out: list[tuple[int, ...]] = [()] * len(slices)
        if not slices:
            return out
        size = np.fromiter(map(len, slices), np.int64, len(slices))
        token = self.bytes[np.frombuffer(b"".join(slices), np.uint8)]
        word = np.arange(len(slices))
        value = np.full(len(token), PairTable.NONE)  # product of each token and the next one of its slice
        value[:-1] = self.table(token[:-1], token[1:])
        value[np.cumsum(size) - 1] = PairTable.NONE
        while True:
            start, n = np.cumsum(size) - size, len(token)
            low = np.minimum.reduceat(value << 32 | np.arange(n), start)
            at, product = low & 0xFFFFFFFF, low >> 32
            done = product == PairTable.NONE
            alive = np.ones(n, bool)
            if done.any():
                numbers, flat = self.numbers, token.tolist()
                for w, a, b in zip(word[done].tolist(), start[done].tolist(), (start + size)[done].tolist()):
                    out[w] = tuple([numbers[t] for t in flat[a:b]])
                alive = np.repeat(~done, size)
                if done.all():
                    return out
            at, product, size, word = at[~done], product[~done], size[~done] - 1, word[~done]
            token[at] = product
            alive[at + 1] = False
            token, value, at = token[alive], value[alive], (np.cumsum(alive) - 1)[at]
            stop = np.cumsum(size)
            value[at] = PairTable.NONE
            right, left = at[at + 1 < stop], at[at > stop - size] - 1
            value[right] = self.table(token[right], token[right + 1])
            value[left] = self.table(token[left], token[left + 1])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for a long slice in n log n: a heap of pairs over a linked list."""
        get, n = self.pairs.get, len(piece)
        token = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := get(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := get(token[i] << 32 | token[after[i]])) is not None:
                heapq.heappush(heap, (r, i, token[i], token[after[i]]))

        while heap:
            product, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j], after[i] = product, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return tuple(t for t in token if t >= 0)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary, from a file of lines "base64 rank" or a JSON file of a byte-level BPE model."""
    if path.endswith(".json"):
        return json_vocabulary(path)
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def json_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer file: pieces in the printable byte alphabet, and a list of merges whose order is the priority.

    The product of the k-th merge must have a higher id than that of the one before, as training makes it.
    """
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab, pairs, last = model["vocab"], {}, -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        product = vocab[left + right]
        if product <= last:
            raise ValueError(f"merges of {path} are not in the order of their ids")
        last = pairs[vocab[left] << 32 | vocab[right]] = product
    ranks = {bytes(byte[c] for c in piece): rank for piece, rank in vocab.items() if all(c in byte for c in piece)}
    return Vocabulary(ranks, pairs)


#: Bytes that are hashed at once.
BLOCK = 1 << 20
_ODD = 0xD1342543DE82EF95


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of an odd number and of its inverse modulo 2**64."""
    raised = [np.full(BLOCK + 1, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 2**64))]
    for x in raised:
        x[0] = 1
    return np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) * 2 + 1, *map(np.multiply.accumulate, raised)


def _sums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial of the bytes of each range of at most a block of data, by one running sum."""
    value, up, down = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return (total[stops] - total[starts]) * down[starts]


def range_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, the same wherever they stand; ranges are in order and don't overlap.

    Blocks of data are worked on one after the other, so working memory does not grow with the data. A range that goes
    on in the next block is the sum of its parts.
    """
    size = (stops - starts).astype(np.uint64)
    if len(data) <= BLOCK:
        return _sums(data, starts, stops) * np.uint64(0x9E3779B97F4A7C15) + size
    key = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data), BLOCK):
        high = min(len(data), low + BLOCK)
        a, b = int(np.searchsorted(stops, low, "right")), int(np.searchsorted(starts, high, "left"))
        if b <= a:
            continue
        part = _sums(data[low:high], np.maximum(starts[a:b], low) - low, np.minimum(stops[a:b], high) - low)
        if starts[a] < low:
            part[:1] *= np.uint64(pow(_ODD, low - int(starts[a]), 2**64))
        key[a:b] += part
    return key * np.uint64(0x9E3779B97F4A7C15) + size


def slice_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same for slices that cover ``data``."""
    return range_keys(data, starts, np.append(starts[1:], len(data)))


def distinct_slices(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one slice of each content, number of the content of every slice); slices cover ``data``.

    Contents meet by hash and are then compared byte by byte.
    """
    n, size, key = len(data), np.diff(np.append(starts, len(data))), slice_keys(data, starts)
    bits = max(8, int(len(key)).bit_length())
    slots, twin, rest, odd = np.empty(1 << bits, np.int64), np.empty(len(key), np.int64), np.arange(len(key)), 0x9E3779B97F4A7C15
    while len(rest):  # one slice of each slot speaks for its content; others of that slot try again elsewhere
        slot = (key[rest] * np.uint64(odd)) >> np.uint64(64 - bits)
        slots[slot] = rest
        twin[rest] = slots[slot]
        rest, odd = rest[key[twin[rest]] != key[rest]], (odd * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
    first = np.flatnonzero(twin == np.arange(len(key)))
    number = np.empty(len(key), np.int64)
    number[first] = np.arange(len(first))
    inverse = number[twin]
    if (size != size[twin]).any() or (data != data[np.arange(n) + np.repeat(starts[twin] - starts, size)]).any():
        raw, cuts = data.tobytes(), [*starts.tolist(), n]
        _, first, inverse = np.unique(np.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], object), return_index=True, return_inverse=True)
    return first, inverse


def encode_chunk(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids before each text, byte at which each slice starts, ids before each slice)."""
    starts = boundaries(data, offsets, table)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64), starts, np.zeros(1, np.int64)
    first, kind = distinct_slices(data, starts)
    raw, stops = data.tobytes(), np.append(starts[1:], len(data))
    found = vocab.look_up([raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())])
    length = np.fromiter(map(len, found), np.int64, len(found))
    pool = np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))
    sizes = length[kind]
    before = np.concatenate([[0], np.cumsum(sizes)])
    ids = pool[np.arange(before[-1]) + np.repeat((np.cumsum(length) - length)[kind] - before[:-1], sizes)]
    return ids, before[np.searchsorted(starts, offsets)], starts, before


def token_offsets(ids: np.ndarray, splits: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The byte of its text at which each token starts."""
    ends = np.concatenate([[0], np.cumsum(vocab.size[ids])])
    return ends[:-1] - np.repeat(ends[splits[:-1]], np.diff(splits))


def decode_chunk(ids: np.ndarray, splits: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """The bytes of each text, from its ids alone: pieces are copied to their offsets, BLOCK tokens at a time."""
    size = vocab.size[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), np.uint8)
    for low in range(0, len(ids), BLOCK):
        high = min(len(ids), low + BLOCK)
        shift = vocab.place[ids[low:high]] - ends[low:high]
        out[ends[low] : ends[high]] = vocab.pool[np.repeat(shift, size[low:high]) + np.arange(ends[low], ends[high])]
    raw, cuts = out.tobytes(), ends[splits].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_span(ids: list[int], offsets: list[int], start: int, stop: int, vocab: Vocabulary) -> bytes:
    """Bytes ``start`` to ``stop`` of a text from its ids and their offsets; only the tokens of the span are decoded."""
    if stop <= start or not ids:
        return b""
    first, last = bisect_right(offsets, start) - 1, bisect_left(offsets, stop)
    return b"".join([vocab.pieces[i] for i in ids[first:last]])[start - offsets[first] : stop - offsets[first]]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but ``text`` and clashing ones), and ids array<int>, n_tokens bigint, offsets array<bigint>
    (the byte of the text's UTF-8 form at which each token starts)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "ids", "n_tokens", "offsets")]

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        vocab = vocabulary(path)
        ids, splits, *_ = encode_chunk(data, offsets, vocab, class_table())
        return [list_array(splits, ids), pa.array(np.diff(splits)), list_array(splits, token_offsets(ids, splits, vocab))]

    return map_chunks(docs, text, kernel, "ids array<int>, n_tokens bigint, offsets array<bigint>", keep)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, ids, n_tokens, and decoded binary: the bytes that the ids stand for, found from the ids alone."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "ids", "n_tokens", "decoded")]

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        vocab = vocabulary(path)
        ids, splits, *_ = encode_chunk(data, offsets, vocab, class_table())
        return [list_array(splits, ids), pa.array(np.diff(splits)), pa.array(decode_chunk(ids, splits, vocab), pa.binary())]

    return map_chunks(docs, text, kernel, "ids array<int>, n_tokens bigint, decoded binary", keep)


def decode_spans(encoded: DataFrame, path: str, first: str, last: str, ids: str = "ids", offsets: str = "offsets", out: str = "decoded") -> DataFrame:
    """Replace or add column ``out`` (binary): bytes ``first`` to ``last`` (columns) of each encoded text. Null where one of
    the columns is null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def spans(i: pd.Series, o: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([None if x is None or y is None or pd.isna(c) or pd.isna(d) else decode_span(list(x), list(y), int(c), int(d), vocab) for x, y, c, d in zip(i, o, a, b)])

    return encoded.withColumn(out, spans(*[F.col(f"`{c}`") for c in (ids, offsets, first, last)]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace or add column ``out`` (binary): the bytes of the ids. Null ids decode to empty bytes."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    keep = [c for c in encoded.columns if c != out]
    at = len(keep)
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(at).combine_chunks() if isinstance(batch.column(at), pa.ChunkedArray) else batch.column(at)
            vocab = vocabulary(path)
            got = [b"".join([vocab.pieces[i] for i in x]) if x is not None else b"" for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(got, pa.binary())], names=schema.names)

    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
