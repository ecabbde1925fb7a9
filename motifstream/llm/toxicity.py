"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its ends marked) and of itself, each hashed to a bucket that has an
embedding; a text is the average over all of them. Embeddings and the softmax layer are trained together by Adam on
whole labelled texts, so a misspelling of a word shares most of its vectors. Embeddings are weighted by how rare their
bucket is, and a penalty on their lengths (a group lasso) lets those grow whose gradient stands out, so that a few hundred labels are
of use and a text of common subwords alone is not judged by them. Since everything after the embeddings is linear, scoring first multiplies each embedding by the layer: one number for each bucket, 2**20 at most, is broadcast.

Training takes a bounded sample of the labelled rows of the learning folds: ``per_class`` texts of each class, of at
most ``MAX_TRAIN_BYTES`` each. Rows whose crc32(doc_id as text) mod 4 is 2 are held out. Scores never see doc_id.

Results for odd input: a null, empty or wordless text gets the score of the layer's bias, the odds of the class in
training; a null doc_id counts as held out; repeated rows get equal scores; without labelled rows of both classes every score is
the share of label 1 (0 if there is none); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import map_chunks, text_chunks
from .words import chunk_words, code_points, sum_by

BUCKETS = 2**18
NGRAMS = (3, 4, 5)
DIMENSIONS = 4
PER_CLASS = 1500
MAX_TRAIN_BYTES = 32_768
#: Buckets that fewer training texts have stay zero.
LEAST_TEXTS = 3
#: Subwords of no meaning that every text has besides its own, so that a few words alone do not decide.
EXTRA = 60
THRESHOLD = 0.3


def held_out(key: Column) -> Column:
    """The fold that nothing is learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number of buckets before each word) of the n-grams of each word and of the word itself."""
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    code = code_points(words).astype(np.uint64)
    brk = code == 10
    word = np.cumsum(brk) - 1
    ids, owner = [], []
    for n in NGRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        key, valid = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            key = (key ^ code[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            if 0 < k < n - 1:
                valid &= ~brk[k : k + m]
        ids.append((key[valid] >> np.uint64(20)) % np.uint64(BUCKETS))
        owner.append(word[1 : m + 1][valid] - brk[1 : m + 1][valid])
    at = np.flatnonzero(brk)
    x = (code + np.uint64(77)) * np.uint64(0xD1342543DE82EF95)  # of the word: an order-dependent sum of mixed letters
    x = (x ^ (x >> np.uint64(31))) * (np.arange(len(code), dtype=np.uint64) - at[word].astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.add.reduceat(x[:-1], at[:-1])
    ids.append(((whole ^ (whole >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(BUCKETS))
    owner.append(np.arange(len(words)))
    every, owner = np.concatenate(ids).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return every[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


@dataclass
class Model:
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """Of each bucket: how far it pulls the logit of class 1 over class 0."""
        way = self.layer[:, 1] - self.layer[:, 0]
        return (self.embedding @ way).astype(np.float32), float(self.bias[1] - self.bias[0])


#: Terms that a training step adds up at once.
TERMS = 1 << 20


def _sums(values: np.ndarray, index: np.ndarray, target: np.ndarray, size: int, scale: np.ndarray | None = None) -> np.ndarray:
    """Product of a sparse matrix and ``values``, which like the result holds a row for each dimension: sums of
    values[:, index] (each times its scale) by target, TERMS terms at a time."""
    out = np.zeros((len(values), size))
    for low in range(0, len(index), TERMS):
        part, to = index[low : low + TERMS], target[low : low + TERMS]
        for row, column in zip(values, out):
            column += np.bincount(to, row[part] if scale is None else row[part] * scale[low : low + TERMS], size)
    return out


def train(texts: list[str], labels: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 90, rate: float = 0.08, decay: float = 3e-5, penalty: float = 0.2, true_share: float | None = None, seed: int = 11) -> Model:
    """Joint training of embeddings and softmax on whole texts, all texts in each round.

    penalty: on the length of each bucket's vector, as a share of the longest gradient of the first round.
    true_share: of label 1 among all texts, where ``texts`` hold more of them; scores are moved to it at the end.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    edge = min(max(share, 1e-6), 1 - 1e-6)
    bias = np.array([np.log(1 - edge), np.log(edge)])
    model = Model(np.zeros((BUCKETS, dimensions), np.float32), np.zeros((dimensions, 2)), bias)
    if len(labels) == 0 or share in (0.0, 1.0):
        return model
    # Texts as counts of words, words as bags of buckets.
    words, known, rows, cols = [], {}, [], []
    row = 0
    for start, stop, data, offsets in text_chunks(pa.array([t.lower() for t in texts], pa.string())):
        found, at, splits = chunk_words(data, offsets)
        number = np.array([known.setdefault(w, len(known)) for w in found], np.int64)
        rows.append(np.repeat(np.arange(row, row + stop - start), np.diff(splits)))
        cols.append(number[at])
        row += stop - start
    words = list(known)
    moved = np.zeros(2)
    if true_share is not None and 0 < true_share < 1:
        moved += [np.log((1 - true_share) / (1 - edge)), np.log(true_share / edge)]
    if not words:
        bias += moved
        return model
    pair, count = np.unique(np.concatenate(rows) * len(words) + np.concatenate(cols), return_counts=True)
    row, col = pair // len(words), pair % len(words)
    parts = []
    for i in range(0, len(words), 20_000):  # a part's working arrays at a time
        found, splits = subwords(words[i : i + 20_000])
        parts.append((found.astype(np.int32), np.diff(splits).astype(np.int32)))
    buckets, bag = (np.concatenate(x) for x in zip(*parts))
    # Buckets seen in enough texts; renumbered, so that the parameters are dense.
    per_word = np.repeat(np.arange(len(words), dtype=np.int32), bag)
    texts_of_word = np.bincount(col, minlength=len(words))
    seen = np.bincount(buckets, texts_of_word[per_word], BUCKETS)
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    dense = np.full(BUCKETS, -1, np.int32)
    dense[used] = np.arange(len(used))
    keep = dense[buckets] >= 0
    b, w = dense[buckets[keep]], per_word[keep]
    del parts, buckets, per_word, keep
    size = np.bincount(row, count * bag[col], len(texts)) + EXTRA
    share_of = count / size[row]
    rare = np.clip(np.log(len(texts) / seen[used]) / np.log(max(len(texts) / LEAST_TEXTS, 2)), 0, 1)[:, None]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (len(used), dimensions))
    v = rng.normal(0, 0.3, (dimensions, 2))
    target = np.stack([1 - labels, labels], 1).astype(float)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, v, bias)]
    gain = 20.0  # toxic words are few among many: logits of an average need large vectors
    row, col, share_of = row.astype(np.int32), col.astype(np.int32), share_of.astype(np.float32)
    del pair, count
    for t in range(1, rounds + 1):
        vec = _sums((e * rare).T.copy(), b, w, len(words))
        mean = gain * _sums(vec, col, row, len(texts), share_of).T
        logit = mean @ v + bias
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        off = (prob - target) / len(texts)
        to_word = _sums((gain * (off @ v.T)).T.copy(), row, col, len(words), share_of)
        to_e = _sums(to_word, w, b, len(used)).T * rare
        if t == 1:
            shrink = penalty * np.sqrt((to_e**2).sum(1)).max(initial=0)
        to_e += decay * e + shrink * e / (np.sqrt((e**2).sum(1, keepdims=True)) + 1e-3)
        for x, g, m in zip((e, v, bias), (to_e, mean.T @ off, off.sum(0)), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            x -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    model.embedding[used], model.layer = e * rare * gain, v
    bias += moved
    return model


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> tuple[list[str], np.ndarray, float | None]:
    """About ``per_class`` texts of each class from the learning folds, chosen by the hash of their key, twice as many at
    most; and the share of label 1 among all labels of those folds."""
    fold = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(~held_out(F.col("__key")) & F.col("__label").isin(0, 1))
    counts = {r["__label"]: r["n"] for r in fold.groupBy("__label").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64("__key", F.lit(5)), F.lit(1_000_000))
    parts = [fold.where((F.col("__label") == k) & (place < int(min(1.0, per_class / n) * 1_000_000))).limit(2 * per_class) for k, n in sorted(counts.items())]
    if not parts:
        return [], np.empty(0, int), None
    picked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.octet_length("__text") <= MAX_TRAIN_BYTES)
    # At most 4 * per_class keys are broadcast.
    found = rows.join(F.broadcast(picked), "__key").select("__text", "__label", "__key").limit(4 * per_class).collect()
    found.sort(key=lambda r: (r["__key"], r["__label"], r["__text"]))
    return [r["__text"] for r in found], np.array([r["__label"] for r in found], int), counts.get(1, 0) / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    texts, marks, share = training_sample(docs, labels, key, text, label, per_class)
    return train(texts, marks, true_share=share)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keep`` (all columns but ``out``) and ``out``: the probability of class 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    weights, bias = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**18 numbers

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        words, at, splits = chunk_words(data, offsets)
        buckets, bags = subwords(words)
        # Fixed-point sums: a text's score does not depend on its neighbours in the batch.
        pull = sum_by((shared.value[buckets].astype(np.float64) * 2**20).astype(np.int64), bags)
        total = sum_by(pull[at], splits) / 2.0**20
        n = sum_by(np.diff(bags)[at], splits)
        return [pa.array(1 / (1 + np.exp(-np.clip(total / (n + EXTRA) + bias, -60, 60))))]

    source = docs.withColumn("__lower", F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return map_chunks(source, "__lower", kernel, f"`{out}` double", keep)


def with_predictions(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and held_out, score, predicted."""
    keep = [key] if keep is None else keep
    found = score(docs, model, text, [c for c in keep if c not in ("held_out", "predicted")])
    return found.select(*[F.col(f"`{c}`") for c in keep if c in found.columns and c != "score"], held_out(F.col(f"`{key}`")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
