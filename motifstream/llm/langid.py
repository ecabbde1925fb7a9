"""Language identification by interpolated Kneser-Ney character models, one for each language.

A word is a sequence of characters between two end marks; a model gives each character and the closing mark a
probability after up to ORDER - 1 characters of that word. A language keeps one sorted array of n-gram hashes for each
order; beside it stand the log probability of the n-gram and the weight with which a context falls back to the shorter
one (the interpolated estimates written in back-off form, which is exact). A text goes to the language of the lowest
cross-entropy for each character. ``accepted`` says whether that is below the language's limit, the entropy that
CALIBRATION of its calibration texts stay under.

Every language of the learning folds is learnt, each in a task of its own, from about PER_LANGUAGE of its texts of at
most MAX_TRAIN_BYTES, chosen by hash, or from its shortest text if all are longer; every fifth text calibrates. A model is
thus bounded for each language, and the broadcast of all of them by the number of languages. Rows whose crc32(doc_id as
text) mod 4 is 2 are held out.

Results for odd input: a null text or one without a letter is ``und`` with score 0; a null doc_id counts as held out;
without anything to learn from every text is ``und``; a language without a word in its texts is not learnt; equal texts
get equal results; an empty table gives an empty table; columns with the names of result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import map_chunks, saved, text_chunks
from .toxicity import held_out
from .words import chunk_words, code_points, sum_by

ORDER = 5
PER_LANGUAGE = 400
MAX_TRAIN_BYTES = 32_768
CALIBRATION = 0.995
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose entropies a worker keeps; a full cache is emptied.
CACHE_WORDS = 200_000


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER, the hash of the n characters that end at each place; 0 where they would cross a word's start.

    ``code``: words between line feeds; the line feed before a word is its opening mark, the one after it its closing one.
    """
    code = code.astype(np.uint64) + np.uint64(1)
    brk = code == 11
    place = np.arange(len(code))
    opened = np.maximum.accumulate(np.where(brk, place, 0))
    depth = place - opened  # characters since the opening mark
    depth[1:][brk[1:]] = np.diff(np.flatnonzero(brk))  # a closing mark belongs to the word before it
    out, key = [], np.zeros(len(code), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[n - 1 :] = code[: max(0, len(code) - n + 1)]
        key = (key ^ (shifted + np.uint64(n * 1_114_200))) * MIX
        key = key ^ (key >> np.uint64(32))
        out.append(np.where((depth >= n - 1) & (place > 0), np.maximum(key, np.uint64(1)), np.uint64(0)))
    return out


@dataclass
class Language:
    name: str
    hashes: list[np.ndarray]  # of each order, sorted
    logp: list[np.ndarray]  # float32
    back: list[np.ndarray]  # float32: log weight of the shorter context; 0 where the n-gram is no context
    start_back: float  # the same for the opening mark
    unseen: float  # log probability of an unknown character
    limit: float = np.inf


class Model:
    def __init__(self, languages: list[Language]):
        self.languages = languages
        self.limits = np.array([x.limit for x in languages])
        self.known: dict[bytes, int] = {}
        self.nats = np.empty((0, len(languages)), np.int64)
        self.size = np.empty(0, np.int64)

    def __getstate__(self) -> dict:
        return {"languages": self.languages}  # without the cache

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["languages"])

    def entropies(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(nats of each word in each language, characters of each word with its closing mark)."""
        if len(self.known) > CACHE_WORDS:
            self.__init__(self.languages)
        new = [w for w in words if w not in self.known]
        if new:
            nats, size = self._entropies(new)
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.nats, self.size = np.concatenate([self.nats, nats]), np.concatenate([self.size, size])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.nats[at], self.size[at]

    def _entropies(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        code = code_points(words)
        grams, count = gram_hashes(code), len(self.languages)
        best = np.tile(np.array([x.unseen for x in self.languages], np.float32), (len(code), 1))
        context = np.zeros((len(code), count), np.float32)
        mark = np.flatnonzero(code == 10)
        for n, places in enumerate(grams):
            valid = np.flatnonzero(places)
            # Each different n-gram is looked up once, in order.
            different, of = np.unique(places[valid], return_inverse=True)
            if n:
                best[valid] += context[valid - 1]
            wider = np.zeros((len(code), count), np.float32)
            for k, x in enumerate(self.languages):
                table = x.hashes[n]
                at = np.minimum(np.searchsorted(table, different), max(len(table) - 1, 0))
                known = table[at] == different if len(table) else np.zeros(len(different), bool)
                place = valid[known[of]]
                row = at[of[known[of]]]
                best[place, k] = x.logp[n][row]
                wider[place, k] = x.back[n][row]
            context = wider
            if n == 0:
                # A word's closing mark is the next word's opening one, which is a context of its own.
                context[mark] = np.array([x.start_back for x in self.languages], np.float32)
        nats = np.round(-best[1:].astype(np.float64) * 2**24).astype(np.int64)  # whole numbers: sums in any order agree
        return sum_by(nats, mark), np.diff(mark + 1)


def _estimate(code: np.ndarray, discount: float = 0.75) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (hashes, log probabilities, log fall-back weights as a context) of one language's words."""
    grams = gram_hashes(code)
    places = np.arange(len(code))
    counted, probs = [], []
    for n in range(1, ORDER + 1):
        ok = grams[n - 1] != 0
        here, first, counts = np.unique(grams[n - 1][ok], return_index=True, return_counts=True)
        counted.append((here, places[ok][first], counts))
    # Raw counts at the highest order (and where an n-gram starts at the opening mark), continuation counts below.
    use = [None] * ORDER
    use[ORDER - 1] = counted[-1][2].astype(float)
    brk = code == 10
    opened = np.maximum.accumulate(np.where(brk, places, 0))
    depth = places - opened
    depth[1:][brk[1:]] = np.diff(np.flatnonzero(brk))
    for n in range(1, ORDER):
        here, at, counts = counted[n - 1]
        longer, where, _ = counted[n]
        kinds = np.bincount(np.searchsorted(here, grams[n - 1][where]), minlength=len(here)).astype(float)
        use[n - 1] = np.where(depth[at] == n - 1, counts, np.maximum(kinds, 1)) if n > 1 else np.maximum(kinds, 1)
    out, lower = [], None
    backs: list[np.ndarray] = [np.zeros(len(c[0])) for c in counted]
    start_back = 0.0
    for n in range(1, ORDER + 1):
        here, at, _ = counted[n - 1]
        if n == 1:
            total, kinds = use[0].sum(), len(here)
            p = np.maximum(use[0] - discount, 0) / total + discount * kinds / total / (kinds + 1)
            unseen = discount * kinds / total / (kinds + 1)
        else:
            shorter = grams[n - 2]  # the context ends one place earlier
            key = shorter[at - 1].copy()
            start = key == 0  # the opening mark at the very beginning has no hash of its own
            if n == 2:
                key[code[at - 1] == 10] = 0
                start = code[at - 1] == 10
            contexts, index = np.unique(key, return_inverse=True)
            total, kinds = np.bincount(index, use[n - 1]), np.bincount(index)
            weight = discount * kinds / total
            suffix = np.searchsorted(counted[n - 2][0], grams[n - 2][at])
            p = np.maximum(use[n - 1] - discount, 0) / total[index] + weight[index] * lower[suffix]
            real = contexts != 0
            backs[n - 2][np.searchsorted(counted[n - 2][0], contexts[real])] = np.log(weight[real])
            if n == 2 and start.any():
                start_back = float(np.log(weight[~real][0]))
        probs.append(p)
        lower = p
    for n in range(ORDER):
        out.append((counted[n][0], np.log(probs[n]), backs[n]))
    out.append((np.array([np.log(unseen)]), np.array([start_back]), np.empty(0)))
    return out


def _words(texts: list[str]) -> list[bytes]:
    out = []
    for _, _, data, offsets in text_chunks(pa.array([t.lower() for t in texts], pa.string())):
        words, at, _ = chunk_words(data, offsets)
        out += [words[i] for i in at]
    return out


def train_language(name: str, texts: list[str]) -> Language | None:
    """The model of one language; None if its texts hold no word."""
    learn = [t for i, t in enumerate(texts) if i % 5 or len(texts) < 5]
    words = _words(learn)
    if not words:
        return None
    parts = _estimate(code_points(words))
    grams = parts[:ORDER]
    found = Language(name, [p[0] for p in grams], [p[1].astype(np.float32) for p in grams], [p[2].astype(np.float32) for p in grams], float(parts[ORDER][1][0]), float(parts[ORDER][0][0]))
    held, model = [t for i, t in enumerate(texts) if not (i % 5 or len(texts) < 5)] or texts, Model([found])
    scores = [score_texts(model, [t])[0][0, 0] for t in held[:200]]
    found.limit = float(np.quantile([v for v in scores if np.isfinite(v)] or [np.inf], CALIBRATION))
    return found


def train(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    models = [train_language(x, [t for t, l in zip(texts, languages) if l == x]) for x in names]
    return Model([x for x in models if x is not None])


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [score_chunk(model, data, offsets) for _, _, data, offsets in text_chunks(pa.array([t.lower() for t in texts], pa.string()))]
    return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


def score_chunk(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nats for each character of every text and language, infinite without words; characters)."""
    words, at, splits = chunk_words(data, offsets)
    if not words:
        return np.full((len(offsets) - 1, len(model.languages)), np.inf), np.zeros(len(offsets) - 1, np.int64)
    nats, size = model.entropies(words)
    total, n = sum_by(nats[at], splits) / 2.0**24, sum_by(size[at], splits)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n[:, None] > 0, total / n[:, None], np.inf), n


def training_sample(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(__lang, __key, __text): about ``per_language`` texts of each language, chosen by hash."""
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & ~held_out(F.col("__key")) & F.col("__text").isNotNull())
    short = F.octet_length("__text") <= MAX_TRAIN_BYTES
    size = F.struct(F.octet_length("__text").alias("bytes"), F.xxhash64("__key").alias("key"))
    # One row for each language, of known size before it is joined.
    counts = saved(rows.groupBy("__lang").agg(F.count(F.when(short, True)).alias("n"), F.min(size).alias("least")).withColumnRenamed("__lang", "__of"))
    place = F.pmod(F.xxhash64("__key", F.lit(9)), F.lit(1_000_000)) / 1_000_000
    chosen = F.when(F.col("n") > 0, short & (place * F.col("n") < per_language)).otherwise(size == F.col("least"))
    return rows.join(counts, F.col("__lang") == F.col("__of")).where(chosen).select("__lang", "__key", "__text")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Languages are trained side by side in the cluster; their models, of bounded size each, come to the driver."""
    schema = "name string, n int, hashes binary, logp binary, back binary, start_back double, unseen double, edge double"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__key", "__text"])
        found = train_language(rows["__lang"].iloc[0], rows["__text"].tolist())
        made = [] if found is None else [(found.name, n, *(x[n].tobytes() for x in (found.hashes, found.logp, found.back)), found.start_back, found.unseen, found.limit) for n in range(ORDER)]
        return pd.DataFrame(made, columns=["name", "n", "hashes", "logp", "back", "start_back", "unseen", "edge"])

    parts: dict[str, list] = {}
    for r in training_sample(docs, key, text, lang, per_language).groupBy("__lang").applyInPandas(one, schema).collect():
        parts.setdefault(r["name"], []).append(r)
    models = []
    for name in sorted(parts):
        by = sorted(parts[name], key=lambda r: r["n"])
        arrays = [[np.frombuffer(r[c], kind) for r in by] for c, kind in (("hashes", np.uint64), ("logp", np.float32), ("back", np.float32))]
        models.append(Language(name, *arrays, by[0]["start_back"], by[0]["unseen"], by[0]["edge"]))
    return Model(models)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all but ``text`` and clashing ones), lang_pred, score, entropy (nats for each character), accepted."""
    own = {"lang_pred", "score", "entropy", "accepted"}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded size for each language

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        model = shared.value
        rows = len(offsets) - 1
        if not model.languages:
            return [pa.array(["und"] * rows), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64()), pa.array(np.zeros(rows, bool))]
        per, n = score_chunk(model, data, offsets)
        per = np.where(n[:, None] > 0, per, 0)
        best = per.argmin(1)
        low = per[np.arange(rows), best]
        odds = np.exp(-(per - low[:, None]) * np.minimum(n, 100)[:, None]).sum(1)
        names = np.array([*[x.name for x in model.languages], "und"], object)
        return [pa.array(names[np.where(n > 0, best, -1)], pa.string()), pa.array(np.where(n > 0, 1 / odds, 0)), pa.array(low, mask=n == 0), pa.array((n > 0) & (low <= model.limits[best]))]

    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.withColumn("__lower", F.when(plain.rlike(r"\p{L}"), F.lower(plain)).otherwise(""))
    return map_chunks(source, "__lower", kernel, "lang_pred string, score double, entropy double, accepted boolean", keep)
