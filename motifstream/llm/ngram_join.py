"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

A text's words are runs of letters and digits of any script, with the marks on them, in lower case; its set is that of
its runs of five words (the one run of all its words if it has fewer; the text itself if it has none). Texts with equal sets are one class, whose members are
linked by definition and never compared. Rows and bands are the cheapest pair that reaches ``RECALL`` at the threshold.

Classes meet in the buckets of their band hashes. Buckets are not expanded into pairs: each gives one link from its
smallest class to every other, components of these links are found, and the sets of a component meet in tiles, pairs
of chunks of bounded size. Inside a tile, classes that share a band are compared on their whole sets, by a product
of incidence matrices or one by one, whichever is cheaper. A tile gives one row for each class, its number of links and
its place in a spanning forest, so nothing grows with the square of a group except the comparisons themselves. The
true links' components are the result's classes. No bucket, chunk or number of partners is capped.

Texts do not move: signatures (a few hundred bytes a text) do, and sets of classes that have a candidate.

Results for odd input: null texts are empty texts; all empty texts are copies of each other; repeated rows are copies;
a null key is kept and counts as the largest; an empty table gives an empty table. ``join`` returns its own columns
only and ``near_dedup`` those of its input, so no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import list_array, map_chunks, saved, small_batches
from .bpe import slice_keys
from .components import components
from .exact_dedup import bits_for, bits_of, only_repeated
from .words import in_words, sum_by

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Classes, and members of their sets, in a chunk at most; a tile holds two chunks.
CHUNK_CLASSES, CHUNK_MEMBERS = 1024, 1_500_000


def banding(similarity: float = SIMILARITY, recall: float = RECALL, false: float = 0.3, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): of the choices that find a pair at ``similarity`` with probability ``recall``, the one with the
    fewest hashes whose chance for a pair at similarity ``false`` is at most 6 %."""
    choices = []
    for rows in range(2, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - false**rows) ** bands <= 0.06:
            choices.append((bands * rows, bands, rows))
    return min(choices)[1:]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text)."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = in_words(data, offsets)
    change = np.ones(len(data), bool)
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    is_word = inside[starts]
    places = np.concatenate([[0], np.cumsum(is_word)])
    return slice_keys(data, starts)[is_word], places[np.searchsorted(starts, offsets)]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``size`` words, runs before each text); every text has at least one."""
    words, splits = word_hashes(data, offsets)
    n = np.diff(splits)
    count = np.maximum(n - size + 1, 1)
    before = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = splits[text] + np.arange(before[-1]) - before[text]
    padded = np.append(words, np.zeros(size, np.uint64))
    key = np.full(len(first), 77, np.uint64)
    for k in range(size):
        inside = k < n[text]
        key = (key ^ np.where(inside, padded[np.minimum(first + k, len(words) + size - 1)], np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    for i in np.flatnonzero(n == 0):
        raw = data[offsets[i] : offsets[i + 1]]
        key[before[i]] = slice_keys(raw, np.zeros(1, np.int64))[0] if len(raw) else 1
    return key, before


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different runs of each text in order, runs before each text)."""
    key, before = shingles(data, offsets)
    parts = []
    for a, b in zip(before.tolist(), before[1:].tolist()):
        one = np.sort(key[a:b])
        parts.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
    return np.concatenate(parts) if parts else key, np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def set_hash(members: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each set."""
    x = (members ^ (members >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((sum_by(x, splits) + np.diff(splits).astype(np.uint64)) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def band_hashes(members: np.ndarray, splits: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes; each differs between bands too, so one column of them is enough to meet in."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(1, 2**63, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 2**63, bands * rows).astype(np.uint64) * np.uint64(2)
    out = np.empty((len(splits) - 1, bands), np.uint64)
    step = 1 << 15  # texts are taken in stretches that stay in the processor's cache
    start = 0
    while start < len(splits) - 1:
        stop = min(len(splits) - 1, max(start + 1, int(np.searchsorted(splits, splits[start] + step, "right")) - 1))
        part, at = members[splits[start] : splits[stop]], splits[start:stop] - splits[start]
        for band in range(bands):
            key = np.full(stop - start, band + 1, np.uint64)
            for row in range(band * rows, (band + 1) * rows):
                low = np.minimum.reduceat((part ^ mask[row]) * factor[row], at)
                key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(30)
            out[start:stop, band] = key
        start = stop
    return out


def signatures(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """(__key, __text_hash, __class, __size, __bands) of each row."""

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        members, splits = sets_of(data, offsets)
        found = band_hashes(members, splits, bands, rows).view(np.int64)
        lists = list_array(np.arange(len(found) + 1) * bands, found.reshape(-1))
        return [pa.array(set_hash(members, splits)), pa.array(np.diff(splits)), lists]

    source = docs.select(F.col(f"`{key}`").alias("__key"), _plain(text).alias("__low")).withColumn("__text_hash", F.xxhash64("__low"))
    return map_chunks(source, "__low", kernel, "__class bigint, __size bigint, __bands array<bigint>", ["__key", "__text_hash"])


def _plain(text: str):
    return F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def class_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(__class, __members) of the rows whose texts' hashes stand in ``wanted`` (__text_hash), and of a few more whose
    hash shares a bit with one of them."""

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        members, splits = sets_of(data, offsets)
        return [pa.array(set_hash(members, splits)), list_array(splits, members.view(np.int64))]

    low = docs.select(_plain(text).alias("__low")).withColumn("__text_hash", F.xxhash64("__low"))
    bits = bits_for(wanted.count())
    low = only_repeated(low, F.struct(F.col("__text_hash")), bits_of(wanted, F.struct(F.col("__text_hash")), bits), bits, "__wanted").where("__wanted")
    return map_chunks(low, "__low", kernel, "__class bigint, __members array<bigint>", [])


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, near: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix: which of the pairs marked in ``near`` are similar enough.

    right: None for left against itself, where no set may be asked about itself.
    """
    other = left if right is None else right
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in other])
    # A pair can only reach the threshold if the smaller set is large enough.
    near = near & (np.minimum(size_l[:, None], size_r[None]) >= similarity * np.maximum(size_l[:, None], size_r[None]) - 1e-9)
    out = np.zeros(near.shape, bool)
    i, j = np.nonzero(near)
    if not len(i):
        return out
    both = np.concatenate([*left, *([] if right is None else right)])
    rows = np.repeat(np.arange(len(left) + (0 if right is None else len(right))), [*size_l, *([] if right is None else size_r)])
    shared = np.empty(len(i), np.int64)
    ids, number, counts = np.unique(both, return_inverse=True, return_counts=True)
    often = counts > 1
    width = int(often.sum())
    if len(i) * 3e-5 <= len(left) * len(other) * width * 1e-10 + 1e-3:
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            shared[k] = len(np.intersect1d(left[a], other[b], assume_unique=True))
    else:
        column = np.cumsum(often) - 1
        keep = often[number]
        col, row = column[number[keep]], rows[keep]
        order = np.argsort(col)
        col, row = col[order], row[order]
        product = np.zeros(near.shape, np.float32)
        for start in range(0, width, 2048):
            a, b = np.searchsorted(col, [start, start + 2048])
            block = np.zeros((int(rows[-1]) + 1, min(2048, width - start)), np.float32)
            block[row[a:b], col[a:b] - start] = 1
            product += block[: len(left)] @ (block if right is None else block[len(left) :]).T
        shared = np.rint(product[i, j]).astype(np.int64)
    hit = shared >= similarity * (size_l[i] + size_r[j] - shared) - 1e-9
    out[i[hit], j[hit]] = True
    return out


def _tile(rows: list[tuple], similarity: float) -> list[tuple[int, int, int, int]]:
    """(class, linked rows, linked classes, smallest class of its part) of the classes with a link in this tile.

    rows: (class, side, rows of the class, bands, members); side 2: one chunk against itself.
    """
    one = rows[0][1] == 2
    left = [r for r in rows if r[1] != 1]
    right = left if one else [r for r in rows if r[1] == 1]
    if not left or not right:
        return []
    bands_l, bands_r = np.array([r[3] for r in left]), np.array([r[3] for r in right])
    near = np.zeros((len(left), len(right)), bool)
    for band in range(bands_l.shape[1]):
        near |= bands_l[:, band][:, None] == bands_r[None, :, band]
    if one:
        near = np.triu(near, 1)
    hits = compare([r[4] for r in left], None if one else [r[4] for r in right], near, similarity)
    hits = hits | hits.T if one else hits
    weight_l, weight_r = np.array([r[2] for r in left]), np.array([r[2] for r in right])
    ids_l, ids_r = np.array([r[0] for r in left]), np.array([r[0] for r in right])
    root_l, root_r = ids_l.copy(), ids_r.copy()
    big = np.iinfo(np.int64).max
    while True:  # smallest class of each part of this tile's links
        new_l = np.minimum(root_l, np.where(hits, root_r[None], big).min(1))
        new_r = new_l if one else np.minimum(root_r, np.where(hits, new_l[:, None], big).min(0))
        if (new_l == root_l).all() and (new_r == root_r).all():
            break
        root_l, root_r = new_l, new_r
    sides = [(ids_l, hits @ weight_r, hits.sum(1), root_l)]
    if not one:
        sides.append((ids_r, hits.T @ weight_l, hits.sum(0), root_r))
    return [(int(c), int(n), int(k), int(m)) for side in sides for c, n, k, m in zip(*side) if k]


def verified(tiles: DataFrame, similarity: float) -> DataFrame:
    """(__class, rows, classes, other) from rows of tiles: __component, __i, __j, __class, __side, __n, __bands, __members."""
    schema = "__class bigint, rows bigint, classes bigint, other bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = _tile(rows, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], names=["__class", "rows", "classes", "other"])

        now, held = None, []
        for batch in batches:
            c, i, j, cls, side, n = (batch.column(k).to_pylist() for k in range(6))
            bands, members = (batch.column(k) for k in (6, 7))
            for r in range(batch.num_rows):
                if (c[r], i[r], j[r]) != now:
                    if held:
                        yield done(held)
                    now, held = (c[r], i[r], j[r]), []
                held.append((cls[r], side[r], n[r], bands[r].values.to_numpy().copy(), members[r].values.to_numpy().copy().view(np.uint64)))
        if held:
            yield done(held)

    small_batches(tiles.sparkSession)
    return tiles.mapInArrow(run, schema)


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(__key, __text_hash, class_id, class_size, n_links, n_linked_texts) of each row.

    class_id: the smallest key among all rows that are linked to each other, directly or through others.
    n_links: rows that this row is linked with, copies too; n_linked_texts: different sets that its set is linked with.
    """
    bands, rows = banding(similarity, recall)
    signed = saved(signatures(docs, key, text, bands, rows))
    sets = signed.groupBy("__class").agg(F.count("*").alias("__n"), F.first("__size").alias("__size"), F.first("__bands").alias("__bands"), F.min("__text_hash").alias("__text_hash"), F.min("__key").alias("__least"))
    sets = saved(sets)
    met = sets.select("__class", F.explode("__bands").alias("__bucket"))
    leaders = met.groupBy("__bucket").agg(F.count("*").alias("n"), F.min("__class").alias("__leader"), F.first("__bucket").alias("__same")).where("n > 1")
    star = met.join(leaders.select("__same", "__leader"), F.col("__bucket") == F.col("__same")).where("__class <> __leader").select("__class", "__leader").distinct()
    near = components(star, "__class", "__leader")
    near = near.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    candidates = saved(sets.join(near, sets["__class"] == near["__node"]).drop("__node"))
    load = candidates.groupBy("__component").agg(F.count("*").alias("k"), F.sum("__size").alias("m"))
    load = load.select(F.concat(F.col("__component").cast("string"), F.lit("")).alias("__of"), F.greatest(F.ceil(F.col("k") / CHUNK_CLASSES), F.ceil(F.col("m") / CHUNK_MEMBERS)).cast("int").alias("__chunks"))
    placed = candidates.join(load, F.col("__component").cast("string") == F.col("__of")).withColumn("__chunk", F.pmod(F.xxhash64("__class"), F.col("__chunks").cast("long")).cast("int"))
    members = class_sets(docs, text, candidates.select("__text_hash")).groupBy("__class").agg(F.first("__members").alias("__members"), F.first("__class").alias("__node"))
    full = placed.join(members.select("__node", "__members"), placed["__class"] == F.col("__node"))
    # Each chunk goes to the tiles of every pair that it belongs to.
    tile = F.transform(F.sequence(F.lit(0), F.col("__chunks") - 1), lambda o: F.struct(F.least(F.col("__chunk"), o).alias("i"), F.greatest(F.col("__chunk"), o).alias("j")))
    tiles = full.withColumn("__tile", F.explode(tile)).select(
        "__component", F.col("__tile.i").alias("__i"), F.col("__tile.j").alias("__j"), "__class",
        F.when(F.col("__tile.i") == F.col("__tile.j"), 2).when(F.col("__chunk") == F.col("__tile.i"), 0).otherwise(1).alias("__side"), "__n", "__bands", "__members")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(spread, "__component", "__i", "__j").sortWithinPartitions("__component", "__i", "__j")
    # The rows of a tile are few: they are gathered before they are written, else every tile task writes a file.
    links = saved(verified(tiles, similarity).hint("rebalance"))
    count = links.groupBy("__class").agg(F.sum("rows").alias("rows"), F.sum("classes").alias("classes"))
    true = components(links, "__class", "other")
    info = sets.select("__class", "__n", "__least").join(count.select(F.col("__class").alias("__counted"), "rows", "classes"), F.col("__class") == F.col("__counted"), "left")
    info = info.join(true, F.col("__class") == F.col("node"), "left").select("__class", "__n", "__least", F.coalesce("component", "__class").alias("__root"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("classes", F.lit(0)).alias("classes"))
    info = saved(info)
    roots = info.groupBy("__root").agg(F.min("__least").alias("class_id"), F.sum("__n").alias("class_size"), F.first("__root").alias("__of"))
    named = info.join(roots.select("__of", "class_id", "class_size"), F.col("__root") == F.col("__of")).select(F.col("__class").alias("__in"), "class_id", "class_size", (F.col("__n") - 1 + F.col("rows")).alias("n_links"), F.col("classes").alias("n_linked_texts"))
    return signed.join(named, signed["__class"] == named["__in"]).select("__key", "__text_hash", "class_id", "class_size", "n_links", "n_linked_texts")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``key``, class_id, class_size, n_links, n_linked_texts of each row."""
    return classes_of(docs, key, text, similarity, recall).select(F.col("__key").alias(key), "class_id", "class_size", "n_links", "n_linked_texts")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest key (of equal keys, the largest hash of all columns).

    Rows whose class has no other row pass through without a shuffle.
    """
    columns = docs.columns
    found = classes_of(docs, key, text, similarity, recall).where("class_size > 1")
    # One text hash stands for one class.
    inside = saved(found.groupBy("__text_hash").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id")).getField("class_id").alias("class_id")))
    rows = docs.withColumn("__text_hash", F.xxhash64(_plain(text)))
    bits = bits_for(inside.count())
    rows = only_repeated(rows, F.struct(F.col("__text_hash")), bits_of(inside, F.struct(F.col("__text_hash")), bits), bits, "__inside")
    chosen = [F.col(f"`{c}`") for c in columns]
    order = F.struct(F.col(f"`{key}`").isNull().alias("a"), F.col(f"`{key}`").alias("b"), (-F.xxhash64(*chosen).cast("decimal(20,0)")).alias("c"))
    joined = rows.where("__inside").select(F.struct(*chosen).alias("__row"), order.alias("__order"), "__text_hash")
    joined = joined.join(inside.select(F.col("__text_hash").alias("__same"), "class_id"), F.col("__text_hash") == F.col("__same"), "left")
    # Rows that only share a bit with a class are groups of their own.
    best = joined.where("__same IS NOT NULL").groupBy("class_id").agg(F.min_by("__row", "__order").alias("__row"))
    alone = joined.where("__same IS NULL").select("__row")
    kept = best.select("__row").unionByName(alone).select(*[F.col(f"__row.`{c}`") for c in columns])
    return rows.where("NOT __inside").select(*chosen).unionByName(kept)
