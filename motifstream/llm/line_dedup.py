"""Line de-duplication: a suffix array over line ids, its longest-common-prefix intervals, later copies deleted.

Suffix array: ranks of the suffixes come from distributed prefix doubling. A place's rank over 2k lines is the rank, in
sorted order, of its pair of ranks over k lines, at the place and k lines on. Only places whose lines are repeated go
on to the next round; the others' order is settled. Places of one rank over k lines are an interval of the array whose
longest common prefix is k lines at least.

Intervals: from the longest step to the shortest, places that share a prefix are parted by the rank of what follows it,
which gives the intervals of longer prefixes. The first place of an interval stays behind as the one that later steps
may meet; the other places go on and have the prefix in common with an earlier place. The longest such prefix of a place
is its repeated run; if it has ``min_words`` words, it is a later copy, and its lines are deleted. Lines of runs that
overlap are merged into stretches before they become rows.

Prefixes need not be longer than the longest of the shortest runs of ``min_words`` words that start at some line: a
longer run is deleted by the runs that start inside it.

Earlier means a smaller (key, hash of the text, line); a null key is the largest. All work is DataFrame functions;
texts move only when they change. Lines are what line feeds separate; words are what white space separates.

Results for odd input: a null text stays null and an empty one empty; equal rows are one document and are cleaned
alike; a text may become empty; very long documents and long stretches of empty lines are handled line by line (one
window over a document's repeated lines); a very frequent line or passage is aggregated before it is shuffled; an empty
table gives an empty table; extra columns pass through, whatever their names (those that begin with two underscores and
the counting column apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import forget, saved
from .exact_dedup import bits_for, bits_of, only_repeated, repeated_bits

MIN_WORDS = 50
#: Different lines of a document that the bitmap of repeated lines is sized for.
LINES = 16


def _document(docs: DataFrame, key: str, text: str) -> DataFrame:
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"__key": F.col(f"`{key}`"), "__hash": F.xxhash64(plain), "__plain": plain})


def _lines(rows: DataFrame) -> DataFrame:
    """(__key, __hash, line, id, words): id is null-free; two 64-bit hashes of the line."""
    each = rows.select("__key", "__hash", F.posexplode(F.split("__plain", "\n")).alias("line", "content"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return each.select("__key", "__hash", "line", F.struct(F.xxhash64("content").alias("a"), F.xxhash64("content", F.lit(1)).alias("b")).alias("id"), words.alias("words"))


def _ranked(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with column rank: of ``columns`` in sorted order, where they came more than once. Saved."""
    groups = pairs.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1").select(*columns)
    # After a range partitioned sort the ids increase with the order of the rows.
    order = saved(groups.orderBy(*columns).select(*[F.col(c).alias(f"__{c}") for c in columns], F.monotonically_increasing_id().alias("rank")))
    out = saved(pairs.join(order, [pairs[c] == order[f"__{c}"] for c in columns]).drop(*columns, *[f"__{c}" for c in columns]))
    forget(order)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """(__key, __hash, doc, base) from (__key, __hash, size): documents numbered in order, and the sum of the sizes of
    those before. Saved."""
    order = saved(docs.orderBy(F.col("__key").isNull(), "__key", "__hash").select("__key", "__hash", "size", F.monotonically_increasing_id().alias("doc")))
    # The ids hold the partition in their upper bits: a row for each partition, then sums inside each.
    part = order.withColumn("__p", F.shiftright("doc", 33))
    sums = part.groupBy("__p").agg(F.sum("size").alias("__s"))
    before = sums.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("__p").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = saved(part.withColumn("__inside", inside).join(before, F.col("__p") == F.col("__q")).select("__key", "__hash", "doc", (F.col("__before") + F.col("__inside")).alias("base")))
    forget(order)
    return out


def repeated_places(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((place, doc, words, rank) of the lines that come more than once, (__key, __hash, doc, base)); both saved.

    A place is its document's base plus its line, so places have the order of (key, hash, line), the next line is the
    next place, and no document's last place has another one's right behind it.
    """
    rows = _document(docs, key, text)
    every = _lines(rows)
    bits = bits_for(LINES * docs.count())
    some = only_repeated(every, F.struct("id"), repeated_bits(every, F.struct("id"), bits), bits, "__again").where("__again")
    # Equal rows are one document.
    once = some.groupBy("__key", "__hash", "line").agg(F.first("id").alias("id"), F.first("words").alias("words"))
    once = saved(once.select("__key", "__hash", "line", F.col("id.a").alias("a"), F.col("id.b").alias("b"), "words"))
    names = _numbered(once.groupBy("__key", "__hash").agg((F.max("line") + 2).cast("long").alias("size")))
    of = names.select(F.col("__key").alias("k"), F.col("__hash").alias("h"), "doc", "base")
    placed = once.join(of, once["__key"].eqNullSafe(of["k"]) & (once["__hash"] == of["h"])).select((F.col("base") + F.col("line")).alias("place"), "doc", "words", "a", "b")
    out = _ranked(placed, ["a", "b"])
    forget(once)
    return out, names


def doubled(level: DataFrame, step: int) -> DataFrame:
    """(place, rank) over 2 * step lines from those over ``step`` lines."""
    here = level.select("place", F.col("rank").alias("r1"))
    there = level.select((F.col("place") - step).alias("__at"), F.col("rank").alias("r2"))
    pairs = saved(here.join(there, F.col("place") == F.col("__at")).select("place", "r1", "r2"))
    out = _ranked(pairs, ["r1", "r2"])
    forget(pairs)
    return out


def longest_needed(places: DataFrame, min_words: int) -> int:
    """Lines in the longest of the shortest runs of ``min_words`` words that start at a line and have repeated lines only."""
    island = places.withColumn("__island", F.col("place") - F.row_number().over(Window.partitionBy("doc").orderBy("place")))
    stretch = Window.partitionBy("doc", "__island")
    summed = island.withColumn("c", F.sum("words").over(stretch.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    summed = summed.withColumn("before", F.col("c") - F.col("words"))
    # The first line at which the words from here on suffice is the last one before which they do not.
    ahead = stretch.orderBy("before").rangeBetween(0, min_words - 1)
    both = summed.select("place", "before", F.max("place").over(ahead).alias("last"), F.max("c").over(ahead).alias("reach"))
    return both.where(F.col("reach") - F.col("before") >= min_words).agg(F.max(F.col("last") - F.col("place") + 1)).first()[0] or 0


def suffix_ranks(places: DataFrame, longest: int) -> list[DataFrame]:
    """(place, rank) over 1, 2, 4.. lines, until ``longest`` lines are less than the next step or nothing is repeated."""
    levels, step = [places.select("place", "rank")], 1
    while 2 * step <= longest:
        wider = doubled(levels[-1], step)
        if wider.isEmpty():
            break
        levels.append(wider)
        step *= 2
    return levels


def common_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(place, length) of each place that has lines in common with an earlier one: how many, twice the widest step less
    one at most."""
    new = (F.lit(0).alias("length"), F.lit(0).cast("long").alias("of"), F.lit(False).alias("later"))
    state = levels[-1].select("place", *new)
    for k in range(len(levels) - 1, -1, -1):
        step, old = 1 << k, state
        if k < len(levels) - 1:
            # Places whose lines are not repeated over the step above come in.
            wider = levels[k + 1].select(F.col("place").alias("__wider"))
            state = state.unionByName(levels[k].join(wider, F.col("place") == F.col("__wider"), "left_anti").select("place", *new))
        there = levels[k].select(F.col("place").alias("__at"), "rank")
        met = saved(state.join(there, F.col("place") + F.col("length") == F.col("__at"), "left").drop("__at"))
        groups = met.where("rank IS NOT NULL").groupBy("of", "rank").agg(F.count("*").alias("n"), F.min("place").alias("__first")).where("n > 1")
        groups = saved(groups.select(F.struct("of", "rank").alias("__interval"), "__first", (F.monotonically_increasing_id() * len(levels) + k + 1).alias("__new")))
        split = met.withColumn("__own", F.struct("of", "rank")).join(groups, F.col("__own") == F.col("__interval"), "left")
        inside, first = F.col("__new").isNotNull(), F.col("place") == F.col("__first")
        on = lambda later: F.struct((F.col("length") + step).alias("length"), F.col("__new").alias("of"), F.lit(later).alias("later"))
        # A later place goes on with the longer prefix. The first one goes on as what others may meet, and stays behind too.
        ways = F.when(inside & ~first, F.array(on(True))).when(inside, F.array(on(False), F.struct("length", "of", "later")))
        state = saved(split.select("place", F.explode(F.coalesce(ways, F.array(F.struct("length", "of", "later")))).alias("w")).select("place", "w.*"))
        forget(met, groups, old)
    return state.where("later").groupBy("place").agg(F.max("length").alias("length"))


def deleted_stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__key, __hash, first, last) of the lines that lie in later copies; stretches of a document do not overlap. Saved."""
    places, names = repeated_places(docs, key, text)
    longest = longest_needed(places, min_words)
    if not longest:
        return names.select("__key", "__hash", F.lit(0).alias("first"), F.lit(0).alias("last")).where("false")
    levels = suffix_ranks(places, longest)
    runs = common_prefixes(levels)
    # Lines of a run are repeated ones, so they stand next to each other among the places, and running sums count their words.
    summed = places.select("place", "doc", "words", F.sum("words").over(Window.partitionBy("doc").orderBy("place")).alias("c"))
    at, to = (summed.select(F.col("place").alias(f"{x}_at"), "doc", (F.col("c") - (F.col("words") if x == "from" else 0)).alias(f"{x}_words")) for x in ("from", "to"))
    ends = runs.join(at, F.col("place") == F.col("from_at")).join(to.drop("doc"), F.col("place") + F.col("length") - 1 == F.col("to_at"))
    copies = ends.where(F.col("to_words") - F.col("from_words") >= min_words).select("doc", F.col("place").alias("first"), F.col("to_at").alias("last"))
    # Stretches: a run that begins after all before it have ended opens a new one.
    order = Window.partitionBy("doc").orderBy("first")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.withColumn("opens", F.coalesce((F.col("first") > before).cast("int"), F.lit(1)))
    merged = opened.withColumn("stretch", F.sum("opens").over(order)).groupBy("doc", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    named = merged.join(names.withColumnRenamed("doc", "__doc"), F.col("doc") == F.col("__doc"))
    out = saved(named.select("__key", "__hash", (F.col("first") - F.col("base")).cast("int").alias("first"), (F.col("last") - F.col("base")).cast("int").alias("last")))
    forget(places, names, *levels[1:])
    return out


def _without(text: Column, dead: Column) -> Column:
    """``text`` without the lines of the stretches ``dead``, which are in order and do not overlap; null stays null."""

    def kept(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dead, lambda x: x["last"] + 1))
        ends = F.concat(F.transform(dead, lambda x: x["first"]), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda start, end: F.slice(lines, start + 1, end - start))), "\n")

    # As the variable of a lambda, the lines are split once, not for each stretch.
    return F.transform(F.array(F.split(text, "\n")), kept)[0]


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``. Rows without any pass through unshuffled."""
    return _cleaned(docs, key, text, min_words, None)


def _cleaned(docs: DataFrame, key: str, text: str, min_words: int, count: str | None) -> DataFrame:
    columns = docs.columns
    gone = deleted_stretches(docs, key, text, min_words)
    of = F.struct(F.col("__key"), F.col("__hash"))
    changed = gone.select(F.col("__key"), F.col("__hash")).distinct()
    bits = bits_for(changed.count())
    rows = only_repeated(_document(docs, key, text), of, bits_of(changed, of, bits), bits, "__changed")
    chosen = [F.col(f"`{c}`") for c in columns]
    extra = [F.lit(0).cast("long").alias(count)] if count else []
    same = rows.where("NOT __changed").select(*chosen, *extra)
    # Stretches come to the texts, a row for each document, so a changed text is shuffled once, whole, and never again.
    stretches = gone.groupBy(F.col("__key").alias("__k"), F.col("__hash").alias("__h")).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__dead"), F.sum(F.col("last") - F.col("first") + 1).alias("__gone")
    )
    touched = rows.where("__changed").select(*chosen, "__key", "__hash")
    met = touched.join(stretches, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__h")), "left")
    value = F.when(F.col("__dead").isNull(), F.col(f"`{text}`")).otherwise(_without(F.col(f"`{text}`"), F.col("__dead")))
    out = met.select(*[value.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *([F.coalesce("__gone", F.lit(0)).cast("long").alias(count)] if count else []))
    return same.unionByName(out)


def cleaned_with_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, count: str = "n_deleted") -> DataFrame:
    """As ``line_dedup``, with the number of deleted lines of each row in column ``count``."""
    return _cleaned(docs.drop(count), key, text, min_words, count)
