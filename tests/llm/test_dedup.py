"""Exact, near and line de-duplication against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from motifstream.llm import components as components_module
from motifstream.llm import exact_dedup, line_dedup, ngram_join, queries
from motifstream.llm._arrow import text_chunks
from motifstream.llm.components import components, forest



def docs(spark, rows, schema="doc_id long, text string, lang string, keep_id string, class_id string"):
    return spark.createDataFrame([(*r, "en", "clash", "clash") for r in rows], schema)


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


EXACT = [(i, t) for i, t in enumerate(["Same", "sAME", "same ", "É", "é", "", "x" * 5000, "X" * 5000, "x" * 4999 + "y", "alone", "ab", "ba"])] + [(20, None), (3, "É"), (3, "É"), (None, "same"), (None, "only null"), (None, "only null"), (50, "same")]


def test_exact_groups(spark, tmp_path):
    docs(spark, EXACT).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_exact_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(EXACT)
    groups = {}
    for i, t in EXACT:
        groups.setdefault(normal(t), []).append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = {}
    for r in got:
        ids = groups[sha[r["text_sha256"]]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None) and r["doc_id"] in ids
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    for bits in (64, None):  # a small bitmap lets too many rows on and changes nothing
        left = exact_dedup.dedup(docs(spark, EXACT), filter_bits=bits)
        assert left.columns == docs(spark, EXACT).columns
        want = sorted(((max([i for i in ids if i is not None], default=None)) or -1, t) for t, ids in groups.items())
        assert sorted((r["doc_id"] or -1, normal(r["text"])) for r in left.collect()) == want
    narrow = exact_dedup.group_table(docs(spark, EXACT))
    assert {r["content_hash"] is None for r in narrow.where("doc_id = 9").collect()} == {True}
    assert exact_dedup.dedup(docs(spark, [])).count() == 0 and exact_dedup.group_table(docs(spark, [])).count() == 0


def test_bitmaps_grow_with_the_keys():
    sizes = [exact_dedup.bits_for(n) for n in (0, 1, 10**5, 10**6, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == exact_dedup.LEAST_BITS and sizes[-1] == exact_dedup.MOST_BITS
    assert all(8 * n <= b < 16 * n for n, b in zip((10**6, 10**8), sizes[3:5]))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60) if i % 13] + [(200, k) for k in range(201, 240)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(5, 5), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def tables_written(spark, run):
    """(files of each table that ``run`` saves in the shared folder, its result)."""
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "tables"
    before = set(folder.glob("*"))
    out = run()
    return [len(list(x.glob("*.parquet"))) for x in folder.glob("*") if x not in before], out


def test_components_over_many_partitions(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 500) if i % 170] + [(900, k) for k in range(901, 1100)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(330)]
    rng.shuffle(links)
    links = [x if rng.random() < 0.5 else x[::-1] for x in links]
    u, v = np.array([x for x in links if x[0] != x[1]]).T
    want = dict(zip(*(x.tolist() for x in forest(u, v))))
    assert set(want) | set(want.values()) == {*u.tolist(), *v.tolist()}
    assert all(want.get(a, a) == want.get(b, b) for a, b in links) and not set(want) & set(want.values())
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for root in set(want.values()):  # each part hangs together and its name is its smallest node
        part, new = {root}, [root]
        while new:
            new = [y for x in new for y in near[x] if y not in part and not part.add(y)]
        assert part == {x for x in want if want[x] == root} | {root} and min(part) == root
    got = components(spark.createDataFrame(links, "a long, b long").repartition(16), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == want | {x: x for x in want.values()} and len(got) == len(near)


def test_blocks_of_links(spark, monkeypatch):
    monkeypatch.setattr(components_module, "BLOCK_LINKS", 1)
    monkeypatch.setattr(components_module, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = components(spark.createDataFrame([(i + 1, i) for i in range(100)], "a long, b long").coalesce(1), "a", "b").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["node"] for r in got) == list(range(101)) and {r["component"] for r in got} == {0}


def test_a_graph_of_one_partition_takes_one_round(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").coalesce(1)
    files, found = tables_written(spark, lambda: components(chain, "a", "b"))
    assert len(files) == 3 and found.where("component <> 0").count() == 0 and found.count() == 301


def test_near_join_saves_few_files(spark):
    # On a local file system Hadoop starts a command for each file; before exec it counts as a second executor.
    rows = docs(spark, near_corpus()).coalesce(1)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        files, _ = tables_written(spark, lambda: ngram_join.join(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert len(files) <= 12 and sum(files) <= 16


def near_corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for _ in range(12):  # families of texts that drift apart, so that some pairs are just above and below the threshold
        base = text(rng.randrange(20, 120))
        for _ in range(5):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randrange(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
    big = text(150)
    for k in range(60):  # one large group of near copies
        copy = list(big)
        copy[k] = "new"
        rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper() + " !", "", None, " ", "one two", "One, two", "three", "x " * 400, "x " * 500, " ".join(text(3000))]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(0, rows[0]), (None, "no key"), (None, "no key too")]


def shingle_set(text):
    low = (text or "").lower()
    words = re.findall(r"[a-z0-9]+", low)
    if not words:
        return frozenset([("raw", low)])
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


@pytest.mark.parametrize("chunk", [1024, 16, 5])
def test_near_join(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", chunk)
    rows = near_corpus()
    sets = [shingle_set(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    members = {}
    for i, r in enumerate(root):
        members.setdefault(r, []).append(i)
    least = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in members.items()}
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_ngram_join(spark, str(tmp_path)).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    want = [(rows[i][0], least[root[i]], len(members[root[i]]), len(linked[i])) for i in range(len(rows))]
    assert sorted((key((r["doc_id"], r["class_id"], r["class_size"], r["n_links"])) for r in got)) == sorted(map(key, want))
    if chunk == 1024:
        left = ngram_join.near_dedup(docs(spark, rows))
        assert left.columns == docs(spark, rows).columns
        assert sorted(key((r["doc_id"],)) for r in left.collect()) == sorted(key((least[r],)) for r in members)


def test_near_join_of_nothing(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    assert ngram_join.near_dedup(docs(spark, [(1, "a b"), (2, "c d")])).count() == 2


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, ngram_join.RECALL)
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and 1 - (1 - 0.3**rows) ** bands <= 0.06
    # The share of pairs of similarity 0.8 that meet in a band, measured.
    rng, found, n = np.random.default_rng(6), 0, 600
    for _ in range(n):
        both, own = rng.integers(0, 2**63, 80).astype(np.uint64), rng.integers(0, 2**63, 20).astype(np.uint64)
        members, splits = np.concatenate([both, own[:10], both, own[10:]]), np.array([0, 90, 180])
        a, b = ngram_join.band_hashes(members, splits, bands, rows)
        found += bool((a == b).any())
    assert found >= 0.99 * n


def test_compare_by_product_and_one_by_one_agree():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(150)]
    for left, right in ((sets, None), (sets[:20], sets[20:])):
        other = left if right is None else right
        asked = np.ones((len(left), len(other)), bool) if right else ~np.eye(len(left), dtype=bool)  # no set against itself
        got = ngram_join.compare(left, right, asked, 0.8)
        want = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in other] for a in left])
        assert (got == want & asked).all() and got.any() and not got.all()


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "a b c d e f", "", "b c d e f", "a"]
    whole = [c for c in text_chunks(pa.array(texts))]
    alone = [c for t in texts for c in text_chunks(pa.array([t]), 1)]
    keys, before = ngram_join.sets_of(whole[0][2], whole[0][3])
    apart = [ngram_join.sets_of(c[2], c[3])[0] for c in alone]
    assert [keys[a:b].tolist() for a, b in zip(before, before[1:])] == [x.tolist() for x in apart]


def test_words_of_all_scripts():
    texts = ["第一条。第二条，ab\u00a0c\u3000d—“é”x", "e\u0301t हिन्दी ❤\ufe0f٣", "\u0301a", "𝒜²\U0001f600b", "—", "aé"]
    want = [["第一条", "第二条", "ab", "c", "d", "é", "x"], ["e\u0301t", "हिन्दी", "٣"], ["a"], ["𝒜²", "b"], [], ["aé"]]
    (chunk,) = text_chunks(pa.array(texts))
    words, splits = ngram_join.word_hashes(chunk[2], chunk[3])
    alone = [ngram_join.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].tolist() for x in want for w in x]
    assert np.diff(splits).tolist() == [len(x) for x in want] and [[x] for x in words.tolist()] == alone


def test_near_copies_without_ascii_separators(spark):
    rng, rows = random.Random(8), []
    for i, gap in enumerate(["\u3002", "\uff0c", "\u00a0", "\u3000", "\u2014", "\u201d\u201c"]):
        words = ["".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往") for _ in range(4)) for _ in range(100)]
        copy = [*words[:50], "改", *words[51:]]
        rows += [(3 * i, "\n".join(gap.join(words[k : k + 5]) for k in range(0, 100, 5))), (3 * i + 1, gap.join(copy)), (3 * i + 2, gap.join(words[::-1]))]
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.join(docs(spark, rows)).collect()}
    assert got == {k: k - (k % 3 == 1) for k, _ in rows}


def cleaned(rows, min_words):
    """Every run of lines with min_words words that occurs earlier goes."""
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda x: x[:2])
    lines = [t.split("\n") for *_, t in order]
    seen, dead = {}, [set() for _ in order]
    longest = max((len(x) for x in lines), default=0)
    for d, text in enumerate(lines):
        for i in range(len(text)):
            for n in range(1, min(longest, len(text) - i) + 1):
                run = tuple(text[i : i + n])
                if sum(len(x.split()) for x in run) < min_words:
                    continue
                if run in seen:
                    dead[d] |= set(range(i, i + n))
                else:
                    seen[run] = (d, i)
    out = {}
    for (none, key, text), x, gone in zip(order, lines, dead):
        out[None if none else key, text] = "\n".join(line for i, line in enumerate(x) if i not in gone)
    return out


def test_line_dedup(spark, tmp_path):
    rng = random.Random(8)
    pool = ["", "a b c", "d e", "f g h i j", "k", "l m n o p q r s", "t u v", "  ", "w x y z"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(25)]
    rows += [(100, "same line here\n" * 6), (101, "x\n" + "same line here\n" * 4), (102, None), (103, ""), (7, rows[7][1]), (None, rows[3][1])]
    for words in (6, 11):
        got = line_dedup.cleaned_with_counts(docs(spark, rows), min_words=words)
        want = cleaned(rows, words)
        result = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect())
        assert result == sorted((i is None, i or 0, want[i, t] if t is not None else "") for i, t in rows)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0 and line_dedup.cleaned_with_counts(docs(spark, [(1, None)])).first()["n_deleted"] == 0
    same = line_dedup.line_dedup(docs(spark, rows[:3]))
    assert same.columns == docs(spark, rows).columns


def test_op6(spark, tmp_path):
    """The query against brute force: passages of over 50 words that repeat across documents, exact copies, odd rows."""
    rng = random.Random(18)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passages = [[line(rng.randrange(5, 30)) for _ in range(rng.randrange(3, 7))] for _ in range(6)] + [[line(60)], [line(20), "", "", line(20), "\t", line(11)]]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [line(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 4))]
            one = rng.choice(passages)
            text += one[rng.randrange(len(one)) :] if rng.random() < 0.4 else one
        rows.append((i * 5, "\n".join(text)))
    rows += [(900, rows[3][1]), (901, rows[3][1] + "\n" + rows[4][1]), (902, ""), (903, None), (3, rows[9][1]), (904, "\n" * 70), (905, "\n" * 90), (906, "\n".join(passages[6] * 40)), (15, rows[3][1])]
    docs(spark, rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = cleaned(rows, line_dedup.MIN_WORDS)
    expected = []
    for i, t in rows:
        new = want[i, t] if t is not None else ""
        left = len(new.split("\n")) if new or (t and new == "" and t == "") else 0
        lines = len((t or "").split("\n"))
        expected.append((i, lines, hashlib.sha256(new.encode()).hexdigest()))
    got = queries.op6_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["text_sha256"]) for r in got) == sorted(expected)
    assert sum(r["n_deleted"] > 0 for r in got) > 20
    texts = dict(zip([(i, t) for i, t in rows], expected))
    for r in got:
        kept = {e[2]: want[k] for k, e in texts.items() if k[1] is not None}.get(r["text_sha256"])
        if kept:
            assert r["n_lines"] - r["n_deleted"] == len(kept.split("\n"))


def test_blank_lines_do_not_multiply_rows(spark):
    """Two copies of 80 words with a hundred blank lines after each: runs overlap a lot, and stay intervals."""
    text = "\n".join(f"word{i}" + "\n" * 100 for i in range(80))
    rows = [(1, text), (2, text), (3, "x")]
    gone = line_dedup.deleted_stretches(docs(spark, rows))
    found = gone.collect()
    assert [(r["__key"], r["first"], r["last"]) for r in found] == [(2, 0, text.count("\n"))]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.cleaned_with_counts(docs(spark, rows)).collect()}
    assert got == {1: (text, 0), 2: ("", text.count("\n") + 1), 3: ("x", 0)}


def shuffled_bytes(spark, after=-1):
    """(bytes that stages numbered above ``after`` have written to shuffles, number of the last stage)."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteBytes() for x in found if x.stageId() > after), max(x.stageId() for x in found)


def test_changed_texts_are_shuffled_once(spark):
    """Also those of a long document with many stretches."""
    rng = random.Random(20)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    passage = " ".join(word(2) for _ in range(50))
    own = [[word(60) for _ in range(40)] for _ in range(300)]
    rows = [(0, passage)] + [(i + 1, "\n".join([*x[:20], passage, *x[20:]])) for i, x in enumerate(own)]
    long = [f"line{i}" for i in range(3000)]
    rows.append((900, "\n".join(y for x in long for y in (x, passage))))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = line_dedup.cleaned_with_counts(docs(spark, rows))
        last = shuffled_bytes(spark)[1]
        got = {r["doc_id"]: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {0: (passage, 0), 900: ("\n".join(long), 3000)} | {i + 1: ("\n".join(x), 1) for i, x in enumerate(own)}
    assert {i: (r["text"], r["n_deleted"]) for i, r in got.items()} == want
    assert 0 < shuffled_bytes(spark, last)[0] < 1.2 * sum(len(t) for _, t in rows)


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(["word"] * 50)
    rows = [(i, text, i + 10, "x", i + 20, -i, i + 30, "y") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, k long, h string, first long, last long, line long, dead string")
    got = line_dedup.line_dedup(table)
    assert got.columns == table.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], *((r[0], "", *r[2:]) for r in rows[1:])]


def test_common_prefixes_by_brute_force(spark):
    rng = random.Random(19)
    rows = [(i, "\n".join(rng.choice("ab" if i % 2 else "abcde") for _ in range(rng.randrange(1, 16)))) for i in range(14)]
    places, names = line_dedup.repeated_places(docs(spark, rows), "doc_id", "text")
    levels = line_dedup.suffix_ranks(places, 16)
    bases = sorted((r["base"], r["__key"]) for r in names.collect())
    assert [k for _, k in bases] == sorted(k for _, k in bases)
    at = lambda place: next((k, place - b) for b, k in reversed(bases) if b <= place)
    got = {at(r["place"]): r["length"] for r in line_dedup.common_prefixes(levels).collect()}
    lines = {i: t.split("\n") for i, t in rows}
    places = [(i, k) for i, t in lines.items() for k in range(len(t))]

    def common(a, b):
        n = 0
        while a[1] + n < len(lines[a[0]]) and b[1] + n < len(lines[b[0]]) and lines[a[0]][a[1] + n] == lines[b[0]][b[1] + n]:
            n += 1
        return n

    most = 2 ** len(levels) - 1
    want = {b: min(n, most) for k, b in enumerate(places) if (n := max([common(a, b) for a in places[:k]], default=0))}
    assert got == want
    # Ranks over each step are in the order of the lines' ranks: a suffix array.
    one = {r["place"]: r["rank"] for r in levels[0].collect()}
    for k, level in enumerate(levels):
        found = {r["place"]: r["rank"] for r in level.collect()}
        key = {p: tuple(one[p + n] for n in range(2**k)) for p in found}
        order = {x: n for n, x in enumerate(sorted(set(key.values())))}
        by_rank = {x: n for n, x in enumerate(sorted(set(found.values())))}
        assert all(order[key[p]] == by_rank[found[p]] for p in found)
