"""Small graphs with counts that can be checked by hand, then random ones against the plain enumerator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from motifstream import cli
from motifstream.operators import matching, pruning, relations, results, tails
from motifstream.plans.pattern import Pattern
from motifstream.plans.planner import Size, plan
from motifstream.sources import textgraph
from motifstream.sources.graph import Graph, clean_edges
from motifstream.streaming.incremental import IncrementalMatcher
from tests.brute import increments

D8 = ({0: 3, 1: 0, 2: 6, 3: 1, 4: 5, 5: 1, 6: 0, 7: 3}, "0-1 0-2 0-5 1-3 2-3 *2-5 *3-4 *3-6 *6-7")
K4 = ({i: 0 for i in range(4)}, "*0-1 *0-2 *0-3 *1-2 *1-3 *2-3")
TRI = ({i: 0 for i in range(3)}, "1-2 *0-1 *0-2")
STAR = ({0: 0, 1: 1, 2: 1, 3: 1}, "0-1 *0-2 *0-3")
SQUARE = ([0] * 4, [(0, 1), (1, 2), (2, 3), (0, 3)])
FIXTURES = {
    "F1": (([3, 6, 1], [(0, 1), (1, 2), (0, 2)]), D8, None, [1]),
    "F2": (([3, 0, 1], [(0, 1), (1, 2)]), D8, None, [1]),
    "F2b": (([3, 0, 1], [(0, 1), (1, 2)]), D8, 1, [0, 0, 0, 1]),
    "F2c": (([3, 0, 1, 5], [(0, 1), (1, 2), (2, 3)]), D8, None, [2]),
    "F3": (SQUARE, K4, None, [24]),
    "F3b": (SQUARE, K4, 2, [0, 0, 24]),
    "F3c": (([0] * 4, [(a, b) for a in range(4) for b in range(a)]), K4, 1, [0, 0, 0, 0, 0, 24]),
    "F4": (([0] * 3, [(0, 1), (1, 2), (0, 2)]), TRI, 1, [0, 6]),
    "F4b": (([0] * 3, [(0, 1), (1, 2), (0, 2)]), TRI, None, [6]),
    "F5": (([0, 1, 1], [(0, 1), (0, 2)]), STAR, None, [6]),
    "F5b": (([1, 1, 0], [(0, 2), (1, 2)]), STAR, None, [6]),
    "F6": (([0, 1], [(0, 1)]), STAR, None, [2]),
    "F6b": (([1, 1], [(0, 1)]), (STAR[0], "*1-2"), None, [2]),
    "F7": (([0, 1, 1, 1, 0], [(0, 1), (0, 2), (0, 3), (1, 4)]), ({0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}, "0-1 0-2 *0-3 *0-4 *1-5"), None, [6]),
    "F8": (([0] * 3, [(0, 1, 0), (1, 2, 1)]), ({i: 0 for i in range(3)}, "0-1:0 *1-2:1 *0-2:1"), None, [2]),
    "F8b": (([0] * 3, [(0, 1, 0), (1, 2, 1)]), ({i: 0 for i in range(3)}, "0-1:0 *1-2:7 *0-2:1"), None, [1]),
}


def write(folder, labels, edges):
    """Files of a graph whose edges are written as a-b:label, with a star before insertions."""
    old, new = [], []
    for e in edges.split():
        ends, _, label = e.lstrip("*").partition(":")
        a, b = ends.split("-")
        (new if e[0] == "*" else old).append(f"e {a} {b} {label or 0}")
    (folder / "data").write_text("\n".join(["t # 0", *(f"v {i} {x}" for i, x in labels.items()), *old]) + "\n")
    (folder / "update").write_text("\n".join(new) + "\n")
    return str(folder / "data"), str(folder / "update")


def by_batch(rows, n):
    found = {r["batch"]: r["n"] for r in results.counts(rows).collect()}
    return [found.get(k, 0) for k in range(1, n + 1)]


@pytest.mark.parametrize("name", FIXTURES)
def test_fixture(spark, tmp_path, name):
    (labels, edges), graph, size, expected = FIXTURES[name]
    pattern = Pattern.of(labels, edges)
    g = textgraph.load(spark, *write(tmp_path, *graph), size, pattern)
    assert by_batch(matching.deltas(g, pattern), len(expected)) == expected


def random_case(seed):
    rng = random.Random(seed)
    labels = {i: rng.randrange(2) for i in range(9)}
    pairs = [(a, b, rng.randrange(2)) for b in range(9) for a in range(b) if rng.random() < 0.55]
    rng.shuffle(pairs)
    third = len(pairs) // 3
    shapes = [Pattern.of([0, 1, 0], [(0, 1), (1, 2), (0, 2)]), Pattern.of([0, 0, 1, 1], [(0, 1), (1, 2, 1), (2, 3), (0, 3, 1)]), Pattern.of([1, 0, 0], [(0, 1), (0, 2)]), Pattern.of([0, 0, 1, 0], [(0, 1), (0, 2), (1, 2), (0, 3)])]
    return shapes[seed % len(shapes)], labels, pairs[:third], [pairs[third : 2 * third], pairs[2 * third :]]


def graph_of(spark, labels, initial, batches):
    rows = [(a, b, l, k) for k, part in enumerate([initial, *batches]) for a, b, l in part]
    edges = clean_edges(spark.createDataFrame(rows, "src long, dst long, label int, batch int"))
    return Graph(spark.createDataFrame(list(labels.items()), "id long, label int").cache(), edges.cache())


@pytest.mark.parametrize("seed", range(4))
def test_strategies_agree_with_the_enumerator(spark, seed):
    pattern, labels, initial, batches = random_case(seed)
    expected = increments(pattern, labels, initial, batches)
    g, ids = graph_of(spark, labels, initial, batches), [f"m{v}" for v in range(len(pattern.labels))]
    sizes = relations.sizes_for_planning(g, pattern)
    every = matching.deltas(g, pattern, plan(pattern, None, sizes)).collect()
    grown = matching.since_start(g, pattern, sizes).collect()
    assert sorted((r["batch"], *[r[c] for c in ids]) for r in grown) == sorted((r["batch"], *[r[c] for c in ids]) for r in every)
    few = {d: Size(10**6, 1000, 1) for d in pattern.directed()}  # statistics that ask for the union
    assert sorted(matching.deltas(g, pattern, sizes=few).collect()) == sorted(every)
    assert by_batch_counts(matching.count_by_batch(g, pattern, sizes=few, initial=False), len(expected)) == [len(x) for x in expected]
    for k, want in enumerate(expected, 1):
        assert {tuple(r[c] for c in ids) for r in every if r["batch"] == k} == want
        tele = [tuple(r[c] for c in ids) for r in matching.telescoped(g, pattern, k, sizes).collect()]
        assert sorted(tele) == sorted(want)
        canon = matching.canonical(g, pattern, k).collect()
        assert sorted(tuple(r[c] for c in ids) for r in canon) == sorted(want)
        assert sorted((r["seed_edge"], *[r[c] for c in ids]) for r in canon) == sorted((r["seed_edge"], *[r[c] for c in ids]) for r in every if r["batch"] == k)
    last = len(expected)
    assert sum(r["weight"] for r in matching.canonical(g, pattern, last, orbits=True).collect()) == len(expected[-1])
    assert by_batch_counts(matching.count_by_batch(g, pattern), last) == [len(x) for x in expected]
    assert by_batch_counts(matching.count_by_batch(pruning.PrunedGraph(g, pattern), pattern), last) == [len(x) for x in expected]


def by_batch_counts(rows, n):
    found = {r["batch"]: r["n"] for r in rows.collect()}
    return [found.get(k, 0) for k in range(1, n + 1)]


def test_candidates_grow_and_edges_between_them(spark):
    g = graph_of(spark, {0: 0, 1: 1, 2: 1, 3: 1}, [(0, 1, 0)], [[(0, 2, 0)], [(0, 3, 0)]])
    pattern = Pattern.of([0, 1, 1], [(0, 1), (0, 2)])
    found = {(r["qv"], r["id"]): r["since"] for r in pruning.candidates(g, pattern).collect()}
    assert found == {(0, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    edges = {(r["qe"], r["src"], r["dst"]): r["since"] for r in pruning.candidate_edges(g, pattern).collect()}
    assert edges[0, 0, 1] == 1 and edges[0, 0, 3] == 2 and len(edges) == 12


def test_tails(spark):
    labels = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    g = graph_of(spark, labels, [(0, 1, 0), (0, 2, 0), (0, 3, 0), (0, 4, 0), (0, 5, 0)], [])
    pattern = Pattern.of([0, 1, 2], [(0, 1), (0, 2)])
    assert tails.count_factorised(g, pattern).first()["n"] == matching.full(g, pattern).count() == 6
    order = plan(pattern, (0, 1))
    assert sum(r["n"] for r in tails.tail_cardinality(g, pattern, order).collect()) == 6
    twins = Pattern.of([0, 1, 1], [(0, 1), (0, 2)])
    assert tails.count_factorised(g, twins).first()["n"] == 2


def test_missing_relations_and_empty_graphs(spark):
    g = graph_of(spark, {0: 0, 1: 1}, [(0, 1, 0)], [])
    pattern = Pattern.of([0, 2], [(0, 1)])
    assert matching.deltas(g, pattern).count() == 0 and matching.telescoped(g, pattern, 1).count() == 0
    assert [r["cardinality"] for r in relations.statistics(g, pattern).collect()] == [0, 0]


def test_odd_edges(spark, tmp_path):
    pattern = Pattern.of([0, 0], [(0, 1)])
    files = write(tmp_path, {0: 0, 1: 0, 2: 0}, "0-1 *1-1 *1-0 *0-9 *1-2")
    g = textgraph.load(spark, *files, 1)
    rows = matching.deltas(g, pattern).collect()
    # A loop, an edge that is there already and one to an unknown vertex bring nothing but take their places in the order.
    assert {(r["batch"], r["m0"], r["m1"]) for r in rows} == {(4, 1, 2), (4, 2, 1)}
    with pytest.raises(ValueError):
        textgraph.load(spark, *files, 0)
    (tmp_path / "update").write_text("v 3 0\n")
    with pytest.raises(textgraph.GraphFormatError):
        textgraph.load(spark, *files)


def test_files_of_insertions_go_by_name(spark, tmp_path):
    (tmp_path / "data").write_text("\n".join(f"v {i} 0" for i in range(60)) + "\n")
    folder = tmp_path / "updates"
    folder.mkdir()
    (folder / "part-0").write_text("e 58 59 0\n")
    (folder / "part-1").write_text("".join(f"e {i} {i + 1} 0\n" for i in range(50)))
    graph = textgraph.load(spark, str(tmp_path / "data"), str(folder), 1)
    got = {(r["src"], r["dst"]): r["batch"] for r in graph.edges.collect()}
    assert got == {(58, 59): 1} | {(i, i + 1): i + 2 for i in range(50)}


def test_command_line(spark, tmp_path, capsys):
    files = write(tmp_path, *K4)
    (tmp_path / "query").write_text("v 0 0\nv 1 0\nv 2 0\ne 0 1 0\ne 1 2 0\ne 0 2 0\n")
    args = ["--query", str(tmp_path / "query"), "--data", files[0], "--update", files[1]]
    assert cli.main([*args, "--batch_size", "3", "--print_results", "--explain", "--timings"], spark) == 24
    said = capsys.readouterr().out
    assert "new embeddings: 24" in said and "seed 0-1" in said and said.count("\n1: ") == 0 and "2: 0,1,2" in said
    with pytest.raises(FileNotFoundError):
        cli.main([*args[:-1], str(tmp_path / "none")], spark)


def test_stream_equals_batch(spark, tmp_path):
    pattern, labels, initial, batches = random_case(0)
    schema = "src long, dst long, label int"
    vertices = spark.createDataFrame(list(labels.items()), "id long, label int")
    matcher = IncrementalMatcher(spark, vertices, pattern, str(tmp_path / "state"), buckets=4)
    matcher.start(spark.createDataFrame(initial, schema))
    for k, part in enumerate(batches, 1):
        if k == 2:
            matcher.compact(1)
            assert sorted(matcher._folders()) == ["upto1"]
        matcher.insert(spark.createDataFrame([*part, *initial[:2], (3, 3, 0), (0, 99, 0)], schema), k)
    matcher.insert(spark.createDataFrame(batches[-1], schema), len(batches))  # as after a failure
    got = {k: set() for k in range(1, len(batches) + 1)}
    for r in matcher.matches().collect():
        got[r["batch"]].add(tuple(r[f"m{v}"] for v in range(3)))
    assert list(got.values()) == increments(pattern, labels, initial, batches)
    assert sorted(matcher.seconds) == [1, 2] and min(min(x) for x in matcher.seconds.values()) > 0


def test_a_batch_reads_only_the_buckets_of_its_edges(spark, tmp_path):
    """A star of paths: one new edge, whose ends lie in two buckets of 16."""
    pattern = Pattern.of([0, 1, 0], [(0, 1), (1, 2)])
    vertices = spark.createDataFrame([(i, i % 2) for i in range(200)], "id long, label int")
    matcher = IncrementalMatcher(spark, vertices, pattern, str(tmp_path / "state"), buckets=16)
    matcher.start(spark.createDataFrame([(2 * i, 2 * i + 1, 0) for i in range(100)], "src long, dst long, label int"))
    matcher.insert(spark.createDataFrame([(0, 51, 0)], "src long, dst long, label int"), 1)
    assert {tuple(r)[:3] for r in matcher.matches().collect()} == {(0, 51, 50), (50, 51, 0)}
    near = matcher._distinct(matcher.halves(1, 1), F.col("bucket"))
    assert 1 <= len(near) <= 2
    held = {int(re.search(r"bucket=(\d+)", r[0])[1]) for r in matcher.halves(0, 1, near).select(F.input_file_name()).distinct().collect()}
    assert held <= set(near)
    # Five scans: the batch's own edges once for each pattern edge, and the others' three folders, pruned to those buckets.
    plan_text = matcher.new_matches(1)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("FileScan") == 5 and plan_text.count("PartitionFilters: [bucket") == 3


# ---------------------------------------------------------------- joins that would make or move too many rows
def random_graph(spark, labels, n, share, seed):
    """A graph and its edges as pairs, in four batches."""
    rng = random.Random(seed)
    of = [rng.choice(labels) for _ in range(n)]
    edges = [(a, b, 0, rng.randrange(4)) for a in range(n) for b in range(a) if rng.random() < share]
    return Graph(spark.createDataFrame(list(enumerate(of)), "id long, label int"), spark.createDataFrame(edges, "src long, dst long, label int, batch int"))


@pytest.mark.parametrize("name", ["cycle4", "clique4", "diamond"])
@pytest.mark.parametrize("keep", ["latest", "each", "none"])
def test_wedges_and_sieves_leave_the_rows_as_they_are(spark, monkeypatch, name, keep):
    pattern = {"cycle4": Pattern.of([0, 1, 0, 1], [(0, 1), (1, 2), (2, 3), (0, 3)]), "clique4": Pattern.of([0, 0, 1, 1], [(a, b) for b in range(4) for a in range(b)]), "diamond": Pattern.of([0, 0, 1, 0], [(0, 1), (0, 2), (1, 2), (0, 3), (2, 3)])}[name]
    graph = random_graph(spark, [0, 1], 16, 0.6, 5)
    order = plan(pattern, None, relations.sizes_for_planning(graph, pattern))
    want = sorted(map(tuple, matching.full(graph, pattern, order, keep).collect()))
    assert want
    for way in ("wedge", "sieve"):
        monkeypatch.setattr(matching, "MANY", 0)
        monkeypatch.setattr(type(order), "widths", lambda self, way=way: [(0.0, 1.0, 0.0 if way == "wedge" else 1.0) for _ in self.steps])
        assert sorted(map(tuple, matching.full(graph, pattern, order, keep).collect())) == want
        if keep == "latest":
            assert sorted(map(tuple, matching.full_by_symmetry(graph, pattern, order).collect())) == want


def test_dense_4_cycles_are_joined_as_wedges_and_cliques_sieved(spark, monkeypatch):
    cycle, clique = (Pattern.of([0, 1, 0, 1], [(0, 1), (1, 2), (2, 3), (0, 3)]), Pattern.of([0, 0, 1, 2], [(a, b) for b in range(4) for a in range(b)]))
    taken = []
    monkeypatch.setattr(matching, "grow", lambda rows, *a: taken.append(a[6] if len(a) > 6 else {}) or rows)
    monkeypatch.setattr(matching, "_columns", lambda pattern: [])
    graph = random_graph(spark, [0, 1, 2], 6, 0.5, 1)
    trade = {(0, 1): Size(36e6, 9e6), (1, 0): Size(36e6, 1.2e6)}
    matching.full(graph, cycle, plan(cycle, None, {(u, w): trade[u % 2, w % 2] for u, w in cycle.directed()}), "none")
    matching.full(graph, clique, plan(clique, None, {d: Size(16e6, 4e5) for d in clique.directed()}), "none")
    matching.full(graph, clique, plan(clique, None, {d: Size(1600, 40) for d in clique.directed()}), "none")
    assert [sorted(x.values()) for x in taken] == [["wedge"], ["sieve", "sieve"], []]


def test_sieve_drops_what_no_edge_closes(spark):
    from motifstream.operators.sieve import sieved

    edges = spark.range(3000).selectExpr("id AS src", "id * 7 AS dst")
    rows = spark.range(6000).selectExpr("id AS a", "id * 7 AS b").unionByName(spark.range(6000).selectExpr("-id - 1 AS a", "id AS b"))
    left = {tuple(r) for r in sieved(rows, "a", "b", edges, 3000).collect()}
    assert {(i, 7 * i) for i in range(3000)} <= left and len(left) < 3100


def test_live_matching_lists_each_folder_of_the_index_once(spark, tmp_path, monkeypatch):
    pattern = Pattern.of([0, 0, 0], [(0, 1), (1, 2), (0, 2)])
    vertices = spark.createDataFrame([(i, 0) for i in range(6)], "id long, label int")
    edges = lambda *pairs: spark.createDataFrame([(*p, 0) for p in pairs], "src long, dst long, label int")
    matcher, listed = IncrementalMatcher(spark, vertices, pattern, str(tmp_path), buckets=2), []
    reader = type(spark.read)
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, f=reader.parquet, **k: listed.extend(p for p in paths if "/edges/" in p) or f(self, *paths, **k))
    matcher.start(edges((0, 1), (1, 2)))
    matcher.insert(edges((0, 2)), 1)
    matcher.insert(edges((2, 3), (1, 3)), 2)
    matcher.insert(edges((2, 3), (0, 3)), 2)  # the batch again, with other edges: what was opened of it is not used
    assert sorted(len([p for p in listed if p.endswith(n)]) for n in ("batch0", "batch1", "batch2")) == [1, 1, 2]
    assert [matcher.matches().where(f"batch = {k}").count() for k in (1, 2)] == [6, 6]
