from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifstream.plans.pattern import Pattern, PatternError, parse_pattern
from motifstream.plans.planner import Size, by_union, plan
from motifstream.plans.symmetry import automorphisms, breaking, edge_orbits
from tests.brute import embeddings

SQUARE = Pattern.of([0] * 4, [(0, 1), (1, 2), (2, 3), (0, 3)])
CLIQUE = Pattern.of([0] * 4, [(a, b) for a in range(4) for b in range(a)])


@pytest.mark.parametrize("labels, edges", [([0], []), ([0] * 17, [(i, i + 1) for i in range(16)]), ([0, 0, 0], [(0, 1)]), ([0, 0], [(0, 0)]), ([0, 0], [(0, 1), (1, 0)]), ([0] * 11, [(a, b) for a in range(11) for b in range(a)])])
def test_limits(labels, edges):
    with pytest.raises(PatternError):
        Pattern.of(labels, edges)


def test_parser():
    got = parse_pattern("t # 1\nv 0 3\nv 1 6\nv 2 1\ne 0 1 0\n\ne 2 1 4\ne 0 2\n")
    assert got.labels == (3, 6, 1) and got.edges == ((0, 1, 0), (0, 2, 0), (1, 2, 4))
    for bad in ("v 0 1\nv 2 1\ne 0 2", "x 1 2", "v 0 1"):
        with pytest.raises(PatternError):
            parse_pattern(bad)


def test_symmetry():
    assert len(automorphisms(SQUARE)) == 8 and len(automorphisms(CLIQUE)) == 24
    assert edge_orbits(SQUARE) == [[0, 1, 2, 3]]
    star = Pattern.of([0, 1, 1], [(0, 1), (0, 2)])
    assert edge_orbits(star) == [[0, 1]] and breaking(star) == [(1, 2)]
    assert edge_orbits(Pattern.of([0, 1, 2], [(0, 1), (1, 2)])) == [[0], [1]]


@st.composite
def patterns(draw):
    n = draw(st.integers(2, 5))
    labels = draw(st.lists(st.integers(0, 1), min_size=n, max_size=n))
    edges = {(draw(st.integers(0, v - 1)), v) for v in range(1, n)}
    edges |= draw(st.sets(st.sampled_from([(a, b) for b in range(n) for a in range(b)])))
    return Pattern.of(labels, [(*e, draw(st.integers(0, 1))) for e in sorted(edges)])


@settings(max_examples=60, deadline=None)
@given(patterns(), st.data())
def test_breaking_keeps_one_of_each_set_of_twins(pattern, data):
    labels = {i: data.draw(st.integers(0, 1)) for i in range(6)}
    pairs = data.draw(st.sets(st.sampled_from([(a, b) for b in range(6) for a in range(b)])))
    edges = {p: data.draw(st.integers(0, 1)) for p in sorted(pairs)}
    found = embeddings(pattern, labels, edges)
    kept = [m for m in found if all(m[a] < m[b] for a, b in breaking(pattern))]
    assert len(kept) * len(automorphisms(pattern)) == len(found)


@settings(max_examples=60, deadline=None)
@given(patterns(), st.data())
def test_plans_bind_every_vertex_next_to_a_bound_one(pattern, data):
    u, w, _ = data.draw(st.sampled_from(pattern.edges))
    sizes = {d: Size(data.draw(st.integers(0, 10**9)), data.draw(st.integers(0, 10**6))) for d in pattern.directed()}
    made = plan(pattern, (u, w), sizes)
    assert sorted(made.order) == list(range(len(pattern.labels))) and made.seed == (u, w)
    for i, step in enumerate(made.steps, 2):
        assert set(step.backward) == set(made.order[:i]) & set(pattern.neighbours(step.vertex))
    assert 2 <= made.tail <= len(pattern.labels)
    assert all(len(pattern.neighbours(v)) == 1 for v in made.order[made.tail :])
    assert "seed" in made.explain()


def cost_of(pattern, sizes, order):
    """Rows that the joins of an order make, by the same estimate written out."""
    images = {v: max(1.0, *(sizes[v, x].sources for x in pattern.neighbours(v))) for v in range(len(pattern.labels))}
    fan = lambda b, v: max(sizes[b, v].rows, 0.5) / images[b]
    rows = cost = max(sizes[order[0], order[1]].rows, 0.5)
    for i, v in enumerate(order[2:], 2):
        by = sorted(fan(b, v) for b in order[:i] if b in pattern.neighbours(v))
        if not by:
            return None
        for nth, f in enumerate(by):
            rows *= f if nth == 0 else f / images[v]
            cost += rows
    return cost


@settings(max_examples=60, deadline=None)
@given(patterns(), st.data())
def test_no_order_is_estimated_cheaper(pattern, data):
    rows = {e[:2]: data.draw(st.integers(1, 10**5)) for e in pattern.edges}
    sizes = {(u, w): Size(rows[min(u, w), max(u, w)], data.draw(st.integers(1, 1000))) for u, w in pattern.directed()}
    made = plan(pattern, None, sizes)
    every = [c for p in permutations(range(len(pattern.labels))) if p[:2] in sizes and (c := cost_of(pattern, sizes, p)) is not None]
    assert made.cost == pytest.approx(cost_of(pattern, sizes, made.order), rel=1e-6) and made.cost <= min(every) * (1 + 1e-6)


def test_orders():
    tailed = Pattern.of([0, 0, 0, 0], [(0, 1), (0, 2), (1, 2), (0, 3)])
    assert plan(tailed, (0, 1)).order == (0, 1, 2, 3) and plan(tailed, (0, 1)).tail == 3
    # The vertex that is reached through the larger relation waits.
    chain = Pattern.of([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3)])
    size = {d: Size(100, 100) for d in chain.directed()} | {(0, 2): Size(500_000, 100)}
    assert plan(chain, (0, 1), size).order == (0, 1, 3, 2)
    assert [v for v in plan(chain, (0, 1), size | {(1, 3): Size(1, 100)}, leaves_last=True).order] == [0, 1, 3, 2]
    path = Pattern.of([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)])
    assert plan(path, (1, 0), leaves_last=True).order == (1, 0, 2, 3) and plan(path, None, leaves_last=True).tail == 2
    # Few insertions into a large graph are grown from; many are not.
    assert by_union(chain, {d: Size(10**6, 1000, 10) for d in chain.directed()})
    assert not by_union(chain, {d: Size(10**6, 1000, 10**6) for d in chain.directed()})
