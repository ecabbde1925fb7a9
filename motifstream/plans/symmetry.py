"""Symmetries of a pattern: automorphisms, edge orbits and an order on images that keeps one of each set of twins."""

from __future__ import annotations

from .pattern import Pattern


def automorphisms(pattern: Pattern) -> list[tuple[int, ...]]:
    """All label-preserving self-maps; position i holds the image of vertex i. By backtracking."""
    n = len(pattern.labels)
    label = {(u, w): x for u, w, x in pattern.edges} | {(w, u): x for u, w, x in pattern.edges}
    degree = [len(pattern.neighbours(v)) for v in range(n)]
    out: list[tuple[int, ...]] = []

    def grow(image: list[int]) -> None:
        v = len(image)
        if v == n:
            out.append(tuple(image))
            return
        for x in range(n):
            if x not in image and pattern.labels[x] == pattern.labels[v] and degree[x] == degree[v]:
                if all(label.get((u, v)) == label.get((y, x)) for u, y in enumerate(image)):
                    grow([*image, x])

    grow([])
    return out


def edge_orbits(pattern: Pattern) -> list[list[int]]:
    """Edges (by index) that automorphisms map onto each other; the first of each orbit stands for it."""
    maps = automorphisms(pattern)
    left, out = set(range(len(pattern.edges))), []
    while left:
        u, w, _ = pattern.edges[min(left)]
        orbit = sorted({pattern.edge_index(m[u], m[w]) for m in maps})
        out.append(orbit)
        left -= set(orbit)
    return out


def breaking(pattern: Pattern) -> list[tuple[int, int]]:
    """Pairs (a, b), read as image(a) < image(b), that exactly one of each set of symmetric embeddings meets.

    Vertex by vertex: a vertex that can still move must have the smallest image in its orbit, then it is held fixed.
    """
    maps, out = automorphisms(pattern), []
    for v in range(len(pattern.labels)):
        orbit = sorted({m[v] for m in maps})
        out += [(v, w) for w in orbit if w != v]
        maps = [m for m in maps if m[v] == v]
    return out
