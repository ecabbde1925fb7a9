"""Patterns: small labelled graphs to look for."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

#: Limits of a pattern.
MAX_VERTICES, MAX_EDGES = 16, 42


class PatternError(ValueError):
    """The pattern is malformed or outside the limits."""


@dataclass(frozen=True)
class Pattern:
    """Vertex i has label ``labels[i]``; edges are (u, w, label) with u < w, in canonical order."""

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(labels, edges) -> Pattern:
        """Edges may be given as (u, w) with label 0, in any direction."""
        full = []
        for e in edges:
            u, w, label = (*e, 0)[:3]
            full.append((min(u, w), max(u, w), label))
        return Pattern(tuple(labels), tuple(sorted(full))).checked()

    def checked(self) -> Pattern:
        n = len(self.labels)
        if not 2 <= n <= MAX_VERTICES:
            raise PatternError(f"a pattern has 2 to {MAX_VERTICES} vertices, not {n}")
        if len(self.edges) > MAX_EDGES:
            raise PatternError(f"a pattern has at most {MAX_EDGES} edges, not {len(self.edges)}")
        pairs = [(u, w) for u, w, _ in self.edges]
        if len(set(pairs)) < len(pairs):
            raise PatternError("two edges join the same vertices")
        if any(u == w or not 0 <= u < n or not 0 <= w < n for u, w in pairs):
            raise PatternError("an edge is a loop or leads to an unknown vertex")
        seen, todo = {0}, [0]
        while todo:
            for v in self.neighbours(todo.pop()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        if len(seen) < n:
            raise PatternError("a pattern must be connected")
        return self

    def neighbours(self, v: int) -> list[int]:
        return sorted(w if u == v else u for u, w, _ in self.edges if v in (u, w))

    def edge_index(self, u: int, w: int) -> int:
        return next(i for i, (a, b, _) in enumerate(self.edges) if {a, b} == {u, w})

    def triple(self, u: int, w: int) -> tuple[int, int, int]:
        """(label of u, edge label, label of w)."""
        return self.labels[u], self.edges[self.edge_index(u, w)][2], self.labels[w]

    def directed(self) -> list[tuple[int, int]]:
        """Directed edges: u to w, then w to u, for each edge."""
        return [d for u, w, _ in self.edges for d in ((u, w), (w, u))]

    def requirements(self, v: int) -> Counter:
        """How many neighbours of each (edge label, neighbour label) an image of ``v`` needs."""
        return Counter(self.triple(v, w)[1:] for w in self.neighbours(v))

    def leaves(self) -> list[int]:
        return [v for v in range(len(self.labels)) if len(self.neighbours(v)) == 1]

    def must_differ(self, v: int, bound) -> list[int]:
        """Bound vertices whose image could be that of ``v``: those of its label."""
        return [b for b in bound if b != v and self.labels[b] == self.labels[v]]


def parse_pattern(text: str) -> Pattern:
    """Lines ``v id label`` and ``e id id label``; ``t`` lines and empty ones are skipped. Ids are dense from 0."""
    labels: dict[int, int] = {}
    edges = []
    for line in text.splitlines():
        part = line.split()
        if not part or part[0] == "t":
            continue
        if part[0] == "v" and len(part) >= 3:
            labels.setdefault(int(part[1]), int(part[2]))
        elif part[0] == "e" and len(part) >= 3:
            edges.append((int(part[1]), int(part[2]), int(part[3]) if len(part) > 3 else 0))
        else:
            raise PatternError(f"line not understood: {line!r}")
    if sorted(labels) != list(range(len(labels))):
        raise PatternError("vertex ids must be dense from 0")
    return Pattern.of([labels[i] for i in range(len(labels))], edges)


def load_pattern(path: str) -> Pattern:
    with open(path, encoding="utf-8") as f:
        return parse_pattern(f.read())
