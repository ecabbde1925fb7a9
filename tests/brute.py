"""A plain enumerator of embeddings, to hold the engine against."""

from itertools import permutations


def embeddings(pattern, labels, edges):
    """All embeddings as tuples. labels: id to label; edges: (a, b) with a < b to label."""
    out = set()
    for image in permutations(labels, len(pattern.labels)):
        if all(labels[x] == pattern.labels[v] for v, x in enumerate(image)):
            if all(edges.get((min(image[u], image[w]), max(image[u], image[w]))) == l for u, w, l in pattern.edges):
                out.add(image)
    return out


def increments(pattern, labels, initial, batches):
    """The new embeddings of each batch; the first arrival of an edge counts."""
    edges = {}
    for a, b, l in initial:
        if a != b:
            edges.setdefault((min(a, b), max(a, b)), l)
    before, out = embeddings(pattern, labels, edges), []
    for batch in batches:
        for a, b, l in batch:
            if a != b:
                edges.setdefault((min(a, b), max(a, b)), l)
        after = embeddings(pattern, labels, edges)
        out.append(after - before)
        before = after
    return out
