"""The same patterns as SQL text, for checking against another engine."""

from __future__ import annotations

from .pattern import Pattern


def match_sql(pattern: Pattern, adjacency: str = "adj") -> str:
    """SELECT of m0.., b0.. (batches of the edges) over a relation (src, dst, el, sl, dl, batch), both directions."""
    place: dict[int, str] = {}
    joins = []
    todo = list(range(len(pattern.edges)))
    while todo:
        i = next((k for k in todo if not place or {pattern.edges[k][0], pattern.edges[k][1]} & set(place)), todo[0])
        todo.remove(i)
        u, w, label = pattern.edges[i]
        a = f"e{i}"
        terms = [f"{a}.el={label}", f"{a}.sl={pattern.labels[u]}", f"{a}.dl={pattern.labels[w]}"]
        for v, column in ((u, "src"), (w, "dst")):
            if v in place:
                terms.append(f"{a}.{column}={place[v]}")
            else:
                terms += [f"{a}.{column}<>{place[x]}" for x in pattern.must_differ(v, place)]
                place[v] = f"{a}.{column}"
        joins.append((a, " and ".join(terms)))
    first = joins[0]
    source = f"{adjacency} {first[0]}" + "".join(f" join {adjacency} {a} on {on}" for a, on in joins[1:])
    columns = [f"{place[v]} as m{v}" for v in range(len(pattern.labels))] + [f"e{i}.batch as b{i}" for i in range(len(pattern.edges))]
    return f"select {', '.join(columns)} from {source} where {first[1]}"


def batch_sql(pattern: Pattern) -> str:
    """Expression of an embedding's batch over the columns of ``match_sql``."""
    names = [f"b{i}" for i in range(len(pattern.edges))]
    return names[0] if len(names) == 1 else f"greatest({', '.join(names)})"
