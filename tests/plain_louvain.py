"""Modularity communities of a small graph in memory, one node after another: what the distributed operator is held against."""


def louvain(edges: list[tuple[str, str, float]], rounds: int = 20, whole: float | None = None) -> dict[str, int]:
    """Weighted modularity communities by local moves and aggregation, nodes in sorted order; numbered by smallest member.

    ``whole`` is the weight of all edges of the graph, where these are those of a part that nothing ties to the rest.
    """
    weights: dict[tuple[str, str], float] = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            weights[key] = weights.get(key, 0.0) + (w or 1.0)
    names = sorted({x for pair in weights for x in pair})
    group = {n: k for k, n in enumerate(names)}
    level = {(group[a], group[b]): w for (a, b), w in weights.items()}
    total = whole or sum(level.values())
    if not level:
        return group
    for _ in range(rounds):
        near: dict[int, dict[int, float]] = {}
        degree: dict[int, float] = {}
        for (a, b), w in level.items():
            degree[a] = degree.get(a, 0.0) + w
            degree[b] = degree.get(b, 0.0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
                near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
        at = {n: n for n in degree}
        load = dict(degree)
        moved = any_move = True
        while moved:
            moved = False
            for n in sorted(degree):
                pull: dict[int, float] = {}
                for m, w in near.get(n, {}).items():
                    pull[at[m]] = pull.get(at[m], 0.0) + w
                load[at[n]] -= degree[n]
                gain = lambda c: pull.get(c, 0.0) - load.get(c, 0.0) * degree[n] / (2 * total)  # noqa: B023, E731
                best = min({*pull, at[n]}, key=lambda c: (-round(gain(c), 12), c != at[n], c))
                if best != at[n] and gain(best) > gain(at[n]) + 1e-12:
                    at[n], moved = best, True
                load[at[n]] = load.get(at[n], 0.0) + degree[n]
        any_move = any(a != c for a, c in at.items())
        group = {name: at.get(c, c) for name, c in group.items()}
        if not any_move:
            break
        merged: dict[tuple[int, int], float] = {}
        for (a, b), w in level.items():
            key = (min(at[a], at[b]), max(at[a], at[b]))
            merged[key] = merged.get(key, 0.0) + w
        level = merged
    order = {c: k for k, c in enumerate(dict.fromkeys(group[n] for n in names))}
    return {n: order[group[n]] for n in names}


def modularity(edges, found):
    """Of a partition, from the definition."""
    total = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if found[a] == found[b])
    load = {}
    for a, b, w in edges:
        for x in (a, b):
            load[found[x]] = load.get(found[x], 0.0) + w
    return inside / total - sum(x * x for x in load.values()) / (4 * total * total)
