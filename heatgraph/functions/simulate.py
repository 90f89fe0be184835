"""Seeded test networks with planted hot cliques, and random weighted graphs."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def vertex_names(n: int) -> list[str]:
    """``n`` distinct names of letters, all of one length, in ascending order."""
    width = 1
    while 26**width < n:
        width += 1
    return ["".join(chr(97 + i // 26**k % 26) for k in reversed(range(width))) for i in range(n)]


def preferential_attachment(n: int, m: int, rng: np.random.Generator) -> set[tuple[int, int]]:
    """Edges of a graph that grows vertex by vertex, each new one joined to ``m`` others chosen by degree."""
    ends = list(range(m))  # a vertex stands here once for each of its edges
    edges = set()
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[int(rng.integers(len(ends)))])
        edges |= {(u, v) for u in chosen}
        ends += [*sorted(chosen), *[v] * m]
    return edges


def simulated_study(
    n: int = 250,
    min_edges: int = 750,
    cliques: tuple[int, ...] = (5,) * 5 + (10,) * 5,
    network_sizes: tuple[int, ...] = (225, 235, 245),
    heat_sizes: tuple[int, ...] = (230, 240),
    seed: int = 0,
) -> tuple[list[list[tuple[str, str]]], list[dict[str, float]], list[list[str]]]:
    """(networks, heats, planted cliques) by vertex name.

    The smallest attachment that gives more than ``min_edges`` edges is taken, then disjoint cliques are
    planted. Heats are exponential, and the highest of them go to planted vertices. Each network is the
    graph induced by a sample of the vertices, each heat a sample of the scores.
    """
    attach = next((m for m in range(1, n) if (n - m) * m > min_edges), None)
    if attach is None or sum(cliques) > n:
        raise ValueError("no such graph: too few vertices")
    rng = np.random.default_rng(seed)
    names = vertex_names(n)
    edges = preferential_attachment(n, attach, rng)
    order = rng.permutation(n).tolist()
    planted, at = [], 0
    for size in cliques:
        planted.append(sorted(order[at : at + size]))
        edges |= set(combinations(planted[-1], 2))
        at += size
    hot, rest = rng.permutation(order[:at]).tolist(), rng.permutation(order[at:]).tolist()
    scores = dict(zip(hot + rest, np.sort(rng.exponential(size=n))[::-1].tolist()))
    networks, heats = [], []
    for size in network_sizes:
        inside = set(rng.choice(n, size, replace=False).tolist())
        networks.append(sorted((names[u], names[v]) for u, v in edges if u in inside and v in inside))
    for size in heat_sizes:
        heats.append({names[v]: scores[v] for v in sorted(rng.choice(n, size, replace=False).tolist())})
    return networks, heats, [[names[v] for v in c] for c in planted]


def random_weights(n: int, sparsity: float = 0.0, levels: int | None = None, seed: int = 0) -> np.ndarray:
    """A random directed weight matrix without loops; a share ``sparsity`` of its cells is 0, ``levels`` makes ties."""
    rng = np.random.default_rng(seed)
    w = rng.random((n, n))
    if levels:
        w = np.ceil(w * levels) / levels
    w[rng.random((n, n)) < sparsity] = 0.0
    np.fill_diagonal(w, 0.0)
    return w
