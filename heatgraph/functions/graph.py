"""Kernels on directed and undirected graphs held as arrays; none of them recurses."""

from __future__ import annotations

import numpy as np


class UnionFind:
    """Weighted union with path compression; counts of sizes are kept up to date."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: int, b: int) -> tuple[int, int] | None:
        """(kept, absorbed) roots, or None if they were one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return None
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        return a, b


def _rows(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist(), dst[order].tolist()


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A component number for each of ``n`` vertices (path-based, with an explicit stack)."""
    begin, to = _rows(n, np.asarray(src), np.asarray(dst))
    number, label = [0] * n, [-1] * n
    path: list[int] = []  # vertices whose component is open
    bounds: list[int] = []  # possible roots among them
    counter = made = 0
    for start in range(n):
        if number[start]:
            continue
        todo = [(start, begin[start])]
        counter += 1
        number[start] = counter
        path.append(start)
        bounds.append(start)
        while todo:
            v, at = todo.pop()
            while at < begin[v + 1]:
                w = to[at]
                at += 1
                if not number[w]:
                    todo.append((v, at))
                    counter += 1
                    number[w] = counter
                    path.append(w)
                    bounds.append(w)
                    todo.append((w, begin[w]))
                    break
                if label[w] < 0:
                    while number[bounds[-1]] > number[w]:
                        bounds.pop()
            else:
                if bounds[-1] == v:
                    bounds.pop()
                    while True:
                        w = path.pop()
                        label[w] = made
                        if w == v:
                            break
                    made += 1
    return np.array(label, np.int64)


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A component number for each vertex of an undirected graph."""
    sets = UnionFind(n)
    for a, b in zip(np.asarray(src).tolist(), np.asarray(dst).tolist()):
        sets.union(a, b)
    return np.array([sets.find(v) for v in range(n)], np.int64)


def groups(labels: np.ndarray, names: list, touched: np.ndarray | None = None, min_size: int = 1) -> list[list]:
    """Members sorted in each component; components by size, then first member."""
    found: dict[int, list] = {}
    for v, label in enumerate(labels.tolist()):
        if touched is None or touched[v]:
            found.setdefault(label, []).append(names[v])
    return sorted((sorted(g) for g in found.values() if len(g) >= min_size), key=lambda g: (-len(g), g))


def threshold_components(weights: np.ndarray, delta: float, directed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(label, touched) of the graph with an edge j -> i for each ``weights[i, j] >= delta``."""
    i, j = np.nonzero(weights >= delta)
    touched = np.zeros(len(weights), bool)
    touched[i] = touched[j] = True
    return (strong_components if directed else components)(len(weights), j, i), touched


def sizes_at(weights: np.ndarray, delta: float, directed: bool = True) -> np.ndarray:
    label, touched = threshold_components(weights, delta, directed)
    return np.bincount(np.unique(label[touched], return_inverse=True)[1]) if touched.any() else np.zeros(0, np.int64)


def array_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's component, by arrays: roots are hooked to smaller ones and chains cut short until nothing changes."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        differ = a != b
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        src, dst = src[differ], dst[differ]


def swapped(edges: np.ndarray, n: int, swaps: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Double edge swaps that keep degrees, simplicity and connectivity, and how many were made.

    A round deals edges into pairs and swaps those whose new edges are free, which old ones are only once the round ends, so any of its
    swaps can be undone: those that touch what is no longer connected to the largest component are, until nothing is. The next round is half as long if
    most swaps were undone, else longer, up to all edges. Fewer swaps than wanted are made only where 50 tries for each don't find them.
    """
    now = np.sort(np.asarray(edges, np.int64).reshape(-1, 2), axis=1)
    m, done, tries = len(now), 0, 0
    window = m // 2
    while done < swaps and m > 1 and tries < 50 * swaps + 100:
        pairs = min(window, m // 2)
        chosen = rng.permutation(m) if 8 * pairs > m else rng.choice(m, 2 * pairs, replace=False)
        a, b = chosen[:pairs], chosen[pairs : 2 * pairs]
        tries += pairs
        (u, v), (x, y) = now[a].T, now[b].T
        turned = rng.random(pairs) < 0.5
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        apart = (u != x) & (u != y) & (v != x) & (v != y)
        one, two = np.minimum(u, y) * n + np.maximum(u, y), np.minimum(x, v) * n + np.maximum(x, v)
        free = ~np.isin(np.stack([one, two]), now[:, 0] * n + now[:, 1]).any(axis=0)
        at = np.flatnonzero(apart & free)
        wanted = np.stack([one[at], two[at]], axis=1).ravel()
        first = np.zeros(len(wanted), bool)
        first[np.unique(wanted, return_index=True)[1]] = True  # of equal new edges the earlier pair gets it
        at = at[first.reshape(-1, 2).all(axis=1)][: swaps - done]
        asked = len(at)
        while len(at):
            made = now.copy()
            made[a[at]] = np.stack([one[at] // n, one[at] % n], axis=1)
            made[b[at]] = np.stack([two[at] // n, two[at] % n], axis=1)
            label = array_components(n, made[:, 0], made[:, 1])
            off = label != np.bincount(label).argmax()
            if not off.any():
                now = made
                break
            kept = at[~(off[now[a[at]]].any(axis=1) | off[now[b[at]]].any(axis=1))]
            if len(kept) == len(at):
                raise ValueError("the network must be connected")
            at = kept
        done += len(at)
        window = max(1, window // 2) if 2 * len(at) < asked else min(2 * window + 1, m // 2)
    return now[np.lexsort((now[:, 1], now[:, 0]))], done
