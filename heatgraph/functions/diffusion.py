"""Diffusion kernels of connected networks as matrices, and the balance of the restart probability."""

from __future__ import annotations

import numpy as np

from heatgraph.functions.graph import array_components


def adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    a[src, dst] = a[dst, src] = 1
    return a


def restart_kernel(a: np.ndarray, beta: float) -> np.ndarray:
    """``beta (I - (1 - beta) W)^-1``; column j is where heat from seed j ends."""
    degree = np.maximum(a.sum(axis=0), 1)
    return beta * np.linalg.inv(np.eye(len(a)) - (1 - beta) * a / degree)


class Steps:
    """Sums over the neighbours of all vertices, ``u`` into ``v``, of whole rows at a time: the first neighbours of all that have one, then the second, and so on.

    Rows of a vertex are next to each other, so this is copying and adding in order, much faster than sums over stretches of edges.
    """

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        count = np.bincount(v, minlength=n)
        self.order = np.argsort(-count, kind="stable")  # vertices of most neighbours first, so those with a k-th are a prefix
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        to = self.place[v]
        by = np.lexsort((u, to))
        to, at = to[by], self.place[u[by]]
        begin = np.searchsorted(to, np.arange(n))
        rank = np.arange(len(to)) - begin[to]
        by = np.argsort(rank, kind="stable")
        ends = np.cumsum(np.bincount(rank)) if len(rank) else np.zeros(0, np.int64)
        self.steps = np.split(at[by], ends[:-1]) if len(ends) else []

    def __call__(self, x: np.ndarray, out: np.ndarray | None = None, then=None) -> np.ndarray:
        """Rows of ``x`` and of the result are vertices by ``place``; ``then(rows, sums)`` may go on with a stretch while it is in the cache."""
        out = np.empty_like(x) if out is None else out
        rows = max(1, 32_768 // max(x.shape[1], 1))
        held = np.empty((min(rows, len(x)), x.shape[1]))
        for first in range(0, len(x), rows):
            into = out[first : first + rows]
            filled = 0
            for i, at in enumerate(self.steps):
                part = at[first : first + rows]
                if not len(part):
                    break
                if i == 0:
                    filled = len(part)
                    np.take(x, part, axis=0, out=into[:filled], mode="clip")
                else:
                    np.take(x, part, axis=0, out=held[: len(part)], mode="clip")
                    into[: len(part)] += held[: len(part)]
            into[filled:] = 0
            if then is not None:
                then(slice(first, first + len(into)), into)
        return out


class Columns:
    """Columns of the restart kernel by blocks, each inside its component: what lies in another one is no entry.

    Vertices stand in the order of their components, small ones first, so a block is a stretch of whole components (few enough that
    its cells are bounded) and a stretch of columns, which are vertices counted inside each component.
    """

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, block: int, cells: int):
        label = array_components(n, src, dst)
        size = np.bincount(label, minlength=n)[label] if n else np.zeros(0, np.int64)
        self.order = np.lexsort((np.arange(n), label, size))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        u, v = place[np.concatenate([src, dst])], place[np.concatenate([dst, src])]
        by = np.argsort(u, kind="stable")
        self.u, self.v, self.degree = u[by], v[by], np.bincount(u, minlength=n)
        self.size = size[self.order]
        starts = np.flatnonzero(np.concatenate([[True], label[self.order][1:] != label[self.order][:-1]])) if n else np.zeros(0, np.int64)
        self.start = np.repeat(starts, self.size[starts])
        self.blocks: list[tuple[int, int, int, int]] = []
        first, ends = 0, [*starts[1:].tolist(), n]
        for begin, end in zip(starts.tolist(), ends):
            width = min(block, end - begin)
            if begin > first and (end - first) * width > cells:
                self._deal(first, begin, block, cells)
                first = begin
        if n:
            self._deal(first, n, block, cells)
        self.held: tuple = (None, None)

    def _deal(self, a: int, b: int, block: int, cells: int) -> None:
        width = max(1, min(block, cells // (b - a)))
        self.blocks += [(a, b, c, min(c + width, int(self.size[b - 1]))) for c in range(0, int(self.size[b - 1]), width)]

    def __call__(self, i: int, beta: float, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(vertex, seed, p)`` of all entries of a block, by place in ``order``."""
        a, b, low, high = self.blocks[i]
        if self.held[0] != (a, b):
            within = slice(np.searchsorted(self.u, a), np.searchsorted(self.u, b))
            self.held = (a, b), Steps(b - a, self.u[within] - a, self.v[within] - a)
        local = np.arange(a, b) - self.start[a:b]
        seeds = np.flatnonzero((local >= low) & (local < high))
        p = restarted(self.held[1], self.degree[a:b], beta, seeds, local[seeds] - low, high - low, tolerance)
        first = self.start[a:b] + low
        if self.size[a] == b - a:
            return np.repeat(np.arange(a, b), high - low), np.tile(np.arange(first[0], first[0] + high - low), b - a), p.ravel()
        row, column = np.nonzero(np.arange(low, high) < self.size[a:b, None])
        return row + a, first[row] + column, p[row, column]


def restarted(step: Steps, degree: np.ndarray, beta: float, rows: np.ndarray, columns: np.ndarray, width: int, tolerance: float) -> np.ndarray:
    """Heat that ends at each vertex from the seeds in ``rows``, each in its column, as the second-order Richardson iteration finds it.

    The walk is similar to a symmetric matrix of spectral radius 1, so with the weight ``2 / (1 + sqrt(1 - (1 - beta)^2))`` an iteration
    leaves a share ``sqrt(weight - 1)`` of what is wrong, in about half the rounds of the plain series.
    """
    d = np.maximum(degree, 1).astype(float)
    x = np.zeros((len(d), width))
    if not 0 < beta < 1:
        x[rows, columns] = beta
        return x
    weight = 2 / (1 + np.sqrt(1 - (1 - beta) ** 2))
    left, spread = np.sqrt(weight - 1), np.sqrt(d.max() / d.min())
    rounds = 1
    while spread * (1 + rounds * (1 - left**2)) * left**rounds > tolerance:
        rounds += 1
    d = d[step.order]
    at = step.place[rows]
    scale, own = (weight * (1 - beta) / d)[:, None], weight * beta / d[at]
    before, now = x, np.zeros_like(x)  # heat by degree
    now[at, columns] = beta / d[at]
    out, held = np.empty_like(x), np.empty_like(x)

    def then(stretch: slice, sums: np.ndarray) -> None:
        sums *= scale[stretch]
        kept = np.multiply(before[stretch], 1 - weight, out=held[: len(sums)])
        sums += kept

    for _ in range(rounds):
        step(now, out, then)
        out[at, columns] += own
        before, now, out = now, out, before
    now *= d[:, None]
    np.maximum(now, 0, out=now)
    return now[step.place]


def restart_columns(n: int, src: np.ndarray, dst: np.ndarray, beta: float, seeds: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Columns of the restart kernel for some seeds by iteration on edges; memory is edges + n x seeds."""
    step = Steps(n, np.concatenate([src, dst]), np.concatenate([dst, src]))
    degree = np.bincount(np.concatenate([src, dst]), minlength=n)
    return restarted(step, degree, beta, seeds, np.arange(len(seeds)), len(seeds), tolerance)


def neighbours(n: int, src: np.ndarray, dst: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(begin, to)``: where the neighbours of each vertex begin in ``to``; without ``both`` the edges are there in either direction."""
    u, v = (np.concatenate([src, dst]), np.concatenate([dst, src])) if both else (src, dst)
    order = np.argsort(u, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]), v[order]


def pushed_columns(begin: np.ndarray, to: np.ndarray, beta: float, seeds: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(vertex, seed, p)``: columns of the restart kernel for some seeds by forward push, each entry at most ``within`` below the kernel's.

    Heat that hasn't moved yet stays as a residual and is pushed on while it is over ``within / most * degree`` of its vertex. As walks of an
    undirected network are reversible, what is left can add at most that share of its own degree to a vertex. Work and memory
    follow the entries that are reached, not the network's size.
    """
    degree = np.diff(begin)
    n = len(degree)
    limit = within / max(int(degree.max(initial=1)), 1)
    place = np.arange(len(seeds), dtype=np.int64) * n
    keys, rest = place + seeds, np.ones(len(seeds))  # residuals, by seed and vertex
    done_keys, done = [np.zeros(0, np.int64)], [np.zeros(0)]
    while True:
        over = rest > limit * degree[keys % n]
        if not over.any():
            break
        moving, heat = keys[over], rest[over]
        done_keys.append(moving)
        done.append(beta * heat)
        v, count = moving % n, degree[moving % n]
        at = np.repeat(begin[v] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        arrived = np.repeat(moving - v, count) + to[at]
        share = np.repeat((1 - beta) * heat / np.maximum(count, 1), count)
        keys, where = np.unique(np.concatenate([keys[~over], arrived]), return_inverse=True)
        rest = np.bincount(where, np.concatenate([rest[~over], share]), len(keys))
        if len(done) > 16:
            held, where = np.unique(np.concatenate(done_keys), return_inverse=True)
            done_keys, done = [held], [np.bincount(where, np.concatenate(done), len(held))]
    held, where = np.unique(np.concatenate(done_keys), return_inverse=True)
    return held % n, seeds[held // n], np.bincount(where, np.concatenate(done), len(held))


def heat_columns(begin: np.ndarray, to: np.ndarray, time: float, seeds: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """Columns of ``exp(-time L)`` for some seeds, by the action of its Taylor series in steps; memory is vertices times seeds.

    ``exp(-time L) = exp(-c) exp(c I - time L)`` for a step with ``c = time * 2 * largest degree`` at most 8: all terms are positive, so nothing cancels.
    """
    degree = np.diff(begin)
    n, most = len(degree), 2.0 * max(int(degree.max(initial=0)), 1)
    steps = max(1, int(np.ceil(time * most / 8)))
    c = time * most / steps
    found = np.zeros((n, len(seeds)))
    found[seeds, np.arange(len(seeds))] = 1.0
    u = np.repeat(np.arange(n), degree)
    first, empty = np.minimum(begin[:-1], max(len(u) - 1, 0)), degree == 0
    for _ in range(steps):
        term, total, k = found, found.copy(), 0
        while term.max(initial=0.0) > tolerance:
            k += 1
            moved = np.add.reduceat(term[to], first, axis=0) if len(to) else np.zeros_like(term)
            moved[empty] = 0
            term = (c / k) * ((1 - degree / most)[:, None] * term + moved / most)
            total += term
        found = np.exp(-c) * total
    return found


def heat_kernel(a: np.ndarray, time: float) -> np.ndarray:
    """``exp(-time L)`` of the combinatorial Laplacian."""
    return symmetric_exp(-time * (np.diag(a.sum(axis=0)) - a))


def symmetric_exp(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return vectors * np.exp(values) @ vectors.T


def balance(a: np.ndarray, beta: float) -> float:
    """How much more heat the neighbours of all seeds hold than the other vertices."""
    p = restart_kernel(a, beta)
    np.fill_diagonal(p, 0)
    return float(p[a > 0].sum() - p[a == 0].sum())


def ridder(f, low: float, high: float, tolerance: float) -> float:
    """Root of a function of opposite signs at both ends."""
    at_low, at_high = f(low), f(high)
    if at_low == 0 or at_high == 0:
        return low if at_low == 0 else high
    if at_low * at_high > 0:
        raise ValueError("no change of sign")
    x = (low + high) / 2
    for _ in range(200):
        if high - low <= tolerance:
            break
        middle = (low + high) / 2
        at_middle = f(middle)
        scale = (at_middle**2 - at_low * at_high) ** 0.5
        x = middle if scale == 0 else middle + (middle - low) * (1 if at_low > at_high else -1) * at_middle / scale
        at_x = f(x)
        if at_x == 0:
            return x
        a, b = sorted([(middle, at_middle), (x, at_x)])
        for left, right in (((low, at_low), a), (a, b), (b, (high, at_high))):
            if left[1] * right[1] <= 0:
                (low, at_low), (high, at_high) = left, right
                break
    return x


def balanced_beta(n: int, src: np.ndarray, dst: np.ndarray, digits: int = 2) -> float:
    """The restart probability at which neighbours and the rest hold equal heat; isolated vertices count."""
    a = adjacency(n, src, dst)
    edge = 10.0**-digits
    return ridder(lambda b: balance(a, b), edge, 1 - edge, 10.0 ** -(digits + 1))


class Walk:
    """The walk over distinct edges (a loop once), by arrays, and where it comes to rest in each component."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        loop = src == dst
        u, v = np.concatenate([src, dst[~loop]]), np.concatenate([dst, src[~loop]])
        order = np.argsort(v, kind="stable")
        self.n, self.u, self.v = n, u[order], v[order]
        self.degree = np.bincount(u, minlength=n)
        self.label = array_components(n, src, dst)
        self.volume = np.bincount(self.label, self.degree, n)  # of each component

    def traces(self, seeds: np.ndarray, beta: float, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
        """The share of some seeds in the traces of ``W^k`` and ``A W^k`` (no diagonal in ``A``), less what they tend to, for k from 0.

        ``W`` is the walk, ``A`` the adjacency. Powers end where the rest is below the tolerance for any restart probability of ``beta`` or more.
        """
        seeds = seeds[self.degree[seeds] > 0]
        column = np.arange(len(seeds))
        step = Steps(self.n, self.u, self.v)
        rest = self.degree / np.maximum(self.volume[self.label], 1)
        x = -np.where(self.label[:, None] == self.label[seeds], rest[:, None], 0.0)[step.order]
        own = step.place[seeds]
        x[own, column] += 1.0  # what has not come to rest yet
        place = np.full(self.n, -1)
        place[seeds] = column
        near = (place[self.v] >= 0) & (self.u != self.v)
        row, of = step.place[self.u[near]], place[self.v[near]]
        most = int(np.ceil(np.log(tolerance) / np.log(1 - beta))) + 1
        own_by, near_by = [], []
        share = (1 / np.maximum(self.degree, 1))[step.order, None]
        for _ in range(most):
            own_by.append(x[own, column].sum())
            near_by.append(x[row, of].sum())
            if max(x.max(initial=0.0), -x.min(initial=0.0)) < tolerance:
                break
            x = step(x * share)
        return np.array(own_by), np.array(near_by)


def balanced_series(walk: Walk, own: np.ndarray, near: np.ndarray, digits: int = 2) -> float:
    """``balanced_beta`` from the traces of ``Walk.traces`` of all vertices."""
    active = walk.degree > 0
    whole = len(np.unique(walk.label[active]))
    apart = walk.u != walk.v
    rest = float((walk.degree[walk.u] / walk.volume[walk.label[walk.u]])[apart].sum())

    def f(beta: float) -> float:
        power = beta * (1 - beta) ** np.arange(len(own))
        hold = whole + float(power @ own)  # the diagonal of the kernel
        heat = rest + float(power @ near)  # what neighbours have
        return 2 * heat - (int(active.sum()) - hold)

    edge = 10.0**-digits
    return ridder(f, edge, 1 - edge, 10.0 ** -(digits + 1))
