"""Strong components, spanning forests, order statistics and threshold searches as DataFrames, against dense and plain forms."""

import numpy as np
import pytest

from heatgraph.functions import graph, thresholds
from heatgraph.operators import delta, levels, similarity
from heatgraph.operators.connected import strong_components
from heatgraph.plans.ranks import Ranked, numbered


def plain_strong(n, edges):
    edges = np.array(edges, np.int64).reshape(-1, 2)
    label, first = graph.strong_components(n, *edges.T), {}
    for i, x in enumerate(label.tolist()):
        first.setdefault(x, i)
    return {i: first[label[i]] for i in set(edges.ravel().tolist())}


def test_strong_components(spark):
    rng = np.random.default_rng(1)
    for n, m in ((6, 8), (60, 80), (50, 300)):
        edges = rng.integers(0, n, (m, 2)).tolist()
        got = {r.node: r.component for r in strong_components(spark.createDataFrame(edges + edges[:3], "u bigint, v bigint")).collect()}
        assert got == plain_strong(n, edges)
    ways = [(i, i * 7 % 300 + 3) for i in range(300)] + [(400 + i, 401 + i) for i in range(150)] + [(7, 7), (900, 900)]
    assert {r.node: r.component for r in strong_components(spark.createDataFrame(ways, "u bigint, v bigint")).collect()} == plain_strong(901, ways)
    odd = spark.createDataFrame([("a", None), (None, "b"), ("c", "c")], "u string, v string")
    assert [tuple(r) for r in strong_components(odd).collect()] == [("c", "c")]
    assert strong_components(odd.where("u = 'x'")).collect() == []


def test_strong_components_of_a_million_edges(spark):
    """Some hundred thousand vertices: a giant component, small ones, and paths between them."""
    n, rng = 400_000, np.random.default_rng(4)
    body = rng.integers(0, 300_000, (950_000, 2))
    rings = np.array([(300_000 + 5 * k + i, 300_000 + 5 * k + (i + 1) % 5) for k in range(10_000) for i in range(5)])
    edges = np.concatenate([body, rings, np.stack([rings[::5, 0], rng.integers(0, 300_000, len(rings[::5]))], axis=1)])
    import pandas as pd

    found = strong_components(spark.createDataFrame(pd.DataFrame(edges, columns=["u", "v"])).repartition(4)).toPandas()
    want = plain_strong(n, edges)
    assert len(edges) > 1_000_000 and dict(zip(found["node"], found["component"])) == want


def test_large_groups_are_like_small_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), d, f"n{a}", f"n{b}") for k, m in ((1, 40), (2, 5), (3, 60)) for d in (0.5, 0.1) for a, b in rng.integers(0, 25, (m, 2))]
    edges = spark.createDataFrame(rows, "perm_id bigint, delta double, src string, dst string")
    for directed in (True, False):
        one, other = (sorted(map(tuple, similarity.component_members(edges, ["perm_id", "delta"], directed, most).collect())) for most in (1000, 20))
        assert one == other


def plain_forest(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, u, v, rank in sorted(edges, key=lambda e: (e[0], e[3])):
        a, b = find((p, u)), find((p, v))
        if a != b:
            parent[a] = b
            yield p, u, v, rank


def test_spanning_forest(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p, n, m in ((1, 30, 80), (2, 12, 6), (4, 40, 200)):
        rows += [(p, int(a), int(b), int(r)) for (a, b), r in zip(rng.integers(0, n, (m, 2)), rng.permutation(m))]
    got = levels.spanning_forest(spark.createDataFrame(rows, "perm_id bigint, u bigint, v bigint, rank bigint")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_forest(rows))
    assert levels.spanning_forest(spark.createDataFrame([(1, 5, 5, 0)], "perm_id bigint, u bigint, v bigint, rank bigint")).collect() == []


def test_rows_by_rank(spark):
    rows = [(p, float(x)) for p in (1, 2, 7) for x in np.random.default_rng(p).permutation(50 * p)]
    ranked = Ranked(spark.createDataFrame(rows, "perm_id bigint, w double").repartition(5), "w")
    assert ranked.counts == {1: 50, 2: 100, 7: 350}
    assert {(r.perm_id, r.w): r["rank"] for r in ranked.ranked().collect()} == {(p, x): int(x) for p, x in rows}
    assert ranked.at({(1, 0), (2, 99), (7, 123)}, "w") == {(1, 0): 0.0, (2, 99): 99.0, (7, 123): 123.0}


def test_rows_numbered_over_all_tasks(spark):
    names = [f"n{i:04}" for i in np.random.default_rng(1).permutation(3000)]
    got = {r.name: r.at for r in numbered(spark.createDataFrame([(x,) for x in names], "name string").repartition(7), "at", "name").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(names))}
    assert numbered(spark.createDataFrame([], "name string"), "at", "name").collect() == []


def matrices(spark, n, digits, holes, seed=3):
    """A kernel and two heats, and the dense matrices of both."""
    rng = np.random.default_rng(seed)
    p = np.round(rng.random((n, n)) ** 4, digits)
    p[rng.random((n, n)) < holes] = 0
    p += np.diag(rng.random(n)).round(digits)
    cells = [(f"n{i:02d}", f"n{j:02d}", float(p[i, j])) for i in range(n) for j in range(n) if p[i, j] > 0 or not holes]
    heat = [(k, f"n{i:02d}", float(round(x, digits))) for k in (1, 2) for i, x in enumerate(rng.random(n)) if i % 7 or k == 1]

    def dense(k, directed):
        own = {int(a[1:]): x for q, a, x in heat if q == k}
        at, h = sorted(own), np.array([own[i] for i in sorted(own)])
        q = p[np.ix_(at, at)]
        return q * h if directed else np.minimum(q, q.T) * np.maximum(h[:, None], h)

    return spark.createDataFrame(cells, "dst string, src string, p double"), spark.createDataFrame([*heat, (1, "elsewhere", 3.0)], "perm_id int, node string, score double"), dense


@pytest.mark.parametrize("n,digits,holes", [(14, 9, 0.0), (20, 2, 0.3)])
@pytest.mark.parametrize("directed", [True, False])
def test_searches_like_dense_ones(spark, n, digits, holes, directed):
    kernel, heats, dense = matrices(spark, n, digits, holes)
    got = {(r.perm_id, r["size"]): r.delta for r in delta.by_heats(kernel, heats, [2, 3, 5, 9], delta.LARGEST, directed).collect()}
    assert got == {(k, s): d for k in (1, 2) for s, d in thresholds.by_largest_component(dense(k, directed), [2, 3, 5, 9], directed).items()}
    got = {(r.perm_id, r["size"]): r.delta for r in levels.by_component_count(kernel, heats, [2, 3], directed, 0.2).collect()}
    assert got == {(k, s): d for k in (1, 2) for s, d in thresholds.by_component_count(dense(k, directed), [2, 3], 0.2).items()}


@pytest.mark.parametrize("statistic,directed", [(delta.LARGEST, True), (delta.LARGEST, False), (delta.COUNT, False)])
def test_large_networks_hold_no_matrix(spark, statistic, directed, monkeypatch):
    """Kernels of permuted networks searched by all tasks give what a task with the matrix finds."""
    rng = np.random.default_rng(8)
    edges = {(k, *sorted(x)) for k in (1, 2) for x in [(i, i + 1) for i in range(23)] + [tuple(map(int, rng.choice(24, 2, replace=False))) for _ in range(30)]}
    networks = spark.createDataFrame(sorted(edges), "perm_id bigint, src bigint, dst bigint")
    heat = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.random(24)) if i % 5], "node bigint, score double")
    want, got = ({(r.perm_id, r["size"]): r.delta for r in delta.by_networks(networks, heat, 0.4, [2, 3, 6], statistic, directed, most).collect()} for most in (24, 23))
    assert len(want) == 6 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    made = []
    monkeypatch.setattr(delta, "by_heats", lambda kernel, heats, *rest: made.append(kernel) or kernel.selectExpr("perm_id", "1 as size", "p + 0D as delta").limit(0))
    delta.by_networks(networks.where("perm_id = 1 or src < 9 and dst < 9"), heat, 0.4, [2], most=10)
    assert [r.perm_id for r in made[0].select("perm_id").distinct().collect()] == [1]  # the other is small


def test_stretches_without_components():
    assert thresholds.best_stretches([], 2, 5) == [(0, 1), (0, 5)]  # the first weight counts twice
    assert thresholds.best_stretches([(2, "a", "b"), (3, "c", "d"), (6, "a", "c")], 2, 9) == [(3, 6)]


def test_multiples_like_dense_ones(spark):
    kernel, heats, dense = matrices(spark, 16, 6, 0.0)
    own = heats.where("perm_id = 1 and node <> 'elsewhere'")
    found = spark.createDataFrame([(1, 3, 0.05), (2, 3, 0.07), (3, 3, 0.01)], "perm_id bigint, size int, delta double")
    w = dense(1, False)
    i = next((i for i in range(1, 11) if graph.sizes_at(w, i * 0.05, False).max(initial=0) <= 4), 10)
    assert delta.multiples(kernel, own, found, 3, 4) == [k * 0.05 for k in range(i, i + 5)]


def test_both_ways_of_a_pair_meet_once(spark, monkeypatch):
    """Cells of all permutations come from one written half of the kernel, with the lesser of both ways; zeros are in no half."""
    rng = np.random.default_rng(12)
    n = 9
    p = np.round(rng.random((n, n)) + 0.01, 4)
    p[2, 5] = p[7, 7] = 0
    kernel = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n)], "dst int, src int, p double")
    heats = spark.createDataFrame([(k, i, float(rng.random())) for k in (1, 2) for i in range(n)], "perm_id bigint, node int, score double")
    seen, whole = [], levels.cells
    monkeypatch.setattr(levels, "cells", lambda k, *a, **b: seen.append(k.where("dst > src").count()) or whole(k, *a, **b))
    assert levels.by_component_count(kernel, heats, [2], share=0.5).count() == 2
    assert seen == [0]
    half = {(r.dst, r.src): r.p for r in levels.upper(kernel).collect()}
    assert half == {(i, j): min(p[i, j], p[j, i]) for i in range(n) for j in range(i, n) if min(p[i, j], p[j, i]) > 0}
