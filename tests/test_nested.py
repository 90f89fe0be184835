"""Hierarchies as DataFrames against components at every threshold."""

import numpy as np
import pytest

from heatgraph.functions import graph, hierarchy
from heatgraph.operators import nested, tree


def plain(edges, increasing=False):
    """Names end where a smaller vertex joins: strong components at each weight, one after the other."""
    names = sorted({x for e in edges for x in e[:2]})
    place = {x: i for i, x in enumerate(names)}
    found, open_ = set(), set(range(len(names)))
    for w in sorted({e[2] for e in edges}, reverse=not increasing):
        kept = [(place[u], place[v]) for u, v, x in edges if (x <= w if increasing else x >= w)]
        label = graph.strong_components(len(names), *np.array(kept).T)
        least = {}
        for i, x in enumerate(label.tolist()):
            least.setdefault(x, i)
        for i in sorted(open_):
            if least[label[i]] != i:
                found.add((names[i], names[least[label[i]]], w))
                open_.remove(i)
    return found


def digraph(n, m, levels, seed):
    rng = np.random.default_rng(seed)
    best = {}
    for u, v, w in zip(rng.integers(0, n, m).tolist(), rng.integers(0, n, m).tolist(), rng.integers(1, levels + 1, m).tolist()):
        if u != v:
            best[u, v] = w / 4
    return [(u, v, w) for (u, v), w in best.items()]


@pytest.mark.parametrize("small", [1, 40, 10_000])
def test_merges_like_components_at_every_threshold(spark, small):
    nets = {"a": digraph(14, 60, 9, 1), "b": digraph(10, 24, 2, 2), "c": [(0, 1, 1.0), (1, 2, 1.0)]}  # no cycle in c: nothing merges
    frame = spark.createDataFrame([(k, *e) for k, edges in nets.items() for e in edges], "network string, src int, dst int, w double")
    got = {(r.network, r.part, r.whole, r.weight) for r in nested.merges(frame, small=small).collect()}
    assert got == {(k, *row) for k, edges in nets.items() for row in plain(edges)} and got


def test_increasing_names_and_odd_rows(spark):
    edges = [(f"v{u:02}", f"v{v:02}", w) for u, v, w in digraph(9, 40, 6, 5)]
    odd = [("v00", "v00", 9.0), ("v00", "v01", None), (None, "v01", 1.0), ("v00", "v01", float("nan")), ("v00", "v02", 0.0), (*edges[0][:2], edges[0][2] + 5)]
    frame = spark.createDataFrame([(7, *e) for e in edges + odd] + [(None, "v00", "v01", 1.0)], "network int, src string, dst string, w double")
    made = nested.merges(frame, increasing=True, small=12)
    assert {(r.part, r.whole, r.weight) for r in made.collect()} == plain(edges, True)
    at = {r.node: r.component for r in nested.clusters(made, 0.75, increasing=True).collect()}
    names = sorted({x for e in edges for x in e[:2]})
    kept = [(names.index(u), names.index(v)) for u, v, w in edges if w <= 0.75]
    label = graph.strong_components(len(names), *np.array(kept).T).tolist()
    assert at == {x: names[label.index(label[i])] for i, x in enumerate(names) if label.count(label[i]) > 1}
    none = nested.merges(frame.limit(0))
    assert none.count() == 0 and none.columns == ["network", "part", "whole", "weight"]


def shape(made):
    """Inner nodes by weight, members and the members of their parts."""
    return sorted((made.weight[x], made.members(x), sorted(made.members(c) for c in made.children[x])) for x in made.inner())


@pytest.mark.parametrize("n,m", [(12, 45), (20, 24)])
def test_dendrogram_like_the_dense_form(spark, n, m):
    edges = digraph(n, m, 7, m) + [(3, 3, 11.0)]
    dense = np.zeros((n, n))
    for u, v, w in edges:
        dense[u, v] = w
    made = tree.largest_tree(spark.createDataFrame(edges, "src int, dst int, w double"))
    want = hierarchy.decompose(list(range(n)), dense)
    assert made.names == want.names and made.weight[: len(made.names)] == want.weight[: len(want.names)]
    assert shape(made) == shape(want) and hierarchy.linkage(made) == hierarchy.linkage(want)
    assert sorted(hierarchy.newick(made)) == sorted(hierarchy.newick(want))


def test_dendrograms_without_merges(spark):
    make = lambda rows: tree.largest_tree(spark.createDataFrame(rows, "src int, dst int, w double"))
    assert hierarchy.newick(make([(2, 1, 1.0)])) == "1;" and make([]).names == []


@pytest.mark.parametrize("increasing", [False, True])
def test_cutoffs_count_clusters_without_partitions(spark, increasing):
    """What is held at each threshold, as in the partitions; but no list of members goes into a join."""
    rng = np.random.default_rng(4)
    rows = [(k, i, j, float(rng.integers(1, 12))) for k in ("a", "b") for i in range(14) for j in range(14) if i != j and rng.random() < 0.4]
    nodes = tree.tree(spark.createDataFrame(rows, "network string, src bigint, dst bigint, w double"), increasing).localCheckpoint()
    every = [(r.network, r.delta, len(r.members)) for r in tree.all_clusters(nodes, increasing=increasing).collect()]
    for number, size, by_vertices in ((1, 2, False), (2, 2, False), (12, 1, False), (5, 3, True), (0, 9, True), (15, 1, True)):
        got = tree.cutoffs(nodes, number, size, by_vertices, increasing=increasing)
        want = {}
        for k, d in sorted({x[:2] for x in every}, key=lambda x: x[1], reverse=not increasing):
            held = sum((n if by_vertices else 1) for p, q, n in every if (p, q) == (k, d) and n >= size)
            if held >= number:
                want.setdefault(k, d)
        assert {r.network: r.delta for r in got.collect()} == want
    assert "members" not in got._jdf.queryExecution().toString()


def test_several_components_need_few_edges(spark):
    """Each component has its own cycles, some are joined only by light edges, and a light loop is the heaviest edge of nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for first, n, scale in ((0, 14, 1.0), (14, 12, 1.0), (26, 9, 1.0)):
        rows += [(first + i, first + j, float(np.round(rng.random() ** 3 + 1, 3) * scale)) for i in range(n) for j in range(n)]
    apart = [("net", *r) for r in rows]
    light = [("net", 0, 14, 0.25), ("net", 3, 15, 0.5), ("net", 15, 2, 0.125), ("net", 20, 30, 0.75), ("net", 40, 0, 0.5)]
    for every in (apart, apart + light):
        whole = spark.createDataFrame(every, "network string, src int, dst int, w double")
        part = tree.needed(whole).localCheckpoint()
        assert part.count() < len(every) / 2
        assert set(map(tuple, part.collect())) <= set(every)
        merged = [sorted(map(tuple, nested.merges(x).collect())) for x in (whole, part)]
        assert merged[0] == merged[1] and merged[0]
        drawn = [tree.tree(x).where("size(members) > 1").select("weight", "members").collect() for x in (whole, part)]
        assert sorted(map(tuple, drawn[0])) == sorted(map(tuple, drawn[1]))
        first, second = (tree.drawings(x).first() for x in (whole, part))
        assert first.linkage == second.linkage and sorted(first.newick) == sorted(second.newick)  # siblings are in no order


def test_rounds_are_few_jobs(spark):
    """What the driver holds of jobs and plans grows with their number."""
    frame = spark.createDataFrame([("a", *e) for e in digraph(14, 60, 9, 1)], "network string, src int, dst int, w double")
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert nested.merges(frame, small=20).count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150, jobs
