"""Networks permuted in rounds: invariants, independence of partitions, odd input."""

from collections import Counter

import numpy as np
import pytest

from heatgraph.functions import graph
from heatgraph.operators import network, swaps
from heatgraph.operators.swaps import _cut_off, _dealt, _edges, _made, _undone, permuted_in_rounds


def made_edges(n, more, seed):
    """A random tree with further edges: many vertices of degree one, so swaps cut often."""
    rng = np.random.default_rng(seed)
    edges = {(int(rng.integers(0, v)), v) for v in range(1, n)}
    while len(edges) < n - 1 + more:
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a != b:
            edges.add((a, b))
    return sorted(edges)


def whole(rows):
    names = sorted({x for e in rows for x in e})
    place = {x: i for i, x in enumerate(names)}
    src, dst = np.array([(place[a], place[b]) for a, b in rows]).T
    return len(set(graph.components(len(names), src, dst).tolist())) == 1


def degrees(rows):
    return Counter(x for e in rows for x in e)


def by_network(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.perm_id, []).append((r.src, r.dst))
    return found


@pytest.mark.parametrize("more,share", [(4, 0.1), (150, 0.5)])
def test_degrees_connection_and_swaps(spark, more, share):
    edges = made_edges(90, more, more)
    frame = spark.createDataFrame(edges, "src int, dst int")
    out = permuted_in_rounds(frame, 3, share, seed=5, report=True)
    counts = {r.perm_id: r.swaps for r in out.collect()}
    found = by_network(out)
    assert sorted(found) == [1, 2, 3] and min(counts.values()) >= share * len(edges)
    for rows in found.values():
        assert degrees(rows) == degrees(edges) and len(set(rows)) == len(edges) and whole(rows)
        assert all(a < b for a, b in rows) and len(set(rows) & set(edges)) < len(edges)
    assert len({tuple(sorted(rows)) for rows in found.values()}) == 3


def test_partitions_do_not_matter_and_large_networks_take_this_way(spark, monkeypatch):
    edges = [(f"n{a}", f"n{b}") for a, b in made_edges(40, 30, 2)]
    monkeypatch.setattr(network, "MOST_EDGES", 20)
    frames = [spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(edges[::-1], "src string, dst string").repartition(5, "dst")]
    one, other = (by_network(network.permuted(f, 2, 0.5, seed=1, first=4)) for f in frames)
    assert {p: sorted(r) for p, r in one.items()} == {p: sorted(r) for p, r in other.items()} and sorted(one) == [4, 5]


def test_any_swaps_of_a_round_can_be_undone(spark):
    """A round's swaps against a plain form, and undoing those of lost nodes until all are connected."""
    edges = made_edges(60, 20, 9)
    frame = spark.createDataFrame([(1, a, b) for a, b in edges], "perm_id bigint, src int, dst int")
    pairs = _made(_dealt(frame, len(edges), 3, 0), frame)
    rows = sorted(pairs.collect(), key=lambda r: (r.order, r.one))
    assert sorted(tuple(e) for r in rows for e in (r.one, r.two) if e) == edges
    asked = {}
    for r in rows:
        for e in (r.new_one, r.new_two):
            if e:
                asked.setdefault(tuple(e), r.one)
    for r in rows:
        free = r.new_one is not None and all(tuple(e) not in edges and asked[tuple(e)] == r.one for e in (r.new_one, r.new_two))
        assert r.made == free
    assert any(r.made for r in rows)
    lost = {r.node for r in _cut_off(_edges(pairs)).collect()}
    back = _undone(pairs, spark.createDataFrame([(1, v) for v in lost], "perm_id bigint, node int")) if lost else pairs
    for r in back.collect():
        assert not (r.made and lost & {*r.one, *r.two})
    after = [(r.src, r.dst) for r in _edges(back).collect()]
    assert degrees(after) == degrees(edges) and len(set(after)) == len(edges)


def test_odd_networks(spark, monkeypatch):
    monkeypatch.setattr(swaps, "IDLE", 3)
    make = lambda rows: spark.createDataFrame(rows, "src int, dst int")
    assert permuted_in_rounds(make([]), 2, 3).count() == 0
    assert by_network(permuted_in_rounds(make([(2, 1)]), 2, 3)) == {1: [(1, 2)], 2: [(1, 2)]}
    star = [(0, i) for i in range(1, 5)]  # nothing can be swapped
    out = permuted_in_rounds(make(star), 1, 1, report=True).collect()
    assert sorted((r.src, r.dst) for r in out) == star and {r.swaps for r in out} == {0}
    for bad in ([(1, 2), (3, 4)], [(1, 2), (2, 1)], [(1, 1), (1, 2)]):
        with pytest.raises(ValueError):
            permuted_in_rounds(make(bad), 1, 1)
