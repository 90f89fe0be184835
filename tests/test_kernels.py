import itertools
import random

import numpy as np
import pytest

from heatgraph.functions import diffusion, graph, hierarchy, simulate, thresholds


def reach(n, src, dst):
    r = np.eye(n, dtype=bool)
    r[src, dst] = True
    for k in range(n):
        r |= r[:, [k]] & r[[k], :]
    return r


def same_partition(a, b):
    return all((a[i] == a[j]) == (b[i] == b[j]) for i, j in itertools.combinations(range(len(a)), 2))


def test_components_like_mutual_reachability():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        m = int(rng.integers(0, 30))
        src, dst = rng.integers(0, n, m), rng.integers(0, n, m)
        r = reach(n, src, dst)
        want = [int(np.nonzero(r[i] & r[:, i])[0][0]) for i in range(n)]
        assert same_partition(graph.strong_components(n, src, dst), want)
        both = reach(n, np.concatenate([src, dst]), np.concatenate([dst, src]))
        assert same_partition(graph.components(n, src, dst), [int(np.nonzero(both[i])[0][0]) for i in range(n)])
    long = np.arange(50_000)
    assert len(set(graph.strong_components(50_001, long, long + 1).tolist())) == 50_001  # no recursion


def test_groups_and_sizes():
    w = np.array([[1.0, 0.5, 0], [0.5, 1.0, 0], [0, 0, 0.1]])
    label, touched = graph.threshold_components(w, 0.5)
    assert graph.groups(label, ["c", "b", "a"], touched) == [["b", "c"]]
    assert sorted(graph.sizes_at(w, 0.1)) == [1, 2] and len(graph.sizes_at(w, 2.0)) == 0


def test_swaps_keep_degrees_and_connection():
    rng = np.random.default_rng(2)
    edges = np.array([(i, i + 1) for i in range(29)] + [(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in rng.integers(0, 30, (25, 2)).tolist()} if b > a + 1])
    made, done = graph.swapped(edges, 30, 400, rng)
    assert done == 400
    assert (np.bincount(made.ravel()) == np.bincount(edges.ravel())).all()
    assert len({tuple(e) for e in made.tolist()}) == len(edges) and (made[:, 0] < made[:, 1]).all()
    assert len(set(graph.components(30, *made.T).tolist())) == 1
    assert {tuple(e) for e in made.tolist()} != {tuple(e) for e in edges.tolist()}
    star = np.array([(0, i) for i in range(1, 6)])
    made, done = graph.swapped(star, 6, 10, rng)
    assert done == 0 and made.tolist() == star.tolist()


def ring(n=12, chords=((0, 5), (3, 9))):
    pairs = [(i, (i + 1) % n) for i in range(n)] + list(chords)
    return np.array(pairs).T


def test_restart_kernel_forms_agree():
    src, dst = ring()
    a = diffusion.adjacency(12, src, dst)
    p = diffusion.restart_kernel(a, 0.4)
    assert np.allclose(p.sum(axis=0), 1)
    assert np.allclose(p, diffusion.restart_columns(12, src, dst, 0.4, np.arange(12)), atol=1e-10)


def test_heat_kernel():
    a = diffusion.adjacency(12, *ring())
    lap = np.diag(a.sum(axis=0)) - a
    series, term = np.eye(12), np.eye(12)
    for i in range(1, 60):
        term = term @ (-0.3 * lap) / i
        series += term
    assert np.allclose(diffusion.heat_kernel(a, 0.3), series)


def test_root_and_balance():
    assert abs(diffusion.ridder(lambda x: x**3 - 2, 0, 2, 1e-9) - 2 ** (1 / 3)) < 1e-8
    with pytest.raises(ValueError):
        diffusion.ridder(lambda x: x * x + 1, 0, 1, 1e-3)
    src, dst = ring()
    beta = diffusion.balanced_beta(12, src, dst, 4)
    assert abs(diffusion.balance(diffusion.adjacency(12, src, dst), beta)) < 0.01


def naive_tree_partition(names, w, delta):
    src, dst = np.nonzero((w != 0) & (w >= delta))
    label = graph.strong_components(len(names), src, dst)
    return sorted(graph.groups(label, names))


def test_hierarchy_cuts_like_components():
    rng = np.random.default_rng(3)
    for trial in range(25):
        n = int(rng.integers(2, 12))
        w = rng.integers(1, 9 if trial % 2 else 1000, (n, n)) / 10.0
        names = [f"v{i:02}" for i in range(n)]
        tree = hierarchy.decompose(names, w)
        for delta, parts in hierarchy.partitions(tree)[1:]:
            assert sorted(parts) == naive_tree_partition(names, w, delta)
        levels = {d for d, _ in hierarchy.partitions(tree)}
        for delta in set(w.ravel().tolist()) - levels:
            assert sorted(hierarchy.cut_at(tree, delta)) == naive_tree_partition(names, w, delta)
        up = hierarchy.decompose(names, w, increasing=True)
        for delta, parts in hierarchy.partitions(up)[1:]:
            src, dst = np.nonzero(w <= delta)
            assert sorted(parts) == sorted(graph.groups(graph.strong_components(n, src, dst), names))


def test_hierarchy_output():
    w = np.array([[0, 4, 0, 1], [4, 0, 0, 0], [0, 0, 0, 3], [1.0, 2, 3, 0]])
    tree = hierarchy.decompose(list("abcd"), w)
    assert hierarchy.cut_at(tree, 3) == [["a", "b"], ["c", "d"]] and hierarchy.cut_at(tree, 1) == [["a", "b", "c", "d"]]
    rows, labels = hierarchy.linkage(tree)
    assert sorted(labels) == list("abcd") and [r[3] for r in rows] == [2, 2, 4] and [r[2] for r in rows] == [0.0, 1.0, 3.0]
    text = hierarchy.newick(tree)
    assert text.endswith(";") and text.count("(") == text.count(")") == 3
    assert hierarchy.first_cut(tree, False, 2, 2) == ([["a", "b"], ["c", "d"]], 3.0)
    assert hierarchy.first_cut(tree, True, 4, 3)[1] == 1.0
    assert hierarchy.decompose(list("xyz"), np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0.0]])).names == ["x", "y"]
    with pytest.raises(ValueError):
        hierarchy.uncrossed([[0, 1, 2.0, 2], [2, 3, 1.0, 3]], list("abc"))


def test_threshold_walk_like_plain_steps():
    rng = np.random.default_rng(4)
    for _ in range(20):
        w = rng.random((12, 12)).round(2)
        levels = sorted(set(w.ravel().tolist()))
        for size in (2, 4, 8):
            low, high, index, seen = 0.0, float(len(levels)), float(thresholds.rounded(0.99 * len(levels))), []
            while True:
                d = levels[min(int(index), len(levels) - 1)]
                if d in seen:
                    break
                seen.append(d)
                if max(graph.sizes_at(w, d)) < size:
                    high = index
                    index -= thresholds.rounded((index - low) / 2)
                else:
                    low = index
                    index += thresholds.rounded((high - index) / 2)
            assert thresholds.by_largest_component(w, [size])[size] == d
    assert [thresholds.rounded(x) for x in (0.5, 1.5, 2.5, 2.4)] == [1, 2, 3, 2]


def test_component_count_like_recount():
    rng = random.Random(5)
    for _ in range(15):
        n = 9
        w = np.array([[rng.randint(1, 60) / 60 for _ in range(n)] for _ in range(n)])
        w = np.minimum(w, w.T)
        edges = thresholds.top_edges(w, 0.6)
        assert all(a <= b for a, b, _ in edges) and len(edges) == int(0.6 * (n * (n + 1) // 2))
        for k in (2, 3):
            best, most = [edges[0][2]], 0
            for i in range(1, len(edges) + 1):
                label = graph.components(n, [e[0] for e in edges[:i]], [e[1] for e in edges[:i]])
                count = int((np.bincount(label) >= k).sum())
                if count > most:
                    best, most = [edges[i - 1][2]], count
                elif count == most:
                    best.append(edges[i - 1][2])
            assert thresholds.by_component_count(w, [k], 0.6)[k] == np.median(best)
    with pytest.raises(ValueError):
        thresholds.by_component_count(np.ones((3, 3)), [1])


def test_union_find():
    sets = graph.UnionFind(5)
    assert sets.union(0, 1) and sets.union(1, 2) and sets.union(0, 2) is None
    assert sets.size[sets.find(2)] == 3 and sets.find(3) == 3


def test_all_blocks_of_all_samples_are_permuted(spark):
    from heatgraph.operators import permute
    from heatgraph.queries import network as queries

    for sf, apart in (("sf0.01", True), ("sf0.001", False)):
        blocks, order = queries._blocks(spark, f"/root/testdata/{sf}"), queries._order(spark, f"/root/testdata/{sf}")
        ends = {r.chromo: r.n for r in order.groupBy("chromo").count().withColumnRenamed("count", "n").collect()}
        want = sorted((r.sample, r.chromo, r.block, r.mut_type, r.n) for r in blocks.collect())
        placed = permute.permuted_blocks(blocks, order, 1, crowded=not apart).collect()
        assert sorted((r.sample, r.chromo, r.block, r.mut_type, r.n) for r in placed) == want
        assert all(1 <= r.start and r.start + r.n - 1 <= ends[r.chromo] for r in placed)
        held = {}
        for r in sorted(placed, key=lambda r: r.start):
            held.setdefault((r.sample, r.chromo), []).append((r.start, r.n))
        for (_, chromo), own in held.items():
            if sum(n + 1 for _, n in own) - 1 <= ends[chromo]:
                assert all(b > a + n for (a, n), (b, _) in zip(own, own[1:]))


def test_mutation_permutation_heat_of_all_samples(spark, sf):
    """Mutated genes of all samples: without variants the heat adds up to the genes of the placed blocks."""
    from pyspark.sql import functions as F

    from heatgraph.operators import permute
    from heatgraph.queries import network as queries

    blocks, order = queries._blocks(spark, sf), queries._order(spark, sf)
    n = blocks.select("sample").distinct().count()
    genes, people = order.select("gene", F.lit(1).alias("length")), blocks.select("sample").distinct()
    heat = permute.permuted_mutation_heat(people, genes, blocks, order, 0.0, perms=1, crowded=True)
    placed = permute.permuted_blocks(blocks, order, 1, crowded=True)
    want = permute.block_genes(placed, order).select("sample", "gene").distinct().count()
    assert n == 10 and abs(heat.agg(F.sum("score")).first()[0] * n - want) < 1e-6
    scores = {round(r.score * 10, 9) for r in queries.mutation_permutation_heat(spark, sf).collect()}
    assert scores <= set(map(float, range(11))) and len(scores) > 2


def test_blocks_that_only_just_fit(spark):
    """One after the other blocks may leave no room; all together they fit."""
    from heatgraph.operators import permute

    order = spark.createDataFrame([(i, "c", i) for i in range(1, 12)], "gene int, chromo string, pos int")
    blocks = spark.createDataFrame([(s, "c", b, "amp", 0, 3) for s in range(40) for b in range(3)], "sample int, chromo string, block bigint, mut_type string, start int, n bigint")
    placed = permute.permuted_blocks(blocks, order).collect()
    assert sorted((r.sample, r.start) for r in placed) == [(s, at) for s in range(40) for at in (1, 5, 9)]


def test_simulated_study():
    networks, heats, planted = simulate.simulated_study()
    assert (networks, heats, planted) == simulate.simulated_study() and networks != simulate.simulated_study(seed=1)[0]
    assert [len(h) for h in heats] == [230, 240] and [len(p) for p in planted] == [5] * 5 + [10] * 5
    members = [v for p in planted for v in p]
    assert len(members) == len(set(members))
    for edges, size in zip(networks, (225, 235, 245)):
        inside = {v for e in edges for v in e}
        assert 750 < len(edges) and len(inside) <= size and all(u < v for u, v in edges) and len(set(edges)) == len(edges)
        for p in planted:  # what the sample holds of a clique is a clique
            held = sorted(set(p) & inside)
            assert {(u, v) for i, u in enumerate(held) for v in held[i + 1 :]} <= set(edges)
    for h in heats:
        assert min(h[v] for v in members if v in h) >= max(s for v, s in h.items() if v not in members)
    with pytest.raises(ValueError):
        simulate.simulated_study(20, 10)
    grown = simulate.preferential_attachment(40, 3, np.random.default_rng(0))
    assert len(grown) == 37 * 3 and all(u < v for u, v in grown)


def test_random_weights():
    w = simulate.random_weights(60, 0.5, 4, seed=3)
    assert (np.diag(w) == 0).all() and set(np.unique(w).tolist()) == {0.0, 0.25, 0.5, 0.75, 1.0} and 0.4 < (w == 0).mean() < 0.6
    assert np.array_equal(w, simulate.random_weights(60, 0.5, 4, seed=3))


def test_kernels_are_not_taken_for_small(spark):
    """A kernel's size is unknown to the planner, so that it is never broadcast beside heat."""
    from heatgraph.operators import network, similarity

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src bigint, dst bigint")
    heat = spark.createDataFrame([(i, 0.1 * i) for i in range(10)], "node bigint, score double")
    kernel = network.restart_kernel(edges, 0.4)
    for table in (kernel, network.heat_kernel(edges, 0.05)):
        assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40
    assert similarity.similarity(kernel, heat).count() == 100


def test_top_edges_beyond_a_limit(spark):
    """Ranks, ties and null weights, whatever the share; no single task holds the share."""
    from heatgraph.operators import delta

    rows = [(i, j, None if i == j else float((i * j) % 5)) for i in range(12) for j in range(12)]
    sim = spark.createDataFrame(rows, "src int, dst int, w double")
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0], r[1]))
    for share in (0.0, 0.05, 0.5, 1.0):
        found = delta.top_edges(sim, share)
        assert sorted(map(tuple, found.select("src", "dst").collect())) == sorted(r[:2] for r in order[: int(share * len(rows))])
        assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()


def test_array_components_and_rounds_of_swaps():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 400):
        ends = rng.integers(0, n, (2, n // 2 + 1))
        assert same_partition(graph.array_components(n, *ends).tolist(), graph.components(n, *ends).tolist())
    ring = np.array([(i, (i + 1) % 3000) for i in range(3000)] + [(i, (i + 1500) % 3000) for i in range(1500)])
    made, done = graph.swapped(ring, 3000, 115 * len(ring), rng)  # half a million swaps: minutes one at a time
    assert done == 115 * len(ring) and (np.bincount(made.ravel()) == 3).all()
    assert len(np.unique(made, axis=0)) == len(ring) and not graph.array_components(3000, *made.T).any()


def test_trees_need_only_edges_that_join(spark):
    from heatgraph.operators import tree

    rng = np.random.default_rng(8)
    w = np.round(rng.random((20, 20)) ** 3, 3)
    rows = [("a", i, j, float(w[i, j])) for i in range(20) for j in range(20)] + [("b", i, j, float(w[i, j] + 0.5)) for i in range(9) for j in range(9)]
    every = spark.createDataFrame(rows, "network string, src int, dst int, w double")
    part = tree.needed(every)
    assert part.count() < every.count() / 2
    rest = spark.createDataFrame([r for r in rows if r[1] < r[2]], every.schema)  # nothing is strongly connected: all edges come back
    for whole, some in ((every, part), (rest, tree.needed(rest))):
        assert sorted(map(tuple, tree.tree(whole).collect())) == sorted(map(tuple, tree.tree(some).collect()))
        assert sorted(map(tuple, tree.drawings(whole).select("newick").collect())) == sorted(map(tuple, tree.drawings(some).select("newick").collect()))


def test_work_is_dealt_by_rows(spark, sf):
    """Queries whose small tables mean much work, and iterations that shuffle nothing."""
    from heatgraph.operators import network
    from heatgraph.queries import data, network as queries

    assert queries.snv_permutation(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    lines, held = data.table(spark, sf, "lineitem"), data.LINES
    data.LINES = 100
    try:
        assert data.tasks(lines) == 1 + lines.count() // 100
        assert data.net(spark, sf).exceptAll(spark.createDataFrame([], "src bigint, dst bigint")).count() > 0
    finally:
        data.LINES = held
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src bigint, dst bigint")
    plan = network.restart_iteration(edges, network.both_ways(edges).select(edges["src"].alias("node")).distinct(), 0.4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_balance_by_traces_is_that_of_the_whole_kernel(spark, monkeypatch):
    from heatgraph.operators import network

    monkeypatch.setattr(network, "CELLS", 40)  # several blocks
    ends = [(i, i % 20 + 1) for i in range(1, 21)] + [(1, 7), (4, 15), (8, 8), (2, 1), (23, 22)]  # a loop, a repeated edge, an id without edges
    src, dst = (np.array(x) - 1 for x in zip(*ends))
    a = diffusion.adjacency(23, src, dst)
    walk = diffusion.Walk(23, *np.nonzero(np.triu(a)))
    series = diffusion.balanced_series(walk, *walk.traces(np.arange(23), 1e-3), 3)
    assert abs(series - diffusion.balanced_beta(23, src, dst, 3)) < 1e-9
    found = network.balanced_beta(spark.createDataFrame(ends, "src bigint, dst bigint"), 3).first()["beta"]
    assert abs(found - series) < 1e-9
    assert not network.restart_kernel(spark.createDataFrame(ends, "src bigint, dst bigint"), 0.4).where("p is null").count()


def test_blocks_of_kernel_columns_do_not_grow_with_the_network():
    from heatgraph.operators import network

    for n in (10, 10_000, 60_000, 5_000_000):
        assert network._block(n, 256) * n <= max(network.CELLS, n) and 1 <= network._block(n, 256) <= 256
    assert network._values([1, 2]).dtype == np.int64 and network._values(["a", "b"]).dtype == object


def test_sums_over_neighbours_with_hubs_and_vertices_without_any():
    u, v = np.array([0, 1, 2, 3, 0]), np.array([4, 4, 4, 4, 2])
    step = diffusion.Steps(7, u, v)
    x = np.arange(14.0).reshape(7, 2)
    plain = np.zeros((7, 2))
    np.add.at(plain, v, x[u])
    assert np.array_equal(step(x[step.order])[step.place], plain)


def test_draws_of_many_samples_come_in_pieces(spark, monkeypatch):
    from heatgraph.operators import permute

    frames = type(spark.range(1))
    people = spark.range(40).withColumnRenamed("id", "sample")
    genes = spark.range(300).selectExpr("id as gene", "id % 5 + 1 as length")
    whole = sorted(map(tuple, permute.sampled_snvs(people, genes, 0.2, perms=2).collect()))
    pieces, plain = [], frames.mapInPandas

    def watched(frame, run, schema):
        pieces.extend(len(x) for x in run(iter([frame.toPandas()])))
        return plain(frame, run, schema)

    monkeypatch.setattr(permute, "DRAWS", 50)
    monkeypatch.setattr(frames, "mapInPandas", watched)
    assert sorted(map(tuple, permute.sampled_snvs(people, genes, 0.2, perms=2).collect())) == whole
    assert len(pieces) > 50 and max(pieces) < 50 + 300


def test_thresholded_similarity_takes_only_entries_that_reach(spark, sf):
    from heatgraph.operators.similarity import similarity
    from heatgraph.queries import data

    own = data.heat(spark, sf)
    least = data.reaching(own, data.DELTA)
    few, every = data.kernel(spark, sf, least), data.kernel(spark, sf)
    want = {tuple(r) for r in similarity(every, own, delta=data.DELTA).collect()}
    assert few.where(f"p < {least} - 1e-6").isEmpty() and few.count() < every.count()
    assert want and {tuple(r) for r in data.sim(spark, sf, data.DELTA).collect()} == want
