"""Networks of several components, as tables repeated with shifted keys have them."""

import os

import duckdb
import numpy as np
import pytest

from heatgraph.catalog import ORACLE_SQL, QUERIES
from heatgraph.functions import diffusion
from heatgraph.operators import network, permute, similarity

KEYS = {"c_custkey": 1_000, "s_suppkey": 100, "p_partkey": 1_000, "o_orderkey": 10_000, "o_custkey": 1_000, "l_orderkey": 10_000, "l_partkey": 1_000, "l_suppkey": 100}


@pytest.fixture(scope="module")
def twice(sf, tmp_path_factory):
    """The tables beside a copy of themselves with other keys."""
    folder, con = str(tmp_path_factory.mktemp("twice")), duckdb.connect()
    for name in ("customer", "supplier", "part", "orders", "lineitem"):
        columns = [r[0] for r in con.sql(f"describe select * from '{sf}/{name}.parquet'").fetchall()]
        shifted = ", ".join(f"{c} + {KEYS[c]} * i as {c}" if c in KEYS else c for c in columns)
        con.sql(f"copy (select {shifted} from '{sf}/{name}.parquet', range(2) r(i)) to '{folder}/{name}.parquet' (format parquet)")
    return folder


def like_sql(spark, folder, name):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.sql(f"create view {table.split('.')[0]} as select * from '{folder}/{table}'")
    got, want = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    norm = lambda r, columns: tuple(str(x + 0.0 if isinstance(x, float) else x) for _, x in sorted(zip(columns, r)))
    rows = sorted(norm(r, got.columns) for r in got.collect())
    assert rows == sorted(norm(r, want.columns) for r in want.fetchall()) and rows


@pytest.mark.parametrize("name", ["ppr_kernel", "similarity_classic", "ppr_at_least", "component_histogram", "hierarchy_clusters", "hierarchy_cut"])
def test_two_components_like_sql(spark, twice, name):
    like_sql(spark, twice, name)


def test_columns_by_component():
    """Blocks of small components together, of large ones by themselves; the iteration is the inverse."""
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (70, 2)).tolist() if p[0] != p[1]}
    src, dst = np.array(sorted(pairs)).T
    want = diffusion.restart_kernel(diffusion.adjacency(60, src, dst), 0.4)
    label = diffusion.array_components(60, src, dst)
    for block, cells in ((256, 10_000), (7, 300), (3, 20)):
        columns, found = diffusion.Columns(60, src, dst, block, cells), {}
        for i, (a, b, low, high) in enumerate(columns.blocks):
            assert (b - a) * (high - low) <= max(cells, b - a)
            at, seed, p = columns(i, 0.4)
            found |= {(columns.order[x], columns.order[y]): z for x, y, z in zip(at, seed, p)}
        assert found.keys() == {(i, j) for i in range(60) for j in range(60) if label[i] == label[j]}
        assert all(abs(want[k] - p) < 1e-12 for k, p in found.items())


def test_what_is_over_one_is_not_looked_for(spark):
    """Columns add up to 1, so a threshold above that asks for no network at all."""
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    broken = edges.selectExpr("raise_error('read') as src", "dst").selectExpr("cast(src as bigint) as src", "dst")
    assert network.restart_kernel(broken, 0.4, least=1.5).count() == 0
    assert network.restart_kernel(edges, 0.4, least=0.9).count() == 0 < network.restart_kernel(edges, 0.4, least=0.1).count()


def test_lesser_of_both_ways_by_degrees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 5), (7, 8)], "src bigint, dst bigint")
    heat = spark.createDataFrame([(i, i / 10) for i in range(1, 9)], "node bigint, score double")
    plain = {(r.src, r.dst): r.w for r in similarity.similarity(network.restart_kernel(edges, 0.4), heat, directed=False).collect()}
    lesser = {(r.src, r.dst): r.w for r in similarity.similarity(network.restart_kernel(edges, 0.4, lesser=True), heat, directed=False, lesser=True).collect()}
    assert plain.keys() == lesser.keys() and all(abs(plain[k] - w) < 1e-12 for k, w in lesser.items())
    half = network.restart_kernel(edges, 0.4, lesser=True, half=True).collect()
    assert {(r.src, r.dst) for r in half} == {(a, b) for a, b in plain if b <= a}


def test_sizes_are_counted_where_there_is_no_component(spark):
    members = spark.createDataFrame([], "component bigint, node bigint")
    assert sorted(map(tuple, similarity.at_least(members, [2, 3]).collect())) == [(2, 0), (3, 0)]


@pytest.mark.parametrize("directed", [True, False])
def test_counts_of_large_networks_by_all_tasks(spark, directed):
    """Networks that no task may hold have the counts that a task of each finds."""
    rng = np.random.default_rng(8)
    rows = [(perm, int(a), int(b)) for perm in (1, 2) for a, b in np.unique(np.sort(rng.integers(0, 30, (45, 2)), axis=1), axis=0) if a != b]
    networks = spark.createDataFrame(rows, "perm_id bigint, src bigint, dst bigint")
    heat = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.random(30)) if i % 6], "node bigint, score double")
    for delta in (0.03, 7.0):
        by_task, by_all = (sorted(map(tuple, similarity.counts_by_network(networks, heat, 0.4, delta, [1, 2, 4], directed, most=k).collect())) for k in (100, 0))
        assert by_task == by_all and any(n for *_, n in by_task) == (delta < 1)


def test_heat_of_permuted_mutations_draws_no_pairs(spark, monkeypatch):
    """As many samples as the probabilities ask for, with and without placed changes, without a row for each pair."""
    monkeypatch.setattr(permute, "sampled_snvs", None)
    order = spark.range(200).selectExpr("id as gene", "'c' as chromo", "id as pos")
    genes = order.selectExpr("gene", "gene % 4 * 100 as length")
    people = spark.range(5_000).withColumnRenamed("id", "sample")
    blocks = spark.createDataFrame([(s, "c", 0, "amp", 0, 100) for s in range(6_000) if s % 3 == 0], "sample bigint, chromo string, block bigint, mut_type string, start bigint, n bigint")
    heat = permute.permuted_mutation_heat(people, genes, blocks, order, 0.005, perms=2)
    changed = {(r.perm_id, r.node): r.score for r in permute.permuted_mutation_heat(people, genes, blocks, order, 0.0, perms=2).collect()}
    sums = {}
    for r in heat.collect():
        p, c = 1 - 0.995 ** (r.node % 4 * 100), changed[r.perm_id, r.node]
        inside = 1 - c * 5 / 6  # of all changed samples a sixth isn't among the people
        sums.setdefault(r.node % 4, []).append((r.score - c, inside * p, inside * p * (1 - p) / 5_000))
        assert abs(r.score * 5_000 - round(r.score * 5_000)) < 1e-6
    for found in sums.values():
        got, mean, spread = (sum(x[i] for x in found) for i in range(3))
        assert abs(got - mean) <= 0.02 * mean + 6 * spread**0.5
    assert sum(x[0] for x in sums[0]) == 0


def test_counts_of_draws_are_those_of_their_rows(spark):
    people = spark.range(50).withColumnRenamed("id", "sample")
    genes = spark.range(300).selectExpr("id as gene", "id % 5 * 40 + 1 as length")
    rows = permute.sampled_snvs(people, genes, 0.01, perms=2).groupBy("perm_id", "gene").count()
    assert sorted(map(tuple, permute.sampled_snv_counts(people, genes, 0.01, perms=2).collect())) == sorted(map(tuple, rows.collect()))
    rng = np.random.default_rng(1)
    drawn = [permute._successes(50, p, rng) for p in [0.5] * 2_000 + [1.0]]
    assert abs(sum(map(len, drawn[:-1])) - 50_000) < 1_000 and len(drawn[-1]) == 50
    assert all((np.diff(x) > 0).all() and (not len(x) or 0 <= x[0] <= x[-1] < 50) for x in drawn)
    assert abs(sum(0 in x for x in drawn[:-1]) - 1_000) < 140 and abs(sum(49 in x for x in drawn[:-1]) - 1_000) < 140


def test_hierarchies_of_the_edges_that_bind(spark):
    """No cluster and no weight is another one without the edges below the bound; where a node has no score there is no bound."""
    from heatgraph.operators import tree

    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (70, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(39)} | {(50, 51), (51, 52)}
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    heat = spark.createDataFrame([(i, float(0.5 + rng.random())) for i in range(60)], "node bigint, score double")
    every = similarity.similarity(network.restart_kernel(edges, 0.4, places=6), heat).selectExpr("if(src < 50, 0L, 50L) as part", "src", "dst", "w")
    some = tree.binding(edges, heat, 0.4)
    assert some.count() < every.count() / 2 and not some.exceptAll(every).count()
    trees = [sorted(map(str, tree.tree(x, key="part").where("size(members) > 1").select("part", "weight", "members").collect())) for x in (every, some)]
    assert trees[0] == trees[1] and len(trees[0]) > 20
    partitions = tree.all_clusters(tree.tree(some.where("part = 0"), key="part"), key="part").groupBy("delta").count()
    held = tree.held_at(tree.spans(some.where("part = 0").selectExpr("'a' as network", "*"))).select("delta", "held")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, partitions.collect()))
    assert tree.binding(edges, heat.where("node <> 7"), 0.4) is None


def test_weights_are_counted_by_column(spark):
    """Equal entries of a column count together, as often as their cells are there; the cut leaves enough of the heaviest."""
    from pyspark.sql import functions as F

    from heatgraph.operators import levels

    kernel = spark.createDataFrame([(i, j, (i + j) % 3 / 10) for i in range(9) for j in range(9)], "dst bigint, src bigint, p double")
    heats = spark.createDataFrame([(k, i, float((i + k) % 4)) for k in (1, 2) for i in range(7)], "perm_id bigint, node bigint, score double")
    plain = levels.cells(kernel, heats, True).groupBy("perm_id", "w").count()
    found = levels._times(kernel, heats, True)
    assert sorted(map(tuple, found.groupBy("perm_id", "w").agg(F.sum("times")).collect())) == sorted(map(tuple, plain.collect()))
    low = {r.perm_id: r.low for r in levels._low(found.where("w > 0"), 0.2).collect()}
    over = {k: [r["count"] for r in plain.collect() if r.perm_id == k and r.w > 0 and r.w >= low[k]] for k in (1, 2)}
    total = {k: sum(r["count"] for r in plain.collect() if r.perm_id == k and r.w > 0) for k in (1, 2)}
    assert all(0.2 * total[k] <= sum(over[k]) < total[k] for k in (1, 2))
