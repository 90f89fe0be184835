"""Permutation tests, consensus and files of whole runs."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatgraph import cli
from heatgraph.functions import diffusion, graph
from heatgraph.operators import consensus, delta, network, permute, similarity, view
from heatgraph.plans import runs
from heatgraph.sources import sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line int")


def test_white_space_at_line_ends(spark):
    assert sorted(tuple(r)[:2] for r in text.snvs(lines(spark, "s1\tg1\t", "s2\tg1\tg2 \t ")).collect()) == [("s1", "g1"), ("s2", "g1"), ("s2", "g2")]
    assert [tuple(r)[:3] for r in text.cnas(lines(spark, "s1\tg1(A)\t\t")).collect()] == [("s1", "g1", "amp")]
    assert [tuple(r) for r in text.significance_scores(lines(spark, "g\t1\t0.5\t0.25\t")).collect()] == [("g", 0.5, 0.25)]


def plain_counts(edges, sizes):
    """Strong components of at least each size, among the nodes of the edges."""
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    label = graph.strong_components(len(names), [place[a] for a, _ in edges], [place[b] for _, b in edges]) if names else []
    held = {}
    for x in list(label):
        held[int(x)] = held.get(int(x), 0) + 1
    return [sum(n >= k for n in held.values()) for k in sizes]


@pytest.mark.parametrize("directed", [True, False])
def test_permutation_counts_of_a_large_network(spark, directed):
    """14,398 nodes, three permutations, two thresholds in one pass."""
    rng, n = random.Random(2), 14_398
    p = {(rng.randrange(n), rng.randrange(n)): round(rng.random(), 3) for _ in range(40_000)}
    p |= {(b, a): round(rng.random(), 3) for a, b in list(p)[:20_000]}
    heats = {k: {x: round(rng.random() * 3, 3) for x in range(n) if rng.random() < 0.9} for k in (1, 2, 3)}
    kernel = spark.createDataFrame([(b, a, v) for (a, b), v in p.items()], "dst int, src int, p double")
    frame = spark.createDataFrame([(k, x, s) for k, h in heats.items() for x, s in h.items()], "perm_id bigint, node int, score double")
    levels, sizes = [0.9, 1.7], [2, 3, 5]
    got = {(r.perm_id, r.delta, r["size"]): r.n for r in similarity.counts_at_levels(kernel, frame, levels, sizes, directed).collect()}
    want = {}
    for k, h in heats.items():
        for d in levels:
            if directed:
                edges = [(a, b) for (a, b), v in p.items() if a in h and b in h and v * h[a] >= d]
            else:
                edges = [(a, b) for (a, b), v in p.items() if a in h and b in h and (b, a) in p and min(v, p[b, a]) * max(h[a], h[b]) >= d]
            want |= {(k, d, s): c for s, c in zip(sizes, plain_counts(edges, sizes))}
    assert got == want and any(got.values())
    one = similarity.counts_by_permutation(kernel, frame, 0.9, sizes, directed).collect()
    assert {(r.perm_id, r["size"]): r.n for r in one} == {(k, s): c for (k, d, s), c in want.items() if d == 0.9}


def test_thresholds_above_zero_only(spark):
    kernel = spark.createDataFrame([(i, i, 1.0) for i in range(9)], "dst int, src int, p double")
    with pytest.raises(ValueError):
        similarity.counts_by_permutation(kernel, kernel, 0.0, [2])


def test_permuted_changes_are_filtered(spark):
    rows = [(1, "a", "g", "amp"), (1, "b", "g", "amp"), (1, "c", "g", "amp"), (1, "d", "g", "del"), (2, "a", "g", "amp"), (2, "b", "g", "del"), (1, "a", "h", "del")]
    frame = spark.createDataFrame(rows, "perm_id bigint, sample string, gene string, mut_type string")
    assert sorted(tuple(r) for r in permute.prevailing(frame, 0.75).collect()) == sorted([rows[0], rows[1], rows[2], rows[6]])
    with pytest.raises(ValueError):
        permute.prevailing(frame, 0.5)


def test_mutation_permutations_with_rates_and_network(spark):
    genes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "gene string, length int")
    people = spark.range(5).select(F.col("id").alias("sample"))
    order = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "x", 2), ("d", "x", 3)], "gene string, chromo string, pos int")
    blocks = spark.createDataFrame([(s, "x", 1, "amp" if s < 4 else "del", 0, 4) for s in range(5)], "sample bigint, chromo string, block bigint, mut_type string, start int, n bigint")
    rates = spark.createDataFrame([("a", 1.0)], "gene string, bmr double")
    network = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    score = lambda **more: {r.node: r.score for r in permute.permuted_mutation_heat(people, genes, blocks, order, 0.0, **more).collect()}
    assert score() == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}
    assert score(network=network, cna_threshold=0.7) == {"a": 0.8, "b": 0.8}
    assert score(network=network, cna_threshold=0.9, rates=rates) == {"a": 1.0, "b": 0.0}
    kernel = spark.createDataFrame([(x, y, 0.5 if x != y else 0.6) for x in "abz" for y in "abz"], "dst string, src string, p double")
    found = delta.by_mutations(kernel, "mutation", people, genes, blocks, order, 0.0, [2], perms=2).collect()
    assert sorted(r.perm_id for r in found) == [1, 2] and all(r.delta in (0.5, 0.6) for r in found)
    with pytest.raises(ValueError):
        delta.by_mutations(kernel, "scores", people, genes, blocks, order, 0.0, [2])


def test_heat_is_dealt_inside_the_network(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    heat = spark.createDataFrame([(i, float(i) if i > 4 else 0.0) for i in range(1, 8)] + [(50, 9.0), (51, 0.0)], "node int, score double")
    seen = set()
    for seed in range(4):
        got = {r.node: r.score for r in runs.dealt_heat(edges, heat, seed).collect()}
        assert got.keys() == set(range(1, 8)) and sorted(got.values()) == [0.0] * 4 + [5.0, 6.0, 7.0]
        seen.add(tuple(sorted(got.items())))
    assert len(seen) > 1


def test_consensus_of_stored_runs(spark, tmp_path):
    for name, groups in (("n1", [["a", "b", "c"], ["x", "y"]]), ("n2", [["a", "b", "d"], ["x", "y"]])):
        folder = tmp_path / "runs" / f"{name}-h" / "delta_0.5"
        folder.mkdir(parents=True)
        found = {"components": groups, "statistics": {"2": {"observed": 2, "expected": 0.1, "pval": 0.0}}, "parameters": {"network_name": name, "heat_name": "h"}}
        (folder / "results.json").write_text(json.dumps(found, indent=1))
    cli.run(spark, ["consensus", "--directory", str(tmp_path / "runs"), "--output", str(tmp_path / "out.json")])
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["deltas"] == {"n1-h": 0.5, "n2-h": 0.5} and out["linkers"] == []
    assert out["consensus"] == [{"core": ["a", "b"], "expansion": ["c", "d"]}, {"core": ["x", "y"], "expansion": []}]
    cli.run(spark, ["consensus", "--directory", str(tmp_path / "runs"), "--output", str(tmp_path / "out.tsv")])
    assert (tmp_path / "out.tsv").read_text() == "# Linkers: \n# Core\tExpansion\na, b\tc, d\nx, y\t\n"


def test_network_keeps_nodes_without_edges(spark):
    nodes, edges = text.network(lines(spark, "1 2"), lines(spark, "1 a", "2 b", "3 c"))
    assert sorted(r.node for r in nodes.collect()) == ["a", "b", "c"] and [tuple(r) for r in edges.collect()] == [("a", "b")]


def test_mutations_of_a_heat_document(spark, tmp_path):
    (tmp_path / "snv").write_text("s1\tg1\tg2\ns2\tg1\n")
    (tmp_path / "cna").write_text("s1\tg3(A)\t\n")
    cli.run(spark, ["heat-mutation", "--snvs", str(tmp_path / "snv"), "--cnas", str(tmp_path / "cna"), "--output", str(tmp_path / "heat.json")])
    every, types = text.heat_mutations(spark, str(tmp_path / "heat.json"))
    assert sorted(tuple(r)[:3] for r in every.collect()) == [("s1", "g1", "snv"), ("s1", "g2", "snv"), ("s1", "g3", "amp"), ("s2", "g1", "snv")]
    assert sorted(tuple(r) for r in types.collect()) == [("s1", "Cancer"), ("s2", "Cancer")]
    (tmp_path / "plain.json").write_text('{"heat": {"a": 1.0}, "parameters": {"name": "p"}}')
    assert text.heat_mutations(spark, str(tmp_path / "plain.json")) is None


def test_pages_with_mutations(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b")], "component int, node string")
    heat = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "node string, score double")
    shown = spark.createDataFrame([("a", 7.0)], "node string, score double")
    mutations = spark.createDataFrame([("s1", "a", "snv", True), ("s2", "z", "snv", True), ("s1", "b", "amp", False)], "sample string, gene string, mut_type string, valid boolean")
    page = json.loads(view.document(members, heat, spark.createDataFrame([("a", "b")], "src string, dst string"), display=shown, mutations=mutations, n_samples=4).first().json)
    assert page["coverage"] == "1 (25.00%)" and page["edges"] == [{"source": "a", "target": "b"}]
    assert page["nodes"][0] == {"name": "a", "value": 7.0} and page["nodes"][1]["name"] == "b" and page["nodes"][1]["value"] in ("NaN", None)
    types = spark.createDataFrame([("s1", "Cancer")], "sample string, type string")
    assert json.loads(view.mutation_document(mutations, members, types)) == {"geneToMutations": {"a": {"s1": ["snv"]}, "b": {"s1": ["amp"]}}, "sampleToType": {"s1": "Cancer"}}


def test_permuted_networks_do_not_depend_on_partitions(spark):
    pairs = [(i, (i + k) % 40) for i in range(40) for k in (1, 3)]
    edges = network.canonical(spark.createDataFrame(pairs, "src int, dst int")).cache()
    seen = {tuple(sorted(tuple(r) for r in network.permuted(e, 2, 5, seed=3).collect())) for e in (edges, edges.orderBy("dst").coalesce(1), edges.repartition(7, "dst"))}
    assert len(seen) == 1


def test_consensus_of_several_directories_and_of_files(spark, tmp_path):
    files = []
    for place, name, groups in (("one", "n1", [["a", "b", "c"]]), ("two", "n2", [["a", "b", "d"]])):
        folder = tmp_path / place / f"{name}-h" / "delta_0.5"
        folder.mkdir(parents=True)
        files.append(str(folder / "results.json"))
        (folder / "results.json").write_text(json.dumps({"components": groups, "statistics": {"2": {"observed": 2, "expected": 0.1, "pval": 0.0}}, "parameters": {"network_name": name, "heat_name": "h"}}))
    for i, given in enumerate((["--directory", str(tmp_path / "one"), str(tmp_path / "two")], ["--files", *files])):
        cli.run(spark, ["consensus", *given, "--output", f"file:{tmp_path}/out{i}.json"])
        assert json.loads((tmp_path / f"out{i}.json").read_text())["consensus"] == [{"core": ["a", "b"], "expansion": ["c", "d"]}]
    assert not [f for f in tmp_path.iterdir() if "draft" in f.name or f.name.endswith(".crc")]


def test_consensus_of_classes_is_that_of_pairs(spark):
    import random

    rng = random.Random(9)
    for seed in range(4):
        rows = [(f"n{k}", h, rng.randrange(4), f"g{i:02}") for k in range(3) for h in ("a", "b") for i in range(22) if rng.random() < 0.8]
        members = spark.createDataFrame(rows, "network string, heat string, component int, node string")
        edges = consensus.consensus_edges(members)
        want = sorted(map(str, consensus.roles(edges, consensus.cores(edges, 3)).collect()))
        like, classes = consensus.node_classes(members)
        between = consensus.class_edges(classes)
        got = consensus.of_nodes(consensus.roles(between, consensus.cores(between, 3)), like).collect()
        assert sorted(map(str, got)) == want
        pairs = sum(1 for _ in classes.collect())
        assert pairs <= 22


def test_kernels_of_entries_that_matter(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 60, (110, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(59)})
    edges = spark.createDataFrame(pairs, "src int, dst int")
    full = {(r.dst, r.src): r.p for r in network.restart_kernel(edges, 0.4).collect()}
    some = {(r.dst, r.src): r.p for r in network.restart_kernel(edges, 0.4, block=7, least=0.01).collect()}
    assert some.keys() == {k for k, p in full.items() if p >= 0.01} and all(abs(full[k] - p) < 1e-12 for k, p in some.items())
    pushed = {(r.dst, r.src): r.p for r in network.restart_kernel(edges, 0.4, block=7, least=0.01, within=1e-6).collect()}
    assert some.keys() <= pushed.keys() and all(-1e-12 <= full[k] - p <= 1e-6 for k, p in pushed.items()) and all(full[k] >= 0.01 - 1e-6 for k in pushed)
    hot = {(r.dst, r.src): r.p for r in network.heat_kernel(edges, 0.3, block=9).collect()}
    n, (a, b) = 60, np.array(pairs).T
    dense = diffusion.heat_kernel(diffusion.adjacency(n, a, b), 0.3)
    assert len(hot) == n * n and all(abs(dense[k] - p) < 1e-12 for k, p in hot.items())


@pytest.mark.parametrize("directed", [True, False])
def test_counts_of_networks_without_kernels(spark, directed):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    heat = {i: float(x) for i, x in enumerate(rng.random(30)) if i % 5}
    for perm in (1, 2, 3):
        pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 30, (50, 2)).tolist() if p[0] != p[1]})
        rows += [(perm, a, b) for a, b in pairs]
        frame = pd.DataFrame(pairs, columns=["src", "dst"])
        _, w = similarity.network_weights(frame, heat, 0.4, directed, diffusion)
        sizes = graph.sizes_at(w, 0.02, directed)
        want |= {(perm, k): int((sizes >= k).sum()) for k in (1, 2, 3, 5)}
    networks = spark.createDataFrame(rows, "perm_id bigint, src int, dst int")
    scores = spark.createDataFrame(list(heat.items()), "node int, score double")
    got = similarity.counts_by_network(networks, scores, 0.4, 0.02, [1, 2, 3, 5], directed, block=4).collect()
    assert {(r.perm_id, r["size"]): r.n for r in got} == want and any(want.values())


def test_run_options(spark, tmp_path):
    """Thresholds, labels, scores, mutations, permuted networks and the hierarchy of a run."""
    names = [f"n{i:02}" for i in range(12)]
    pairs = [(i, i + 1) for i in range(11)] + [(i, i + 3) for i in range(9)]
    write = lambda name, body: (tmp_path / name).write_text(body) and str(tmp_path / name)
    index, edges = write("index.txt", "".join(f"{i + 1} {n}\n" for i, n in enumerate(names))), write("edges.txt", "".join(f"{a + 1} {b + 1}\n" for a, b in pairs))
    snv = write("snv.txt", "".join(f"s{i}\t{n}\t{names[0]}\n" for i, n in enumerate(names)))
    cna = write("cna.txt", "s0\tn02(A)\tn03(A)\ns1\tn05(D)\n")
    labels, display = write("labels.txt", "n00\tFirst Gene\n"), write("display.txt", "n00 7.5\n")
    lengths, order = write("lengths.txt", "".join(f"{n} 1000\n" for n in names)), write("order.txt", " ".join(names) + "\n")
    out = str(tmp_path / "out")
    cli.run(spark, ["heat-mutation", "--snvs", snv, "--cnas", cna, "--output", f"{out}/heat.json"])
    cli.run(spark, ["network", "--index", index, "--edges", edges, "--output", f"{out}/kernel", "--permutations", "2", "--swaps", "3"])
    common = ["run", "--output", out, "--network", "Net", index, edges, "--heat", "Heat", f"{out}/heat.json", "--heat_permutations", "2"]
    cli.run(spark, [*common, "--deltas", "0.01", "0.02", "--min_cc_size", "3", "--display_names", labels, "--display_scores", display, "--output_hierarchy"])
    folder = tmp_path / "out" / "net-heat"
    assert {"delta_0.01", "delta_0.02", "viz", "hierarchy"} <= {f.name for f in folder.iterdir()}
    assert all(len(c) >= 3 for c in json.loads((folder / "delta_0.02" / "results.json").read_text())["components"])
    page = json.loads((folder / "viz" / "delta_0.01.json").read_text())
    shown = {n["name"]: n["value"] for c in page for n in c["nodes"]}
    assert shown["First Gene"] == 7.5 and all("coverage" in c for c in page)
    mutations = json.loads((folder / "viz" / "mutations_0.01.json").read_text())
    assert mutations["geneToMutations"]["n00"]["s3"] == ["snv"] and mutations["sampleToType"]["s3"] == "Cancer"
    cli.run(spark, [*common[:2], str(tmp_path / "again"), *common[3:], "--permuted", "Net", f"{out}/kernel/permuted"])
    assert any(f.name.startswith("delta_") for f in (tmp_path / "again" / "net-heat").iterdir())
    for kind, more in (("network", []), ("heat", []), ("mutations", ["--gene_lengths", lengths, "--gene_order", order, "--bmr", "0.0001"])):
        cli.run(spark, ["deltas", "--index", index, "--edges", edges, "--heat", f"{out}/heat.json", "--output", f"{out}/by-{kind}.json", "--kind", kind, "--permutations", "2", "--sizes", "3,5", *more])
        assert set(json.loads((tmp_path / "out" / f"by-{kind}.json").read_text())) == {"3", "5"}


def test_stored_kernels_join_without_a_shuffle(spark, tmp_path):
    """The kernel of a bundle meets heat by seed where it lies; only the heat moves."""
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(12) for j in range(i + 1, 12) if (i * j) % 3 == 1], "src string, dst string")
    path = network.stored_kernel("restart", edges, 0.4, str(tmp_path / "it's here"))
    bundle = sinks.load_bundle(spark, path)
    kernel, direct = bundle["kernel"], network.restart_kernel(network.largest_component(edges), 0.4)
    assert {(r.dst, r.src): round(r.p, 5) for r in kernel.collect()} == {(r.dst, r.src): round(r.p, 5) for r in direct.collect()}
    heat = kernel.select("src").distinct().selectExpr("src as node", "double(length(src)) as score")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kernel.join(heat.select(F.col("node").alias("src"), "score"), "src")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("Bucketed: true")
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(src") <= 1, plan  # that of the heat
        assert "Exchange" not in plan[plan.index("SortMergeJoin") : scan], plan
        assert joined.count() == kernel.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mutations_sampled_in_proportion(spark):
    """Counts of each gene as a binomial has them, no pair twice, the same whatever the partitions, all and none at rates of 1 and 0."""
    genes = spark.createDataFrame([(f"g{i:02}", 1 + i * i) for i in range(20)] + [("sure", 1), ("never", 1)], "gene string, length int")
    rates = spark.createDataFrame([("sure", 1.0), ("never", 0.0)], "gene string, bmr double")
    people = spark.range(400).selectExpr("concat('s', id) as sample")
    drawn = [sorted(map(tuple, permute.sampled_snvs(frame, genes, 0.002, rates, perms=5, seed=3).collect())) for frame in (people.repartition(5), people.repartition(2))]
    assert drawn[0] == drawn[1] and len(set(drawn[0])) == len(drawn[0])
    counts = {g: sum(x[2] == g for x in drawn[0]) for g in [f"g{i:02}" for i in range(20)] + ["sure", "never"]}
    assert counts["sure"] == 2000 and counts["never"] == 0
    for i in range(20):
        p = 1 - 0.998 ** (1 + i * i)
        assert abs(counts[f"g{i:02}"] - 2000 * p) <= 5 * (2000 * p * (1 - p)) ** 0.5 + 2
    samples = [sum(x[1] == f"s{i}" for x in drawn[0]) for i in range(400)]
    assert len(set(samples)) > 5 and {x[0] for x in drawn[0]} == {1, 2, 3, 4, 5}
