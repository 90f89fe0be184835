"""Whole analyses: one run, all runs with their consensus, and their files."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.functions import hierarchy
from heatgraph.operators import consensus, delta, heat as heat_ops, network, permute, similarity, tree, view
from heatgraph.plans.lineage import cut
from heatgraph.sources import sinks, text


@dataclass
class Settings:
    """Parameters of a run; ``deltas`` given are used as they are."""

    beta: float = 0.4
    network_permutations: int = 20
    heat_permutations: int = 100
    max_sizes: tuple[int, ...] = (5, 10, 15, 20)
    sizes: tuple[int, ...] = tuple(range(2, 11))
    min_size: int = 2
    swaps_per_edge: float = 115
    seed: int = 0
    deltas: tuple[float, ...] = ()
    pval: float = 0.01
    at_once: int = 4  # runs whose jobs share the cluster


@dataclass
class Run:
    """Results of one network and heat: components and statistics at each threshold."""

    network: str
    heat: str
    members: DataFrame  # network, heat, delta, component, node
    statistics: DataFrame  # network, heat, delta, size, observed, expected, pval
    deltas: list[float] = field(default_factory=list)


def single_run(edges: DataFrame, heat: DataFrame, settings: Settings, network_name: str = "network", heat_name: str = "heat", permuted: DataFrame | None = None) -> Run:
    """Choose thresholds, find components, and test their numbers against permuted heats.

    Nodes of the network without heat are in no component but may get heat when it is permuted.
    """
    edges = cut(network.largest_component(network.canonical(edges)))
    nodes = network.both_ways(edges).select(F.col("src").alias("node")).distinct()
    scores = heat_ops.in_network(heat, nodes)
    positive = cut(heat_ops.filter_heat(scores, None, False))
    others = heat_ops.filtered_nodes(scores, positive)
    deltas = list(settings.deltas)
    if not deltas:
        networks = permuted if permuted is not None else network.permuted(edges, settings.network_permutations, settings.swaps_per_edge, settings.seed)
        found = delta.by_networks(networks, positive, settings.beta, list(settings.max_sizes))
        deltas = [r["delta"] for r in delta.medians(found).orderBy("size").collect()]
    deltas = sorted(set(deltas))
    most = positive.agg(F.max("score")).first()[0] or 0.0
    least = min(deltas) / most * (1 - 1e-5) if most > 0 else None  # no other entry can reach a threshold, however the heat is dealt
    kernel = cut(network.restart_kernel(edges, settings.beta, least=least).withColumn("p", F.col("p").cast("float")))
    sim = cut(similarity.similarity(kernel, positive, delta=min(deltas)))
    levels = edges.sparkSession.createDataFrame([(d,) for d in deltas], "delta double")
    graphs = sim.crossJoin(F.broadcast(levels)).where(F.col("w") >= F.col("delta"))
    members = cut(similarity.component_members(graphs, ["delta"]))
    sizes = list(settings.sizes)
    heats = cut(permute.permuted_heat(positive, nodes, settings.heat_permutations, others, settings.seed)) if settings.heat_permutations else None
    permuted_counts = cut(similarity.counts_at_levels(kernel, heats, deltas, sizes)) if heats is not None else None
    tables = []
    for d in deltas:
        real = similarity.at_least(members.where(F.col("delta") == d), sizes)
        real = edges.sparkSession.createDataFrame([(k,) for k in sizes], "size int").join(real, "size", "left").na.fill(0)
        counts = permuted_counts.where(F.col("delta") == d).drop("delta") if heats is not None else None
        tables.append(consensus.consensus_statistics(real, counts, settings.heat_permutations).withColumn("delta", F.lit(d)))
    statistics = tables[0]
    for t in tables[1:]:
        statistics = statistics.unionByName(t)
    names = {"network": F.lit(network_name), "heat": F.lit(heat_name)}
    listed = similarity.listing(members, settings.min_size, ["delta"]).select("delta", "component", F.explode("members").alias("node"))
    return Run(network_name, heat_name, listed.withColumns(names), cut(statistics.withColumns(names)), deltas)


def all_runs(networks: dict[str, DataFrame], heats: dict[str, DataFrame], settings: Settings, own: dict[tuple[str, str], DataFrame] | None = None, permuted: dict[str, DataFrame] | None = None) -> tuple[list[Run], DataFrame, DataFrame]:
    """Every network with every heat, their consensus roles, and the chosen thresholds.

    ``own`` has heats by (network, heat), ``permuted`` networks ``(perm_id, src, dst)`` by network, where they needn't be made.
    """
    with ThreadPoolExecutor(max(1, settings.at_once)) as pool:
        waiting = [pool.submit(single_run, e, own[n, k] if own else h, settings, n, k, (permuted or {}).get(n)) for n, e in networks.items() for k, h in heats.items()]
        runs = [w.result() for w in waiting]
    members, statistics = runs[0].members, runs[0].statistics
    for r in runs[1:]:
        members, statistics = members.unionByName(r.members), statistics.unionByName(r.statistics)
    roles, chosen = consensus.identified(members, statistics, settings.pval, settings.min_size)
    return runs, cut(roles), cut(chosen)


def dealt_heat(edges: DataFrame, heat: DataFrame, seed: int) -> DataFrame:
    """``(node, score)``: the positive scores of a network's nodes dealt over all its nodes that have a score, 0 for the rest."""
    nodes = network.both_ways(edges).select(F.col("src").alias("node")).distinct()
    scores = cut(heat_ops.in_network(heat, nodes))
    positive = cut(heat_ops.filter_heat(scores, None, False))
    dealt = permute.permuted_heat(positive, nodes, 1, heat_ops.filtered_nodes(scores, positive), seed)
    return cut(scores.select("node").distinct().join(dealt.select("node", "score"), "node", "left").na.fill(0.0))


def permuted_consensus(networks: dict[str, DataFrame], heats: dict[str, DataFrame], settings: Settings, n: int, seed: int = 1) -> DataFrame:
    """``(perm_id, size, n)``: consensus sizes of permuted heats on the same networks.

    Each heat is dealt anew inside each network, over its nodes with a score, those of score 0 included.
    """
    connected = {k: cut(network.largest_component(network.canonical(e))) for k, e in networks.items()}
    found = None
    for i in range(1, n + 1):
        pairs = [(e, h) for e in networks for h in heats]
        own = {(e, h): dealt_heat(connected[e], heats[h], (seed * 1000 + i) * 100 + at) for at, (e, h) in enumerate(pairs)}
        counts = cut(consensus.size_counts(all_runs(connected, heats, settings, own)[1]).withColumn("perm_id", F.lit(i)))
        found = counts if found is None else found.unionByName(counts)
    return found


def stored_runs(spark, root: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(network, heat, delta, component, node)`` and ``(network, heat, delta, size, observed, expected, pval)`` of the runs below the roots, or of the files given."""
    named = lambda name, part: F.coalesce(F.col("parameters")[name], F.split("run", "-")[part])
    found = text.run_results(spark, root).select(named("network_name", 0).alias("network"), named("heat_name", 1).alias("heat"), "delta", "components", "statistics")
    listed = found.select("network", "heat", "delta", F.posexplode("components").alias("component", "nodes"))
    members = listed.select("network", "heat", "delta", "component", F.explode("nodes").alias("node"))
    statistics = found.select("network", "heat", "delta", F.explode("statistics").alias("size", "s"))
    return cut(members), cut(statistics.select("network", "heat", "delta", F.col("size").cast("int").alias("size"), "s.observed", "s.expected", "s.pval"))


def stored_consensus(spark, root: str | list[str], output: str, pval: float = 0.01, min_size: int = 2) -> None:
    """Consensus of stored runs as one file: a JSON document, or lines joined by commas, by the file's ending."""
    members, statistics = stored_runs(spark, root)
    roles, chosen = consensus.identified(members, statistics, pval, min_size)
    linkers, listed, deltas = consensus_lists(roles, chosen)
    if output.lower().endswith(".json"):
        sinks.write_json(output, {"linkers": linkers, "consensus": listed, "deltas": deltas})
    else:
        sinks.write_text(output, f"# Linkers: {', '.join(linkers)}\n" + sinks.consensus_lines(linkers, listed, ", "))


@dataclass
class Shown:
    """What result pages show besides nodes, edges and heat."""

    labels: DataFrame | None = None  # node, label
    display: DataFrame | None = None  # node, score
    mutations: DataFrame | None = None  # sample, gene, mut_type, valid
    types: DataFrame | None = None  # sample, type


def write_run(run: Run, root: str, parameters: dict, heat: DataFrame | None = None, edges: DataFrame | None = None, shown: Shown | None = None) -> str:
    """A folder for each threshold, and the payload and index of the result pages; with mutations their matrix and each component's coverage."""
    shown = shown or Shown()
    samples = shown.types.select("sample").distinct().count() if shown.mutations is not None else 0
    folder = os.path.join(root, f"{run.network}-{run.heat}".lower())
    for d in run.deltas:
        own = run.members.where(F.col("delta") == d)
        listed = [[str(x) for x in r["members"]] for r in similarity.ordered(similarity.listing(own.select("component", "node"))).collect()]
        table = {r["size"]: {"observed": r["observed"], "expected": r["expected"], "pval": r["pval"]} for r in run.statistics.where(F.col("delta") == d).collect()}
        named = parameters | {"network_name": run.network, "heat_name": run.heat, "delta": d}
        sinks.write_run(folder, d, named, listed, table, sinks.heat_document(heat, parameters) if heat is not None else None)
        if heat is not None and edges is not None:
            members = own.select("component", "node")
            pages = view.document(members, heat, edges, shown.labels, shown.display, shown.mutations, samples).orderBy("component").collect()
            sinks.write_text(os.path.join(folder, "viz", f"delta_{d:g}.json"), "[" + ",\n".join(r["json"] for r in pages) + "]\n")
            if shown.mutations is not None:
                sinks.write_text(os.path.join(folder, "viz", f"mutations_{d:g}.json"), view.mutation_document(shown.mutations, members, shown.types) + "\n")
    sinks.write_text(os.path.join(folder, "viz", "index.html"), view.index_page(run.deltas))
    return folder


def consensus_lists(roles: DataFrame, chosen: DataFrame) -> tuple[list[str], list[dict], dict]:
    """Linkers, subnetworks with core and expansion (largest core first), and the threshold of each run."""
    rows = roles.collect()
    linkers = sorted(str(r["node"]) for r in rows if r["role"] == "linker")
    groups: dict = {}
    for r in rows:
        if r["role"] != "linker":
            groups.setdefault(r["component"], {"core": [], "expansion": []})[r["role"]].append(str(r["node"]))
    listed = sorted(({k: sorted(v) for k, v in g.items()} for g in groups.values()), key=lambda g: (-len(g["core"]), g["core"]))
    return linkers, listed, {f"{r['network']}-{r['heat']}": r["delta"] for r in chosen.collect()}


def write_consensus(roles: DataFrame, chosen: DataFrame, statistics: DataFrame, root: str, parameters: dict) -> None:
    linkers, listed, deltas = consensus_lists(roles, chosen)
    table = {r["size"]: {"observed": r["observed"], "expected": r["expected"], "pval": r["pval"]} for r in statistics.collect()}
    sinks.write_consensus(root, linkers, listed, deltas, table, parameters)


def write_hierarchy(edges: DataFrame, heat: DataFrame, beta: float, folder: str) -> None:
    """The dendrogram of the similarities in a network; neither they nor the kernel reach the driver."""
    edges = cut(network.largest_component(network.canonical(edges)))
    made = tree.largest_tree(cut(similarity.similarity(network.restart_kernel(edges, beta), heat)))
    rows, labels = hierarchy.linkage(made)
    sinks.write_hierarchy(folder, rows, labels, hierarchy.newick(made), {"beta": beta})


def selected_deltas(edges: DataFrame, heat: DataFrame, settings: Settings, kind: str = "network", statistic: str = delta.LARGEST, mutations: dict | None = None) -> dict[int, float]:
    """The median threshold for each size, from permuted networks, permuted heats or permuted mutations.

    ``mutations`` has ``samples, genes, blocks, order`` and ``bmr`` of ``delta.by_mutations``.
    """
    edges = cut(network.largest_component(network.canonical(edges)))
    nodes = network.both_ways(edges).select(F.col("src").alias("node")).distinct()
    scores = heat_ops.in_network(heat, nodes)
    positive = cut(heat_ops.filter_heat(scores, None, False))
    sizes = list(settings.max_sizes)
    if kind == "network":
        networks = network.permuted(edges, settings.network_permutations, settings.swaps_per_edge, settings.seed)
        found = delta.by_networks(networks, positive, settings.beta, sizes, statistic)
    else:
        kernel = cut(network.restart_kernel(edges, settings.beta).withColumn("p", F.col("p").cast("float")))
        if kind == "heat":
            heats = permute.permuted_heat(positive, nodes, settings.heat_permutations, heat_ops.filtered_nodes(scores, positive), settings.seed)
            found = delta.by_heats(kernel, cut(heats), sizes, statistic)
        else:
            found = delta.by_mutations(kernel, "mutation", **mutations, sizes=sizes, statistic=statistic, perms=settings.heat_permutations, seed=settings.seed)
    return {r["size"]: r["delta"] for r in delta.medians(found).collect()}
