"""Heat-weighted similarity, threshold graphs and their components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.functions import graph
from heatgraph.operators.connected import connected_components, strong_components
from heatgraph.plans.bounded import join_checked
from heatgraph.plans.lineage import cut

#: Edges of a graph that one task takes in memory.
MOST_EDGES = 2_000_000
#: Scores that are broadcast to the cells of a kernel, so that these stay where they are.
MOST_SCORES = 1_000_000
#: Nodes of a network that one task diffuses.
MOST_NODES = 2_000


def similarity(kernel: DataFrame, heat: DataFrame, directed: bool = True, delta: float | None = None, lesser: bool = False) -> DataFrame:
    """``(src, dst, w)`` over nodes with heat: ``w = p * heat(src)``.

    Undirected: the smaller of both kernels times the larger heat; a kernel that is ``lesser`` already is not joined with itself. With ``delta`` only
    what can reach it is read: ``p`` below ``delta / max(heat)`` never does, a filter that goes down to the scan.
    """
    scores = cut(heat.select("node", "score"))
    if delta is not None and delta > 0 and directed:
        most = scores.agg(F.max("score")).first()[0] or 0.0
        kernel = kernel.where(F.col("p") >= (delta / most * (1 - 1e-6) if most > 0 else float("inf")))
    own = scores.select(F.col("node").alias("src"), "score")
    other = scores.select(F.col("node").alias("dst"), F.col("score").alias("other"))
    held = kernel.select("src", "dst", F.col("p").cast("double").alias("p"))
    held = join_checked(join_checked(held, own, "src", "inner", MOST_SCORES), other, "dst", "inner", MOST_SCORES)
    if directed:
        found = held.select("src", "dst", (F.col("p") * F.col("score")).alias("w"))
    elif lesser:
        found = held.select("src", "dst", (F.col("p") * F.greatest("score", "other")).alias("w"))
    else:
        back = kernel.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").cast("double").alias("q"))
        found = held.join(back, ["src", "dst"]).select("src", "dst", (F.least("p", "q") * F.greatest("score", "other")).alias("w"))
    return found if delta is None else found.where(F.col("w") >= delta)


def edges_at(sim: DataFrame, delta: float) -> DataFrame:
    """Weighted edges ``src -> dst`` of at least ``delta``, loops kept: a node is there if an edge touches it."""
    return sim.where(F.col("w") >= delta).select("src", "dst", "w")


def component_members(edges: DataFrame, keys: list[str] | None = None, directed: bool = True, most: int = MOST_EDGES) -> DataFrame:
    """``(keys, component, node)``: (strongly) connected components, named by their smallest node.

    Without keys the graph may have any size and is worked on as DataFrames. With keys each group of at most
    ``most`` edges, which is counted first, is one task beside the others; larger ones are worked on like those without keys, all at once.
    """
    if not keys:
        ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        return (strong_components if directed else connected_components)(ends).select("component", "node")
    table = cut(edges.select(*keys, "src", "dst"))
    large = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys)
    if large.isEmpty():
        return _members_by_task(table, keys, directed)
    large = cut(large)
    within = table.join(F.broadcast(large), keys, "left_semi")  # each of them has over ``most`` edges, so they are few
    ends = within.select(F.struct(*keys, F.col("src").alias("node")).alias("u"), F.struct(*keys, F.col("dst").alias("node")).alias("v"))
    found = (strong_components if directed else connected_components)(ends)
    named = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("component.node").alias("component"), F.col("node.node").alias("node"))
    return _members_by_task(table.join(F.broadcast(large), keys, "left_anti"), keys, directed).unionByName(named)


def _members_by_task(edges: DataFrame, keys: list[str], directed: bool) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()
    schema = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in keys) + f"component {kind}, node {kind}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(set(rows["src"]) | set(rows["dst"])), object)
        place = {x: i for i, x in enumerate(names)}
        src, dst = rows["src"].map(place).to_numpy(np.int64), rows["dst"].map(place).to_numpy(np.int64)
        label = graph.strong_components(len(names), src, dst) if directed else graph.components(len(names), src, dst)
        first = {}
        for i, x in enumerate(label.tolist()):  # names ascend, so the first seen is the smallest
            first.setdefault(x, names[i])
        out = pd.DataFrame({"component": [first[x] for x in label.tolist()], "node": names})
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "component", "node"]]

    return edges.groupBy(*keys).applyInPandas(run, schema)


def listing(members: DataFrame, min_size: int = 1, keys: list[str] | None = None) -> DataFrame:
    """``(keys, component, size, members)``, members sorted."""
    grouped = members.groupBy(*(keys or []), "component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return grouped.withColumn("size", F.size("members")).where(F.col("size") >= min_size)


def ordered(components: DataFrame) -> DataFrame:
    return components.orderBy(F.desc("size"), F.col("members")[0])


def size_counts(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, size, n)``: how many components have each size."""
    sizes = members.groupBy(*(keys or []), "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*(keys or []), "size").agg(F.count(F.lit(1)).alias("n"))


def at_least(members: DataFrame, sizes: list[int], keys: list[str] | None = None) -> DataFrame:
    """``(keys, size, n)``: components of at least each of the sizes; without keys there is a row for each size also where there is no component."""
    counts = size_counts(members, keys)
    if not keys:
        none = members.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n"))
        counts = counts.unionByName(none)
    wanted = F.explode(F.array(*map(F.lit, sizes))).alias("k")
    table = counts.select(*(keys or []), F.col("size").alias("s"), "n", wanted)
    return table.groupBy(*(keys or []), F.col("k").alias("size")).agg(F.sum(F.when(F.col("s") >= F.col("k"), F.col("n")).otherwise(0)).alias("n"))


def permutation(kernel: DataFrame) -> list[str]:
    """The key that cells of a kernel for each permutation share with its heat; none of one kernel for all."""
    return ["perm_id"] if "perm_id" in kernel.columns else []


def permuted_similarity(kernel: DataFrame, heats: DataFrame, delta: float, directed: bool = True) -> DataFrame:
    """``(perm_id, src, dst, w)`` of at least ``delta`` (above 0), for heats ``(perm_id, node, score)``.

    Joins of what can reach ``delta`` at all: ``p`` below ``delta / max(score)`` never does, so the kernel is
    read as the few entries that matter, and never leaves the executors.
    """
    if delta <= 0:
        raise ValueError("the threshold must be over 0")
    heats = cut(heats.select("perm_id", "node", "score"))
    most = heats.agg(F.max("score")).first()[0] or 0.0
    near = kernel.where(F.col("p") >= (delta / most * (1 - 1e-6) if most > 0 else float("inf")))
    keys = permutation(kernel)
    near = near.select(*keys, "src", "dst", F.col("p").cast("double").alias("p"))
    own = heats.select("perm_id", F.col("node").alias("src"), "score")
    other = heats.select("perm_id", F.col("node").alias("dst"), F.col("score").alias("other"))
    if directed:
        found = join_checked(near, own, [*keys, "src"], "inner", MOST_SCORES).withColumn("w", F.col("p") * F.col("score")).where(F.col("w") >= delta)
        return join_checked(found, other.select("perm_id", "dst"), ["perm_id", "dst"], "left_semi", MOST_SCORES).select("perm_id", "src", "dst", "w")
    back = near.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    found = near.join(back, [*keys, "src", "dst"]).withColumn("p", F.least("p", "q"))
    found = join_checked(join_checked(found, own, [*keys, "src"], "inner", MOST_SCORES), other, ["perm_id", "dst"], "inner", MOST_SCORES)
    found = found.withColumn("w", F.col("p") * F.greatest("score", "other"))
    return found.where(F.col("w") >= delta).select("perm_id", "src", "dst", "w")


def counts_at_levels(kernel: DataFrame, heats: DataFrame, deltas: list[float], sizes: list[int], directed: bool = True) -> DataFrame:
    """``(perm_id, delta, size, n)``: components of at least each size, of all permutations at all thresholds in one pass.

    A task holds the edges of one permutation at one threshold. Sizes are 2 or more, as nodes without an edge are not looked at.
    """
    spark = kernel.sparkSession
    levels = spark.createDataFrame([(float(d),) for d in deltas], "delta double")
    sim = permuted_similarity(kernel, heats, min(deltas), directed)
    graphs = sim.join(F.broadcast(levels), F.col("w") >= F.col("delta"))  # a threshold or more for each edge
    counted = at_least(component_members(graphs, ["perm_id", "delta"], directed), sizes, ["perm_id", "delta"])
    wanted = heats.select(F.col("perm_id").cast("bigint").alias("perm_id")).distinct().withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    wanted = wanted.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return wanted.join(counted, ["perm_id", "delta", "size"], "left").select("perm_id", "delta", "size", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def counts_by_permutation(kernel: DataFrame, heats: DataFrame, delta: float, sizes: list[int], directed: bool = True) -> DataFrame:
    """``(perm_id, size, n)`` at one threshold."""
    return counts_at_levels(kernel, heats, [delta], sizes, directed).drop("delta")


def counts_by_network(networks: DataFrame, heat: DataFrame, beta: float, delta: float, sizes: list[int], directed: bool = True, block: int = 256, most: int = MOST_NODES) -> DataFrame:
    """The same for permuted networks ``(perm_id, src, dst)`` with one heat.

    A task diffuses a network of at most ``most`` nodes by blocks of seeds and keeps the few entries that can reach ``delta`` (over 0), so no
    kernel is held: memory is edges and nodes times ``block``. Heat goes to the tasks as joined rows. Such entries of larger networks are found by all tasks.
    """
    from heatgraph.functions import diffusion
    from heatgraph.operators.network import restart_kernel

    if delta <= 0:
        raise ValueError("the threshold must be over 0")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(set(rows["src"]) | set(rows["dst"])), object)
        place = {x: i for i, x in enumerate(names)}
        src, dst = rows["src"].map(place).to_numpy(np.int64), rows["dst"].map(place).to_numpy(np.int64)
        h = np.full(len(names), np.nan)
        h[src], h[dst] = rows["a"].to_numpy(float), rows["b"].to_numpy(float)
        hot = np.flatnonzero(~np.isnan(h))
        least = delta / h[hot].max() * (1 - 1e-6) if len(hot) and h[hot].max() > 0 else np.inf
        held = []
        for first in range(0, len(hot) if least <= 1 else 0, block):  # no entry is over 1
            seeds = hot[first : first + block]
            p = diffusion.restart_columns(len(names), src, dst, beta, seeds)
            i, j = np.nonzero(p >= least)
            held.append((i, seeds[j], p[i, j]))
        i, j, p = (np.concatenate([x[k] for x in held]) if held else np.zeros(0) for k in range(3))
        i, j = i.astype(np.int64), j.astype(np.int64)
        p = p.astype(np.float32).astype(float)
        if directed:
            keep = ~np.isnan(h[i]) & (p * h[j] >= delta)
        else:  # the smaller of both ways; one that isn't kept is too small
            key, back = i * len(names) + j, j * len(names) + i
            order = np.argsort(key)
            at = order[np.minimum(np.searchsorted(key[order], back), max(len(key) - 1, 0))] if len(key) else order
            q = np.where(key[at] == back, p[at], 0.0) if len(key) else p
            keep = ~np.isnan(h[i]) & (np.minimum(p, q) * np.maximum(h[i], h[j]) >= delta)
        i, j = i[keep], j[keep]
        label = (graph.strong_components if directed else graph.components)(len(names), j, i)
        touched = np.unique(np.concatenate([i, j]))
        found = np.unique(label[touched], return_counts=True)[1]
        return pd.DataFrame({"perm_id": rows["perm_id"].iloc[0], "size": sizes, "n": [int((found >= k).sum()) for k in sizes]})

    networks = cut(networks.select(F.col("perm_id").cast("bigint").alias("perm_id"), "src", "dst"))  # permuted once
    nodes = networks.select("perm_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("perm_id").agg(F.countDistinct("node").alias("n"))
    large = sorted(r["perm_id"] for r in nodes.where(F.col("n") > most).collect())
    small = scored_networks(networks.where(~F.col("perm_id").isin(large)), heat).groupBy("perm_id").applyInPandas(run, "perm_id bigint, size int, n bigint")
    if not large:
        return small
    heat = cut(heat.select("node", "score"))
    top = heat.agg(F.max("score")).first()[0] or 0.0
    least = delta / top * (1 - 1e-6) if top > 0 else float("inf")
    kernels = [restart_kernel(networks.where(F.col("perm_id") == p), beta, block, least=least).select(F.lit(p).cast("bigint").alias("perm_id"), "dst", "src", F.col("p").cast("float").alias("p")) for p in large]
    heats = heat.crossJoin(F.broadcast(networks.sparkSession.createDataFrame([(p,) for p in large], "perm_id bigint")))
    found = counts_by_permutation(reduce(DataFrame.unionByName, kernels), heats, delta, sizes, directed)
    return small.unionByName(found.select("perm_id", F.col("size").cast("int").alias("size"), "n"))


def scored_networks(networks: DataFrame, heat: DataFrame) -> DataFrame:
    """``(perm_id, src, dst, a, b)``: edges with the scores of both ends, null where there is none."""
    one, other = (heat.select(F.col("node").alias(c), F.col("score").alias(k)) for c, k in (("src", "a"), ("dst", "b")))
    return networks.select("perm_id", "src", "dst").join(one, "src", "left").join(other, "dst", "left").select("perm_id", "src", "dst", "a", "b")


def network_weights(rows: pd.DataFrame, scores: dict, beta: float, directed: bool, diffusion) -> tuple[list, np.ndarray]:
    """Similarity of a task's network."""
    names = sorted(set(rows["src"]) | set(rows["dst"]))
    place = {x: i for i, x in enumerate(names)}
    src, dst = rows["src"].map(place).to_numpy(np.int64), rows["dst"].map(place).to_numpy(np.int64)
    keep = [i for i, x in enumerate(names) if x in scores]
    p = diffusion.restart_kernel(diffusion.adjacency(len(names), src, dst), beta)[np.ix_(keep, keep)]
    p = p.astype(np.float32).astype(float)
    h = np.array([scores[names[i]] for i in keep])
    return [names[i] for i in keep], p * h if directed else np.minimum(p, p.T) * np.maximum(h[:, None], h)
