"""Interaction networks: clean-up, components, walk matrices, diffusion and permutation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgraph.functions import diffusion, graph
from heatgraph.operators.connected import connected_components
from heatgraph.operators.swaps import permuted_in_rounds
from heatgraph.plans.lineage import cut, dropped, stored
from heatgraph.plans.ranks import numbered

#: Edges that are broadcast to the tasks of a kernel; larger networks iterate as DataFrames.
MOST_EDGES = 2_000_000
#: Seeds of a task that diffuses by joins.
SEEDS = 30
#: Cells of a block of kernel columns: what a task holds doesn't grow with the network.
CELLS = 2_000_000
#: Rows of a frame that leaves a task.
ROWS = 500_000
#: Nodes of a component whose columns are whole arrays, where those that need only be right within some bound could be pushed.
MOST_NODES = 100_000


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with ``src < dst``; self loops go."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, degree)``; listed nodes without edges have degree 0."""
    found = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return found if nodes is None else nodes.select("node").join(found, "node", "left").na.fill(0, ["degree"])


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes; of equals the one with the smallest node."""
    labels = components(edges)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = labels.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(inside, "src", "left_semi").select("src", "dst")


def indexed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node_id, node)`` from 1 in the order of names, and edges of ids."""
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    index = numbered(nodes, "node_id", "node").withColumn("node_id", F.col("node_id").cast("int"))
    a = index.select(F.col("node").alias("src"), F.col("node_id").alias("src_id"))
    b = index.select(F.col("node").alias("dst"), F.col("node_id").alias("dst_id"))
    return index, edges.join(a, "src").join(b, "dst").select("src_id", "dst_id")


def walk_matrix(edges: DataFrame) -> DataFrame:
    """``(dst, src, w)``: the share of a node's heat that goes to each neighbour."""
    out = degrees(edges).select(F.col("node").alias("src"), "degree")
    return both_ways(edges).join(out, "src").select("dst", "src", (1 / F.col("degree")).alias("w"))


def _few(edges: DataFrame) -> pd.DataFrame | None:
    """The edges, where a task can hold them."""
    rows = edges.select("src", "dst").limit(MOST_EDGES + 1).toPandas()
    return rows if len(rows) <= MOST_EDGES else None


def _arrays(edges: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Node names and the edges by place, both in order whatever the partitions, of a network small enough."""
    rows = _few(edges)
    if rows is None:
        raise ValueError(f"more than {MOST_EDGES} edges: use restart_iteration")
    return _places(rows)


def _places(rows: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    names = sorted(set(rows["src"]) | set(rows["dst"]))
    place = {x: i for i, x in enumerate(names)}
    src, dst = rows["src"].map(place).to_numpy(np.int64), rows["dst"].map(place).to_numpy(np.int64)
    order = np.lexsort((dst, src))
    return names, src[order], dst[order]


def _block(n: int, most: int) -> int:
    """Seeds of a block, at most ``most``, of a network of ``n`` nodes."""
    return max(1, min(most, CELLS // max(n, 1)))


def _values(names: list) -> np.ndarray:
    """Names as an array, of numbers where they are numbers: a Python object for each cell would be the most of a task's memory."""
    found = np.array(names)
    return found if found.dtype.kind == "i" else np.array(names, object)


def _blocks(spark: SparkSession, n: int, each: int = 1) -> DataFrame:
    """``(id)``, a task for ``each`` of them. A table of unknown size: by the size of a range Spark takes a kernel for small, and broadcasts it."""
    return spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(n)], max(1, -(-n // each))), "id bigint")


def _rounded(p: np.ndarray, places: int | None) -> np.ndarray:
    """Half up, as of numbers that are not negative."""
    return p if places is None else np.floor(p * 10.0**places + 0.5) / 10.0**places


def restart_kernel(
    edges: DataFrame, beta: float, block: int = 256, places: int | None = None, least: float | None = None, within: float = 0.0, heat: DataFrame | None = None, lesser: bool = False, half: bool = False
) -> DataFrame:
    """``(dst, src, p)``: heat that ends at ``dst`` from seed ``src``, of random walks with restart; nothing ends in another component.

    Some tasks for all blocks of seeds: the network is broadcast, columns are found by iteration over the edges of their component,
    so memory is edges and at most ``CELLS`` cells, never nodes squared, and cells are the squares of the components. ``places`` rounds.

    With ``least`` only entries of at least that come out (with ``heat`` ``(node, score)`` as well, those whose product with their seed's score is), so rows
    follow the entries that matter. As a column adds up to 1, none is over that. With ``within`` each may be so much too small, and those so much below
    ``least`` are there too: columns of components of over ``MOST_NODES`` nodes then come from pushes that reach no further than they must.
    With ``lesser`` each entry is the lesser of both ways, which the degrees tell, as walks are reversible; with ``half`` only those with ``dst <= src`` come out.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    schema = f"dst {kind}, src {kind}, p double"
    if least is not None and heat is None and least - within > 1 + 1e-9:
        return spark.createDataFrame([], schema)
    names, src, dst = _arrays(edges)
    scores = None
    if heat is not None:
        known = heat.select("node", "score").toPandas().set_index("node")["score"]
        scores = known.reindex(pd.Index(names)).fillna(0.0).to_numpy(float)
    shared = spark.sparkContext.broadcast((names, src, dst, scores))
    cells = CELLS

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, dst, scores = shared.value
        columns = diffusion.Columns(len(names), src, dst, block, cells)
        values = _values(names)[columns.order]
        far = least is not None and within > 0 and scores is None and columns.size.max(initial=0) > MOST_NODES
        begin, to = diffusion.neighbours(len(names), columns.u, columns.v, both=False) if far else (None, None)
        for ids in blocks:
            for i in ids["id"]:
                a, _, low, high = columns.blocks[i]
                if far and columns.size[a] > MOST_NODES:
                    at, seed, p = diffusion.pushed_columns(begin, to, beta, np.arange(a + low, a + high), within)
                    kept = np.flatnonzero(p >= least - within)
                else:
                    at, seed, p = columns(i, beta)
                    kept = None
                    if least is not None:
                        kept = np.flatnonzero((p if scores is None else p * scores[columns.order[seed]]) >= least)
                if kept is not None:
                    at, seed, p = at[kept], seed[kept], p[kept]
                if half:
                    kept = np.flatnonzero(columns.order[at] <= columns.order[seed])
                    at, seed, p = at[kept], seed[kept], p[kept]
                if lesser:
                    degree = np.maximum(columns.degree, 1)
                    p = np.minimum(_rounded(p, places), _rounded(p * (degree[seed] / degree[at]), places))
                else:
                    p = _rounded(p, places)
                for first in range(0, len(p), ROWS):
                    part = slice(first, first + ROWS)
                    yield pd.DataFrame({"dst": values[at[part]], "src": values[seed[part]], "p": p[part]})

    n = len(diffusion.Columns(len(names), src, dst, block, cells).blocks)
    each = max(1, min(8, n // (8 * spark.sparkContext.defaultParallelism)))
    return _blocks(spark, n, each).mapInPandas(run, schema)


def restart_iteration(edges: DataFrame, seeds: DataFrame, beta: float, rounds: int = 45) -> DataFrame:
    """The same for chosen seeds of a network of any size, each round a join and a grouped sum."""
    walk = cut(walk_matrix(edges))
    if walk.limit(2 * MOST_EDGES + 1).count() <= 2 * MOST_EDGES:
        return _seeds_apart(walk, seeds, beta, rounds)
    start = seeds.select(F.col("node").alias("dst"), F.col("node").alias("src"), F.lit(float(beta)).alias("p"))
    heat = start
    for i in range(rounds):
        moved = heat.select(F.col("dst").alias("at"), F.col("src").alias("seed"), "p").join(walk.select(F.col("src").alias("at"), "dst", "w"), "at")
        moved = moved.select("dst", F.col("seed").alias("src"), ((1 - beta) * F.col("p") * F.col("w")).alias("p"))
        heat = moved.unionByName(start).groupBy("dst", "src").agg(F.sum("p").alias("p"))
        heat = cut(heat) if i % 9 == 8 else heat
    return heat


def _seeds_apart(walk: DataFrame, seeds: DataFrame, beta: float, rounds: int) -> DataFrame:
    """Its rounds with the walk broadcast: rows are dealt by seed once, and joins and sums stay where the seed is, so a round shuffles nothing.

    Each join and sum of a stage keeps some memory until its end, so every ninth round is written, the one before it deleted, and dealt anew.
    """
    seeds = cut(seeds.select(F.col("node").alias("src")))
    stays = walk.select(F.col("src").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("w")).distinct()  # keeps a seed's own row for the restart
    steps = F.broadcast(cut(walk.select(F.col("src").alias("at"), F.col("dst").alias("to"), ((1 - beta) * F.col("w")).alias("w")).unionByName(stays)))
    parts = max(1, seeds.count() // SEEDS)
    heat = seeds.repartition(parts, "src").select(F.col("src").alias("at"), "src", F.lit(float(beta)).alias("p"))
    before = None
    for i in range(rounds):
        back = F.when(F.col("to") == F.col("src"), F.lit(float(beta))).otherwise(0.0)
        heat = heat.join(steps, "at").groupBy("src", "to").agg((F.sum(F.col("p") * F.col("w")) + F.first(back)).alias("p")).withColumnRenamed("to", "at")
        if i % 9 == 8 and i + 1 < rounds:
            table = stored(heat)
            if before is not None:
                dropped(before)
            before, heat = table, table.repartition(parts, "src")
    return heat.select(F.col("at").alias("dst"), "src", "p")


def heat_kernel(edges: DataFrame, time: float, block: int = 256) -> DataFrame:
    """``(dst, src, p)`` of the heat equation, a task for each block of seeds, by the action of the exponential on them."""
    spark = edges.sparkSession
    names, src, dst = _arrays(edges)
    block = _block(len(names), block)
    kind = edges.schema["src"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((names, src, dst))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, dst = shared.value
        values = _values(names)
        begin, to = diffusion.neighbours(len(names), src, dst)
        for ids in blocks:
            for first in ids["id"]:
                seeds = np.arange(first * block, min((first + 1) * block, len(names)))
                p = diffusion.heat_columns(begin, to, time, seeds)
                yield pd.DataFrame({"dst": np.repeat(values, len(seeds)), "src": np.tile(values[seeds], len(names)), "p": p.ravel()})

    blocks = -(-len(names) // block)
    return _blocks(spark, blocks).mapInPandas(run, f"dst {kind}, src {kind}, p double")


def stored_kernel(kind: str, edges: DataFrame, parameter: float, path: str) -> str:
    """Clean, take the largest component, diffuse, store as single precision."""
    from heatgraph.sources.sinks import save_bundle

    if kind not in ("restart", "heat"):
        raise NotImplementedError(kind)
    clean = largest_component(canonical(edges))
    kernel = restart_kernel(clean, parameter) if kind == "restart" else heat_kernel(clean, parameter)
    save_bundle(kernel.withColumn("p", F.col("p").cast("float")), clean, {"kind": kind, "parameter": parameter}, path)
    return path


def balanced_beta(edges: DataFrame, digits: int = 2) -> DataFrame:
    """``(beta)``: the restart probability that balances a network of integer ids, from least to largest id.

    Both sums of the balance are power series in ``1 - beta``. Their coefficients are traces, added up over blocks of seeds by all tasks,
    so no kernel is held and the search for the root is over some thousand numbers.
    """
    spark = edges.sparkSession
    names, src, dst = _arrays(canonical(edges))
    loops = set(edges.where("src = dst").select("src").distinct().toPandas()["src"])  # they count for degrees
    names, src, dst = _with_loops(names, src, dst, loops)
    low = 10.0**-digits
    block = _block(4 * len(names), 256)
    shared = spark.sparkContext.broadcast((len(names), src, dst))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, src, dst = shared.value
        walk = diffusion.Walk(n, src, dst)
        for ids in blocks:
            for first in ids["id"]:
                own, near = walk.traces(np.arange(first * block, min((first + 1) * block, n)), low)
                yield pd.DataFrame({"power": np.arange(len(own)), "own": own, "near": near})

    rows = _blocks(spark, -(-len(names) // block)).mapInPandas(run, "power int, own double, near double")
    found = rows.groupBy("power").agg(F.sum("own").alias("own"), F.sum("near").alias("near")).orderBy("power").toPandas()
    walk = diffusion.Walk(len(names), src, dst)
    beta = diffusion.balanced_series(walk, found["own"].to_numpy(), found["near"].to_numpy(), digits)
    return spark.createDataFrame([(beta,)], "beta double")


def _with_loops(names: list, src: np.ndarray, dst: np.ndarray, loops: set) -> tuple[list, np.ndarray, np.ndarray]:
    every = sorted(set(names) | loops)
    place = {x: i for i, x in enumerate(every)}
    at = np.array([place[x] for x in names], np.int64)
    own = np.array(sorted(place[x] for x in loops), np.int64)
    return every, np.concatenate([at[src], own]), np.concatenate([at[dst], own])


def permuted(edges: DataFrame, n: int, swaps_per_edge: float = 115, seed: int = 0, first: int = 1, report: bool = False) -> DataFrame:
    """``(perm_id, src, dst)``: ``n`` networks of the same degrees, connected and simple.

    A task for each while the network has at most ``MOST_EDGES`` edges; larger ones are swapped in rounds by all
    tasks. With ``report`` each row also has ``swaps``, the number made, to be held against the number asked for.
    """
    spark = edges.sparkSession
    rows = _few(edges)
    if rows is None:
        return permuted_in_rounds(edges, n, swaps_per_edge, seed, first, report)
    names, src, dst = _places(rows)
    kind = edges.schema["src"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((names, np.stack([src, dst], axis=1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, pairs = shared.value
        values = np.array(names, object)
        for ids in frames:
            for perm in ids["id"]:
                made, swaps = graph.swapped(pairs, len(names), int(swaps_per_edge * len(pairs)), np.random.default_rng([seed, int(perm)]))
                out = pd.DataFrame({"perm_id": int(perm), "src": values[made[:, 0]], "dst": values[made[:, 1]]})
                yield out.assign(swaps=swaps) if report else out

    return spark.range(first, first + n).repartition(n).mapInPandas(run, f"perm_id bigint, src {kind}, dst {kind}" + (", swaps bigint" if report else ""))
