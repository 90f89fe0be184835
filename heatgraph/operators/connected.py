"""Connected and strongly connected components of graphs of any size.

Undirected ones by alternating large-star / small-star contraction: every round is two grouped minima and one
lineage cut, the number of rounds grows with the logarithm of the graph's diameter. Directed ones by
trimming and colouring forwards and backwards. No edge list ever leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.plans.lineage import cut, dropped, stored


def _down(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from its larger end to its smaller one."""
    return edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each vertex to the smallest vertex of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges(u, v)``; component = its smallest vertex.

    Nulls on either side are not edges; self loops and repeated edges change nothing except that a
    vertex with only a self loop is its own component. An empty edge table gives an empty result.
    """
    known = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    known = cut(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = known.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("component"))
    star = known.where(F.col("u") != F.col("v"))
    seen = _state(star)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        star = cut(_down(_small_star(_down(_large_star(star)))))
        now = _state(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def least_ancestors(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(node, low)``: the smallest vertex from which each vertex of the directed ``edges(u, v)`` is reached, itself included.

    A round follows every edge once and then looks up the ancestor's own ancestor, so chains get shorter by
    half; rounds go on until nothing changes. The result is a written table, for the caller to drop.
    """
    first = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("from"))
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    low = stored(nodes.join(first, "node", "left").select("node", F.least("node", "from").alias("low")))
    for _ in range(max_rounds):
        above = low.select(F.col("node").alias("low"), F.col("low").alias("higher"))
        jumped = low.join(above, "low").select("node", F.col("low").alias("was"), F.least("low", "higher").alias("low"))
        reached = edges.join(jumped.select(F.col("node").alias("u"), F.col("low").alias("from")), "u").groupBy(F.col("v").alias("node")).agg(F.min("from").alias("from"))
        now = stored(jumped.join(reached, "node", "left").select("node", F.least("low", "from").alias("low"), (F.least("low", "from") != F.col("was")).alias("changed")))
        dropped(low)
        low = now
        if low.where("changed").isEmpty():
            return low.select("node", "low")
    raise RuntimeError(f"ancestors did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, component)`` for every vertex of the directed ``edges(u, v)``; component = smallest vertex of its strong component.

    Each round trims vertices without a way in or out, colours the others by their least ancestor, and
    inside each colour by the least vertex that they reach. Where both are the same vertex, which is the
    pivot of its colour, the vertex is in the pivot's component. All other components lie inside one colour and one
    reach, so only edges between open vertices that share both go on. Nulls on either side are not edges.
    """
    known = stored(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").distinct())
    nodes = known.select(F.col("u").alias("node")).unionByName(known.select(F.col("v").alias("node"))).distinct()
    rest, settled = known.where(F.col("u") != F.col("v")), []
    for _ in range(max_rounds):
        both = rest.select(F.col("u").alias("node")).distinct().join(rest.select(F.col("v").alias("node")).distinct(), "node")
        open_ = stored(rest.join(both.select(F.col("node").alias("u")), "u").join(both.select(F.col("node").alias("v")), "v").select("u", "v"))
        if open_.isEmpty():
            break
        colour = least_ancestors(open_)
        own = open_.join(colour.select(F.col("node").alias("u"), F.col("low").alias("colour")), "u")
        same = stored(own.join(colour.select(F.col("node").alias("v"), F.col("low").alias("colour")), ["v", "colour"]).select("u", "v", "colour"))
        dropped(open_)
        if same.isEmpty():
            break  # every vertex is a colour of its own
        reach = least_ancestors(same.select(F.col("v").alias("u"), F.col("u").alias("v")))
        placed = stored(colour.select("node", F.col("low").alias("colour")).join(reach.select("node", F.col("low").alias("reach")), "node"))
        dropped(colour)
        dropped(reach)
        settled.append(placed.where(F.col("colour") == F.col("reach")).select("node", F.col("colour").alias("component")))
        still = placed.where(F.col("colour") != F.col("reach"))
        if still.isEmpty():
            break
        ends = still.select(F.col("node").alias("v"), "colour", "reach")
        rest = stored(same.join(still.select(F.col("node").alias("u"), "colour", "reach"), ["u", "colour"]).join(ends, ["v", "colour", "reach"]).select("u", "v"))
        dropped(same)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not settled:
        return nodes.select("node", F.col("node").alias("component"))
    found = reduce(DataFrame.unionByName, settled)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
