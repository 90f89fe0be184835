"""Hierarchies of strong components over all thresholds, of networks of any size, as DataFrames.

The thresholds of all subproblems are halved at once: a round finds the strong components of the heavier half of each
subproblem's edges, which are subproblems of their own over the higher thresholds, and contracts them in the other half. A
subproblem with few enough edges is solved by one task. Rounds follow the logarithm of the number of weights.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.functions.hierarchy import decompose_edges
from heatgraph.operators.connected import connected_components
from heatgraph.operators.similarity import component_members
from heatgraph.plans.lineage import dropped, stored

#: Edges of a subproblem that one task solves.
SMALL = 200_000

_ID = ["key", "root", "bound"]  # smallest vertex, and a bound below its thresholds and above those of any other with that vertex


def _strong(edges: DataFrame, ids: list[str]) -> DataFrame:
    """``(ids, node, top)``: strong components of all subproblems at once, a task for each that one can hold."""
    found = component_members(edges.select(*ids, F.col("u").alias("src"), F.col("v").alias("dst")), ids)
    return stored(found.select(*ids, "node", F.col("component").alias("top")))


def _labelled(edges: DataFrame, labels: DataFrame, ids: list[str]) -> DataFrame:
    """``edges`` with the component of either end, the vertex itself where it has none."""
    for c in ("u", "v"):
        edges = edges.join(labels.select(*ids, F.col("node").alias(c), F.col("top").alias(f"{c}_top")), [*ids, c], "left")
        edges = edges.withColumn(f"{c}_top", F.coalesce(f"{c}_top", c))
    return edges


def _solved(edges: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """``(key, part, whole, w)`` of small subproblems, a task for each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["u"]) | set(rows["v"]))
        place = {x: i for i, x in enumerate(names)}
        tree = decompose_edges(names, rows["u"].map(place).to_numpy(np.int64), rows["v"].map(place).to_numpy(np.int64), rows["w"].to_numpy())
        least, found = list(range(len(names))), []
        for x in range(len(names), len(tree.parent)):  # children come before what they make
            own = sorted(least[c] for c in tree.children[x])
            least.append(own[0])
            found += [(names[part], names[own[0]], tree.weight[x]) for part in own[1:]]
        out = pd.DataFrame(found, columns=["part", "whole", "w"])
        out.insert(0, "key", rows["key"].iloc[0])
        return out

    return edges.groupBy(*_ID).applyInPandas(run, f"key {kinds[0]}, part {kinds[1]}, whole {kinds[1]}, w double")


def merges(sim: DataFrame, key: str = "network", increasing: bool = False, small: int = SMALL) -> DataFrame:
    """``(key, part, whole, weight)`` of weighted edges ``(key, src, dst, w)``: the hierarchy, a row for each vertex but one in each strong component.

    A cluster is named by its smallest vertex. At ``weight`` the cluster ``part`` becomes part of the one
    then named ``whole``, and its name ends; ``clusters`` reads partitions from that. Weights that are 0, null or no number,
    loops, and edges with a null end or key are no edges; of repeated edges the heaviest counts (with ``increasing`` the lightest).
    Every strong component of the network has a tree of its own.
    """
    kinds = sim.schema[key].dataType.simpleString(), sim.schema["src"].dataType.simpleString()
    w = F.col("w").cast("double")
    rows = sim.select(F.col(key).alias("key"), F.col("src").alias("u"), F.col("dst").alias("v"), (-w if increasing else w).alias("w"))
    rows = rows.where("key is not null and u <> v and w <> 0 and not isnan(w)").groupBy("key", "u", "v").agg(F.max("w").alias("w"))
    first = stored(rows)
    labels = _strong(first, ["key"])
    inside = _labelled(first, labels, ["key"]).where("u_top = v_top")
    now = stored(inside.select("key", F.col("u_top").alias("root"), F.lit(float("-inf")).alias("bound"), "u", "v", "w"))
    dropped(labels)
    dropped(first)
    found = []
    while not now.isEmpty():
        # weights of each subproblem, once; subproblems are disjoint, so there are at most edges / small large ones
        levels = stored(now.groupBy(*_ID, "w").agg(F.count(F.lit(1)).alias("n")))
        halves = levels.groupBy(*_ID).agg(F.min("w").alias("low"), F.max("w").alias("high"), F.percentile_approx("w", 0.5, 1000).alias("mid"), F.sum("n").alias("n"))
        large = halves.where(F.col("n") > small)
        upper = F.when(F.col("mid") > F.col("low"), F.col("w") >= F.col("mid")).otherwise(F.col("w") > F.col("low"))
        ends = levels.join(F.broadcast(large.drop("n")), _ID).withColumn("upper", upper).groupBy(*_ID)
        split = stored(ends.agg(F.max(F.when(~F.col("upper"), F.col("w"))).alias("below"), F.min(F.when(F.col("upper"), F.col("w"))).alias("above")))
        dropped(levels)
        dealt = stored(now.join(F.broadcast(split), _ID, "left"))
        dropped(now)
        dropped(split)
        alone = dealt.where("above is null and below is not null")  # one weight: everything meets at it
        names = alone.select("key", "root", "w", F.explode(F.array("u", "v")).alias("part")).where("part <> root").distinct()
        solved = _solved(dealt.where("below is null").select(*_ID, "u", "v", "w"), kinds)
        found.append(stored(solved.unionByName(names.select("key", "part", F.col("root").alias("whole"), "w"))))
        open_ = dealt.where("above is not null")
        if open_.isEmpty():
            dropped(dealt)
            break
        labels = _strong(open_.where("w >= above"), _ID)
        tops = stored(_labelled(open_, labels, _ID))
        dropped(labels)
        dropped(dealt)
        up = tops.where("u_top = v_top and w >= above").select("key", F.col("u_top").alias("root"), F.col("above").alias("bound"), "u", "v", "w")
        down = tops.where("u_top <> v_top").groupBy(*_ID, F.col("u_top").alias("u"), F.col("v_top").alias("v")).agg(F.max(F.least("w", "below")).alias("w"))
        now = stored(up.unionByName(down))
        dropped(tops)
    if not found:
        return sim.sparkSession.createDataFrame([], f"{key} {kinds[0]}, part {kinds[1]}, whole {kinds[1]}, weight double")
    weight = -F.col("w") if increasing else F.col("w")
    return reduce(DataFrame.unionByName, found).select(F.col("key").alias(key), "part", "whole", weight.alias("weight"))


def clusters(hierarchy: DataFrame, delta: float, key: str = "network", increasing: bool = False) -> DataFrame:
    """``(key, node, component)`` at a threshold, of every vertex in a cluster of two or more, from the table of ``merges``."""
    weight = F.col("weight")
    joined = hierarchy.where(weight <= delta if increasing else weight >= delta)
    end = lambda c: F.struct(F.col(key), F.col(c).alias("node"))
    found = connected_components(joined.select(end("part").alias("u"), end("whole").alias("v")))
    return found.select(f"node.{key}", "node.node", F.col("component.node").alias("component"))
