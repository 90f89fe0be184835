"""Consensus of runs over several networks and heats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.operators.connected import connected_components
from heatgraph.plans.lineage import cut

SIZES = tuple(range(2, 11))


def chosen_deltas(statistics: DataFrame, pval: float = 0.01, min_size: int = 2) -> DataFrame:
    """``(network, heat, delta)``: of each run the threshold with fewest insignificant sizes, then the smallest."""
    counts = statistics.where(F.col("size") >= min_size).groupBy("network", "heat", "delta").agg(F.count_if(F.col("pval") > pval).alias("n"))
    rank = F.row_number().over(Window.partitionBy("network", "heat").orderBy("n", "delta"))
    return counts.withColumn("r", rank).where("r = 1").select("network", "heat", "delta")


def consensus_edges(members: DataFrame) -> DataFrame:
    """``(u, v, w)``: pairs in one component, and in how many distinct networks; members ``(network, heat, component, node)``.

    Components are bounded by the thresholds' choice, so their pairs are the consensus graph itself.
    """
    a = members.select("network", "heat", "component", F.col("node").alias("u"))
    b = members.select("network", "heat", "component", F.col("node").alias("v"))
    pairs = a.join(b, ["network", "heat", "component"]).where(F.col("u") < F.col("v"))
    return pairs.groupBy("u", "v").agg(F.countDistinct("network").alias("w"))


def node_classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, like)`` and ``(like, runs, n)``: nodes that are together in every run are one class, named by its smallest node.

    ``runs`` has the ``(network, heat, component)`` of the class, one for each run at most; all of a class's pairs and all its pairs with
    another class weigh the same, so the consensus graph follows from pairs of classes.
    """
    own = members.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("network", "heat", "component"))).alias("runs"))
    classes = cut(own.groupBy("runs").agg(F.min("node").alias("like"), F.count(F.lit(1)).alias("n")))
    return own.join(classes.select("runs", "like"), "runs").select("node", "like"), classes.select("like", "runs", "n")


def class_edges(classes: DataFrame) -> DataFrame:
    """``(u, v, w)`` as in ``consensus_edges`` between classes, and from a class of several nodes to itself."""
    each = classes.select("like", F.explode("runs").alias("run")).select("like", "run.network", "run.heat", "run.component")
    between = consensus_edges(each.withColumnRenamed("like", "node"))
    within = classes.where(F.col("n") > 1).select(F.col("like").alias("u"), F.col("like").alias("v"), F.size(F.array_distinct("runs.network")).cast("bigint").alias("w"))
    return between.unionByName(within)


def of_nodes(found: DataFrame, like: DataFrame) -> DataFrame:
    """Rows of classes, in ``node``, as rows of their nodes."""
    return found.withColumnRenamed("node", "like").join(like, "like").select(*found.columns)


def cores(edges: DataFrame, networks: int) -> DataFrame:
    """``(node, component)``: components of the edges found in every network."""
    return connected_components(edges.where(F.col("w") >= networks).select("u", "v"))


def roles(edges: DataFrame, core: DataFrame) -> DataFrame:
    """``(component, node, role)``: core, expansion (one strongest core) or linker (several, beyond one network)."""
    both = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    inner = core.select(F.col("node").alias("v"), "component")
    outer = both.join(core.select(F.col("node").alias("u")), "u", "left_anti").join(inner, "v")
    strongest = outer.groupBy("u", "component").agg(F.max("w").alias("m"))
    top = strongest.withColumn("r", F.rank().over(Window.partitionBy("u").orderBy(F.desc("m")))).where("r = 1")
    found = top.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"), F.min("component").alias("component"))
    one = found.where("n = 1").select("component", F.col("u").alias("node"), F.lit("expansion").alias("role"))
    several = found.where("n > 1 and m > 1").select(F.lit(None).cast(core.schema["component"].dataType).alias("component"), F.col("u").alias("node"), F.lit("linker").alias("role"))
    return core.select("component", "node", F.lit("core").alias("role")).unionByName(one).unionByName(several)


def size_counts(found: DataFrame, sizes=SIZES) -> DataFrame:
    """``(size, n)``: consensus subnetworks (core and expansion) of at least each size."""
    per = found.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    wanted = found.sparkSession.createDataFrame([(k,) for k in sizes], "size int")
    return wanted.join(F.broadcast(per), F.col("s") >= F.col("size"), "left").groupBy("size").agg(F.count("s").alias("n"))


def identified(members: DataFrame, statistics: DataFrame, pval: float = 0.01, min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """(roles, chosen thresholds) of runs ``(network, heat, delta, component, node)``."""
    deltas = chosen_deltas(statistics, pval, min_size)
    like, classes = node_classes(members.join(deltas, ["network", "heat", "delta"], "left_semi"))
    edges = cut(class_edges(classes))
    networks = deltas.select("network").distinct().count()
    return of_nodes(roles(edges, cores(edges, networks)), like), deltas


def consensus_statistics(real: DataFrame, permuted: DataFrame | None, n: int) -> DataFrame:
    """``(size, observed, expected, pval)``; without permutations nothing is expected and nothing significant."""
    from heatgraph.operators.permute import statistics

    if not n or permuted is None:
        return real.select("size", F.col("n").alias("observed"), F.lit(0.0).alias("expected"), F.lit(1.0).alias("pval"))
    return statistics(real, permuted, n)
