"""What the result pages show, as relations and as one JSON document for each run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(members: DataFrame, scores: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(component, name, value)``: display name, or the node itself; a missing score is NaN."""
    table = members.select("component", "node").join(scores.select("node", "score"), "node", "left")
    name = F.col("node").cast("string")
    if labels is not None:
        table, name = table.join(labels.select("node", "label"), "node", "left"), F.coalesce("label", F.col("node").cast("string"))
    return table.select("component", name.alias("name"), F.coalesce("score", F.lit(float("nan"))).alias("value"))


def edges(members: DataFrame, network: DataFrame) -> DataFrame:
    """``(component, source, target)``: network edges, either way round, inside a component."""
    pair = network.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target")).distinct()
    a = members.select(F.col("node").alias("source"), "component")
    b = members.select(F.col("node").alias("target"), "component")
    return pair.join(a, "source").join(b, ["target", "component"]).select("component", "source", "target")


def mutation_matrix(mutations: DataFrame, members: DataFrame) -> DataFrame:
    """``(gene, sample, types)`` of the genes in components, kinds sorted and repeated as they occur."""
    listed = members.select(F.col("node").alias("gene")).distinct()
    kept = mutations.join(listed, "gene", "left_semi")
    return kept.groupBy("gene", "sample").agg(F.array_sort(F.collect_list("mut_type")).alias("types"))


def coverage(members: DataFrame, mutations: DataFrame, n_samples: int) -> DataFrame:
    """``(component, n, coverage)``: samples with any mutation in a component, flagged or not."""
    hit = members.select("component", F.col("node").alias("gene")).join(mutations.select("gene", "sample"), "gene", "left")
    counted = hit.groupBy("component").agg(F.countDistinct("sample").alias("n"))
    return counted.select("component", "n", F.format_string("%d (%.2f%%)", "n", F.col("n") * 100.0 / n_samples).alias("coverage"))


def subnetwork_table(members: DataFrame, scores: DataFrame, min_size: int = 2) -> DataFrame:
    """``(component, size, total)``: components of some size with their heat, rounded to 4 places."""
    table = members.select("component", "node").join(scores, "node", "left")
    grouped = table.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("score"), 4).alias("total"))
    return grouped.where(F.col("size") >= min_size)


def run_summary(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """``(network, heat, delta, n)``: subnetworks at the chosen threshold; runs ``(network, heat, delta, component, node)``."""
    kept = runs.join(deltas, ["network", "heat", "delta"], "left_semi")
    return kept.groupBy("network", "heat", "delta").agg(F.countDistinct("component").alias("n"))


def document(members: DataFrame, scores: DataFrame, network: DataFrame, labels: DataFrame | None = None, display: DataFrame | None = None, mutations: DataFrame | None = None, n_samples: int = 0) -> DataFrame:
    """``(component, json)``: each component's nodes and edges, and with mutations its coverage of the samples.

    Nodes show the scores of ``display`` in place of the heat where it is given.
    """
    own = nodes(members, scores if display is None else display, labels).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("nodes"))
    links = edges(members, network).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("edges"))
    table = own.join(links, "component", "left")
    shown = ["nodes", F.coalesce("edges", F.array()).alias("edges")]
    if mutations is not None:
        table = table.join(coverage(members, mutations, n_samples).select("component", "coverage"), "component", "left")
        shown.append("coverage")
    return table.select("component", F.to_json(F.struct(*shown)).alias("json"))


def mutation_document(mutations: DataFrame, members: DataFrame, types: DataFrame) -> str:
    """The mutations of the genes in components by gene and sample, and each sample's type, as JSON."""
    matrix: dict = {}
    for r in mutation_matrix(mutations, members).collect():  # what one page shows
        matrix.setdefault(str(r["gene"]), {})[str(r["sample"])] = r["types"]
    kinds = {str(r["sample"]): r["type"] for r in types.select("sample", "type").collect()}
    return json.dumps({"geneToMutations": matrix, "sampleToType": kinds}, sort_keys=True)


def first_merges(linkage: DataFrame, most: int = 20) -> DataFrame:
    """Linkage rows ``(step, a, b, dist, size)`` before the drawing has more than ``most`` leaves."""
    leaves = F.count_if(F.col("a") >= 0).over(Window.orderBy("step"))  # one row a merge of one tree
    return linkage.withColumn("leaves", leaves + 1).where(F.col("leaves") <= most).drop("leaves")


def index_page(deltas: list[float]) -> str:
    """The list of thresholds as HTML."""
    rows = "".join(f'<li><a href="delta_{d:g}.html">{d:g}</a></li>' for d in sorted(deltas))
    return f"<html><body><ul>{rows}</ul></body></html>\n"
