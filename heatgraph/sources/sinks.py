"""Writers: line files and JSON documents of small results, Parquet bundles of kernels."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """The column ``value`` as one ordered text file in the folder ``path``."""
    rows.orderBy(*order).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_components(members: DataFrame, path: str) -> None:
    """``(members array<string>)``: a component a line, tab-joined, the largest first."""
    rows = members.select(F.concat_ws("\t", F.array_sort("members")).alias("value"), (-F.size("members")).alias("size"))
    write_lines(rows, path, "size", "value")


def write_significance(statistics: DataFrame, path: str) -> None:
    """``(size, observed, expected, pval)`` with a header."""
    rows = statistics.select(F.col("size").alias("Size"), F.col("expected").alias("Expected"), F.col("observed").alias("Actual"), F.col("pval").alias("p-value"))
    rows.orderBy("Size").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_names(genes: DataFrame, path: str) -> None:
    write_lines(genes.select(F.col(genes.columns[0]).alias("value")), path, "value")


def write_edges(edges: DataFrame, index: DataFrame, prefix: str) -> None:
    """Sorted ``u v`` of an indexed network, and sorted ``i gene``."""
    pair = edges.select("src_id", "dst_id", F.concat_ws("\t", "src_id", "dst_id").alias("value"))
    write_lines(pair, f"{prefix}_edge_list", "src_id", "dst_id")
    write_lines(index.select("node_id", F.concat_ws("\t", "node_id", "node").alias("value")), f"{prefix}_index_gene", "node_id")


def save_bundle(kernel: DataFrame, edges: DataFrame, parameters: dict, path: str, buckets: int = 16) -> None:
    """A network's kernel, edges and parameters as Parquet below one folder; a table is overwritten whole.

    The kernel lies in ``buckets`` by ``src``, one sorted file each, so joins of it with heat by seed need no shuffle of the kernel.
    """
    spark, name = kernel.sparkSession, f"bundle_{uuid.uuid4().hex}"
    dealt = kernel.select("src", *[c for c in kernel.columns if c != "src"]).repartition(buckets, "src")
    dealt.write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").option("path", f"{path}/kernel").saveAsTable(name)
    spark.sql(f"drop table {name}")  # its files stay
    layout = [(f.name, f.dataType.simpleString(), buckets) for f in dealt.schema.fields]
    spark.createDataFrame(layout, "name string, type string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    rows = [(k, json.dumps(v)) for k, v in parameters.items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").parquet(f"{path}/parameters")


def _bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The kernel of a bundle, with its buckets known to this session."""
    layout = spark.read.parquet(f"{path}/layout").collect()
    columns, name = ", ".join(f"`{r['name']}` {r['type']}" for r in layout), f"bundle_{uuid.uuid4().hex}"
    place = f"{path}/kernel".replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (src) sorted by (src) into {layout[0]['buckets']} buckets location '{place}'")
    return spark.table(name)


def load_bundle(spark: SparkSession, path: str, keys: tuple[str, ...] = ("kernel", "edges", "parameters")) -> dict:
    """The tables asked for, a kernel in its buckets; parameters as a dict."""
    found = {k: _bucketed(spark, path) if k == "kernel" else spark.read.parquet(f"{path}/{k}") for k in keys}
    if "parameters" in found:
        found["parameters"] = {r["name"]: json.loads(r["value"]) for r in found["parameters"].collect()}
    return found


def save_permuted(edges: DataFrame, path: str) -> None:
    """Permuted edge lists ``(perm_id, src, dst)``, a partition for each permutation."""
    edges.write.mode("overwrite").partitionBy("perm_id").parquet(path)


def _file(path: str):
    """The path in its file system, of any scheme, as the session's configuration names it."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.setWriteChecksum(False)
    return target, system


def output_folder(path: str) -> str:
    target, system = _file(path)
    system.mkdirs(target)
    return path


def write_text(path: str, text: str) -> None:
    """A small document, whole or not at all: written under another name beside its place, then renamed."""
    target, system = _file(path)
    draft = target.suffix(f".{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(draft, target):
        system.delete(draft, False)
        raise OSError(f"{path} could not be written")


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=4, sort_keys=True) + "\n")


def heat_document(heat: DataFrame, parameters: dict) -> dict:
    """The heat as a document; nodes are as many as the network's, which bounds it."""
    return {"parameters": parameters, "heat": {r["node"]: r["score"] for r in heat.collect()}}


def write_run(root: str, delta: float, parameters: dict, components: list[list[str]], statistics: dict, heat: dict | None = None) -> str:
    """One threshold's results: JSON, components and significance, and the heat if it came as a table."""
    folder = output_folder(os.path.join(root, f"delta_{delta}"))
    sizes: dict[int, int] = {}
    for c in components:
        sizes[len(c)] = sizes.get(len(c), 0) + 1
    if heat is not None:
        write_json(os.path.join(folder, "heat.json"), heat)
    write_json(os.path.join(folder, "results.json"), {"parameters": parameters, "sizes": sizes, "components": components, "statistics": statistics})
    write_text(os.path.join(folder, "components.txt"), "".join("\t".join(c) + "\n" for c in components))
    rows = "".join(f"{k}\t{s['expected']}\t{s['observed']}\t{s['pval']}\n" for k, s in sorted(statistics.items()))
    write_text(os.path.join(folder, "significance.txt"), "Size\tExpected\tActual\tp-value\n" + rows)
    return folder


def consensus_lines(linkers: list[str], consensus: list[dict], joiner: str = " ") -> str:
    """Linkers, then core and expansion of each subnetwork; the stand-alone form joins by commas."""
    head = "#Linkers\n" + joiner.join(linkers) + "\n" if joiner == " " else ""
    title = "#Core\tExpansion\n" if joiner == " " else "# Core\tExpansion\n"
    return head + title + "".join(f"{joiner.join(c['core'])}\t{joiner.join(c['expansion'])}\n" for c in consensus)


def write_consensus(root: str, linkers: list[str], consensus: list[dict], deltas: dict, statistics: dict, parameters: dict) -> None:
    output_folder(root)
    write_json(os.path.join(root, "subnetworks.json"), {"params": parameters, "deltas": deltas, "stats": statistics, "linkers": linkers, "consensus": consensus})
    write_text(os.path.join(root, "subnetworks.tsv"), consensus_lines(linkers, consensus))
    rows = "".join(f"{k}\t{s['observed']}\t{s['expected']}\t{s['pval']}\n" for k, s in sorted(statistics.items()))
    write_text(os.path.join(root, "stats.tsv"), "#Size\tObserved\tExpected\tp-value\n" + rows)


def write_beta(path: str, beta: float, digits: int) -> None:
    write_text(path, f"{beta:.{digits}f}\n")


def write_hierarchy(folder: str, linkage: list, labels: list[str], newick: str, parameters: dict) -> None:
    output_folder(folder)
    write_json(os.path.join(folder, "hierarchy.json"), {"Z": linkage, "labels": labels, "params": parameters})
    write_text(os.path.join(folder, "hierarchy.newick.txt"), newick + "\n")
