"""Command line: ``python -m heatgraph.cli COMMAND``; ``@file`` reads arguments from a file."""

from __future__ import annotations

import argparse
import os
import shlex

from pyspark.sql import SparkSession

from heatgraph.operators import heat as heat_ops
from heatgraph.operators import network, permute
from heatgraph.plans import runs
from heatgraph.plans.lineage import cut
from heatgraph.sources import sinks, text


class Parser(argparse.ArgumentParser):
    """Argument files are split like a shell line, ``#`` lines skipped."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, fromfile_prefix_chars="@", **kwargs)

    def convert_arg_line_to_args(self, line: str) -> list[str]:
        return [] if line.lstrip().startswith("#") else shlex.split(line)


def parser() -> Parser:
    top = Parser(prog="heatgraph")
    commands = top.add_subparsers(dest="command", required=True, parser_class=Parser)

    def command(title: str, /, *required: str, **optional) -> Parser:
        made = commands.add_parser(title)
        for r in required:
            made.add_argument(f"--{r}", required=True)
        for key, value in optional.items():
            kind = {"type": type(value)} if value is not None and not isinstance(value, bool) else {}
            made.add_argument(f"--{key}", default=value, **(kind or ({"action": "store_true"} if value is False else {})))
        return made

    command("heat-scores", "scores", "output", min_score=0.0, genes=None, name=None)
    command("heat-mutation", "snvs", "cnas", "output", genes=None, samples=None, cna_threshold=0.0, min_freq=1, name=None, sample_types=None)
    command("heat-oncodrive", "fm", "amp", "deletion", "output", fm_threshold=0.2, cis_threshold=0.2, cis=False, genes=None, name=None)
    command("heat-mutsig", "scores", "output", threshold=1.0, genes=None, name=None)
    command("heat-music", "scores", "output", threshold=1.0, max_heat=15.0, genes=None, name=None)
    command("network", "edges", "index", "output", kind="restart", parameter=0.4, permutations=0, swaps=115.0, seed=0)
    command("create-network", "edges", "output", separator="\t")
    command("beta", "edges", "output", digits=2)
    run = command("run", "output", beta=0.4, network_permutations=20, heat_permutations=100, consensus_permutations=0, seed=0, min_cc_size=2, display_scores=None, display_names=None, output_hierarchy=False)
    run.add_argument("--network", nargs=3, action="append", metavar=("NAME", "INDEX", "EDGES"), required=True)
    run.add_argument("--heat", nargs=2, action="append", metavar=("NAME", "FILE"), required=True)
    run.add_argument("--permuted", nargs=2, action="append", metavar=("NAME", "PATH"), default=[], help="permuted networks as the command network stores them")
    run.add_argument("--deltas", nargs="*", type=float, default=[])
    deltas = command("deltas", "index", "edges", "heat", "output", beta=0.4, permutations=100, seed=0, statistic="max_cc_size", gene_lengths=None, gene_order=None, bmr=1e-6, sizes="5,10,15,20")
    deltas.add_argument("--kind", choices=("network", "heat", "mutations"), default="network")
    stored = command("consensus", "output", pval=0.01)
    given = stored.add_mutually_exclusive_group(required=True)
    given.add_argument("--directory", nargs="+")
    given.add_argument("--files", nargs="+")
    command("dendrogram", "index", "edges", "heat", "output", beta=0.4)
    return top


def _named_network(spark: SparkSession, index: str, edges: str):
    return network.canonical(text.indexed_edges(text.lines(spark, edges), text.node_index(text.lines(spark, index))))


def _write_heat(spark: SparkSession, found, args, listed: bool = True) -> None:
    if args.genes and listed:
        found = heat_ops.reconciled(found, text.names(text.lines(spark, args.genes)))
    parameters = {k: v for k, v in vars(args).items() if k != "command" and v is not None}
    sinks.write_json(args.output, sinks.heat_document(found, parameters))


def _mutation_tables(spark: SparkSession, args) -> dict:
    """What mutation permutations need, from the files that the heat document was made from, gene lengths and gene order."""
    found = text.heat_mutations(spark, args.heat)
    if found is None or not (args.gene_lengths and args.gene_order):
        raise ValueError("mutations are permuted for heat made from mutations, with gene lengths and gene order")
    every, types = found
    order = cut(text.gene_order(text.lines(spark, args.gene_order)))
    blocks = permute.cna_blocks(every.where("mut_type <> 'snv'"), order)
    return {"samples": types.select("sample"), "genes": text.gene_lengths(text.lines(spark, args.gene_lengths)), "blocks": blocks, "order": order, "bmr": args.bmr}


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    lines = lambda path: text.lines(spark, path)
    if args.command == "heat-scores":
        _write_heat(spark, heat_ops.direct_heat(text.node_scores(lines(args.scores)), args.min_score or None), args)
    elif args.command == "heat-mutation":
        genes = text.names(lines(args.genes)) if args.genes else None
        people = text.samples(lines(args.samples)) if args.samples else None
        found = heat_ops.loaded_mutation_heat(text.snvs(lines(args.snvs), genes, people), text.cnas(lines(args.cnas), genes, people), genes, people, args.cna_threshold or None, args.min_freq)
        _write_heat(spark, found, args, False)
    elif args.command == "heat-oncodrive":
        table = text.driver_scores(*(lines(p) for p in (args.fm, args.amp, args.deletion)))
        _write_heat(spark, heat_ops.fm_heat(table, args.fm_threshold, args.cis_threshold, args.cis).select("node", "score"), args)
    elif args.command == "heat-mutsig":
        _write_heat(spark, heat_ops.mutsig_heat(text.significance_scores(lines(args.scores)), args.threshold), args)
    elif args.command == "heat-music":
        _write_heat(spark, heat_ops.music_heat(text.test_rates(lines(args.scores)), args.threshold, args.max_heat), args)
    elif args.command == "network":
        edges = _named_network(spark, args.index, args.edges)
        network.stored_kernel(args.kind, edges, args.parameter, args.output)
        if args.permutations:
            made = cut(network.permuted(network.largest_component(edges), args.permutations, args.swaps, args.seed, report=True))
            sinks.save_permuted(made.drop("swaps"), os.path.join(args.output, "permuted"))
            sinks.write_json(os.path.join(args.output, "swaps.json"), {str(r["perm_id"]): r["swaps"] for r in made.select("perm_id", "swaps").distinct().collect()})
    elif args.command == "create-network":
        import pyspark.sql.functions as F

        parts = F.split("value", args.separator)
        rows = text.without_comments(lines(args.edges)).select(parts[0].alias("src"), F.trim(parts[1]).alias("dst"))
        index, edges = network.indexed(network.largest_component(network.canonical(rows)))
        sinks.write_edges(edges, index, args.output)
    elif args.command == "beta":
        edges = network.canonical(text.edge_ids(lines(args.edges)).toDF("src", "dst"))
        sinks.write_beta(args.output, network.balanced_beta(edges, args.digits).first()["beta"], args.digits)
    elif args.command == "run":
        settings = runs.Settings(beta=args.beta, network_permutations=args.network_permutations, heat_permutations=args.heat_permutations, seed=args.seed, min_size=args.min_cc_size, deltas=tuple(args.deltas))
        networks = {n: _named_network(spark, i, e) for n, i, e in args.network}
        heats = {n: text.heat_file(spark, f, f.endswith(".json"))[0] for n, f in args.heat}
        permuted_networks = {n: spark.read.parquet(path) for n, path in args.permuted}
        found, roles, chosen = runs.all_runs(networks, heats, settings, permuted=permuted_networks)
        parameters = {k: v for k, v in vars(args).items() if k != "command"}
        labels = text.display_names(lines(args.display_names)) if args.display_names else None
        display = text.node_scores(lines(args.display_scores)) if args.display_scores else None
        for r in found:
            path = dict(args.heat)[r.heat]
            mutations = text.heat_mutations(spark, path) if path.endswith(".json") else None
            folder = runs.write_run(r, args.output, parameters, heats[r.heat], networks[r.network], runs.Shown(labels, display, *(mutations or ())))
            if args.output_hierarchy:
                runs.write_hierarchy(networks[r.network], heats[r.heat], args.beta, os.path.join(folder, "hierarchy"))
        counts = runs.consensus.size_counts(roles)
        permuted = runs.permuted_consensus(networks, heats, settings, args.consensus_permutations) if args.consensus_permutations else None
        runs.write_consensus(roles, chosen, runs.consensus.consensus_statistics(counts, permuted, args.consensus_permutations), os.path.join(args.output, "consensus"), parameters)
    elif args.command == "deltas":
        sizes = tuple(int(k) for k in args.sizes.split(","))
        settings = runs.Settings(beta=args.beta, network_permutations=args.permutations, heat_permutations=args.permutations, seed=args.seed, max_sizes=sizes)
        mutations = _mutation_tables(spark, args) if args.kind == "mutations" else None
        scores = text.heat_file(spark, args.heat, args.heat.endswith(".json"))[0]
        found = runs.selected_deltas(_named_network(spark, args.index, args.edges), scores, settings, args.kind, args.statistic, mutations)
        sinks.write_json(args.output, {str(k): d for k, d in found.items()})
    elif args.command == "consensus":
        runs.stored_consensus(spark, args.directory or args.files, args.output, args.pval)
    elif args.command == "dendrogram":
        scores = text.heat_file(spark, args.heat, args.heat.endswith(".json"))[0]
        runs.write_hierarchy(_named_network(spark, args.index, args.edges), scores, args.beta, args.output)


def main() -> None:
    import sys

    run(SparkSession.builder.appName("heatgraph").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
