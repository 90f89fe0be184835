"""Heat: a score for each node, from scores, mutations or tables of driver significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = 100.0  #: fixed value: what an unlisted score is replaced by


def _scalar(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the columns of a one-row aggregate."""
    return table.crossJoin(F.broadcast(rows))


def filter_heat(heat: DataFrame, min_score: float | None = None, zero_genes: bool = False) -> DataFrame:
    """Scores of at least ``min_score`` (none or 0: the least positive score, an error without one).

    The others are dropped, or set to 0 with ``zero_genes``.
    """
    if min_score:
        bound, table = F.lit(float(min_score)), heat
    else:
        least = heat.agg(F.min(F.when(F.col("score") > 0, F.col("score"))).alias("least"))
        table = _scalar(heat, least)
        bound = F.coalesce("least", F.raise_error(F.lit("no positive score")).cast("double"))
    if zero_genes:
        return table.select("node", F.when(F.col("score") >= bound, F.col("score")).otherwise(0.0).alias("score"))
    return table.where(F.col("score") >= bound).select("node", "score")


def filtered_nodes(heat: DataFrame, kept: DataFrame) -> DataFrame:
    return heat.join(kept.select("node"), "node", "left_anti").select("node")


def direct_heat(scores: DataFrame, min_score: float | None = None) -> DataFrame:
    """Heat from scores as they are; a negative one is an error."""
    checked = F.when(F.col("score") < 0, F.raise_error(F.lit("heat is negative")).cast("double")).otherwise(F.col("score"))
    return filter_heat(scores.select("node", checked.alias("score")), min_score, zero_genes=True)


def num_snvs() -> Column:
    return F.count_if((F.col("mut_type") == "snv") & F.col("valid"))


def num_cnas() -> Column:
    return F.count_if(F.col("mut_type").isin("amp", "del") & F.col("valid"))


def filter_cnas(cnas: DataFrame, threshold: float) -> DataFrame:
    """Flags each gene's copy number changes against its prevailing direction, all without one of that share.

    Rows are flagged, never removed. Only the counts of each gene are shuffled (summed in each task
    first) and joined back, so a gene with a third of all rows is no task of its own.
    """
    if not threshold > 0.5:
        raise ValueError("the threshold must be over 0.5")
    of = cnas.groupBy("gene").agg(F.count_if(F.col("mut_type") == "amp").alias("n_amp"), F.count_if(F.col("mut_type") == "del").alias("n_del"))
    total = F.col("n_amp") + F.col("n_del")
    right = F.when(F.col("n_amp") / total >= threshold, F.lit("amp")).when(F.col("n_del") / total >= threshold, F.lit("del")).otherwise(F.lit(""))
    sides = of.where(total > 0).select("gene", right.alias("side"))
    return cnas.join(sides, "gene", "left").select("sample", "gene", "mut_type", (F.col("valid") & F.coalesce(F.col("mut_type") == F.col("side"), F.lit(True))).alias("valid"))


def mutation_heat(genes: DataFrame, n_samples: int | DataFrame, snvs: DataFrame, cnas: DataFrame, min_freq: int = 1) -> DataFrame:
    """Share of samples that a gene is mutated in, 0 for genes without mutations.

    Genes with fewer than ``min_freq`` samples with single-nucleotide variants count only the others.
    Each (gene, sample) is brought down to two flags before anything is counted, so duplicates and
    heavily mutated samples cost nothing beyond the first pass. Mutations of unlisted genes are left out.
    """
    valid = snvs.unionByName(cnas).where("valid").join(genes.select("gene"), "gene", "left_semi")
    point = F.max(F.col("mut_type").isin("snv", "inactive_snv").cast("int")).alias("s")
    copy = F.max(F.col("mut_type").isin("amp", "del").cast("int")).alias("c")
    by_gene = valid.groupBy("gene", "sample").agg(point, copy).groupBy("gene").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("both"))
    table = genes.select("gene").distinct().join(by_gene, "gene", "left").na.fill(0)
    if isinstance(n_samples, DataFrame):
        table, n = _scalar(table, n_samples.toDF("n_samples")), F.col("n_samples")
    else:
        n = F.lit(n_samples)
    used = F.when(F.col("s") < min_freq, F.col("c")).otherwise(F.col("both"))
    return table.select(F.col("gene").alias("node"), (used / n).alias("score"))


def loaded_mutation_heat(snvs: DataFrame, cnas: DataFrame, genes: DataFrame | None = None, samples: DataFrame | None = None, cna_threshold: float | None = None, min_freq: int = 1) -> DataFrame:
    """Mutation heat with the defaults of absent lists: all genes, all samples, that occur at all."""
    flagged = filter_cnas(cnas, cna_threshold) if cna_threshold else cnas
    every = snvs.unionByName(flagged)
    genes = every.select("gene").distinct() if genes is None else genes
    n = (every.select("sample") if samples is None else samples.select("sample")).agg(F.countDistinct("sample").alias("n"))
    return mutation_heat(genes, n, snvs, flagged, min_freq)


def _log10(p: Column) -> Column:
    return -F.log10(F.when(p > 0, p).otherwise(F.raise_error(F.lit("a score of 0 has no logarithm")).cast("double")))


def fm_heat(scores: DataFrame, fm_threshold: float, cis_threshold: float = 0.01, cis: bool = False) -> DataFrame:
    """``(node, score, source)`` of (gene, fm, amp, del): minus the logarithm of the least score below its threshold."""
    fm = F.when(F.col("fm") < fm_threshold, F.col("fm")).otherwise(MISSING)
    if not cis:
        kept = scores.where(F.col("fm") < fm_threshold)
        return kept.select(F.col("gene").alias("node"), _log10(F.col("fm")).alias("score"), F.lit("fm").alias("source"))
    amp = F.when(F.col("amp") < cis_threshold, F.col("amp")).otherwise(MISSING)
    deletion = F.when(F.col("del") < cis_threshold, F.col("del")).otherwise(MISSING)
    table = scores.select("gene", fm.alias("fm"), amp.alias("amp"), deletion.alias("del")).withColumn("least", F.least("fm", "amp", "del"))
    source = F.when(F.col("least") == F.col("fm"), "fm").when(F.col("least") == F.col("amp"), "amp").otherwise("del")
    return table.where(F.col("least") < MISSING).select(F.col("gene").alias("node"), _log10(F.col("least")).alias("score"), source.alias("source"))


def mutsig_heat(scores: DataFrame, threshold: float = 1.0) -> DataFrame:
    return scores.where(F.col("qval") < threshold).select(F.col("gene").alias("node"), _log10(F.col("qval")).alias("score"))


def music_heat(scores: DataFrame, threshold: float = 1.0, max_heat: float = 15.0) -> DataFrame:
    """By the median of three rates; a median of 0 has the largest heat."""
    middle = F.array_sort(F.array("FDR_CT", "FDR_LRT", "FDR_FCPT"))[1]
    table = scores.select("gene", middle.alias("q")).where(F.col("q") < threshold)
    return table.select(F.col("gene").alias("node"), F.when(F.col("q") == 0, F.lit(float(max_heat))).otherwise(-F.log10(F.when(F.col("q") > 0, F.col("q")))).alias("score"))


def in_network(heat: DataFrame, nodes: DataFrame) -> DataFrame:
    return heat.join(nodes.select("node"), "node", "left_semi").select(heat.columns)


def reconciled(heat: DataFrame, tested: DataFrame) -> DataFrame:
    """Exactly the tested genes, 0 where they had no heat."""
    genes = tested.select(F.col(tested.columns[0]).alias("node")).distinct()
    return genes.join(heat.select("node", "score"), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def reconciled_counts(heat: DataFrame, tested: DataFrame) -> DataFrame:
    """``(removed, zeroed)``: untested genes with heat, and tested ones without."""
    genes = tested.select(F.col(tested.columns[0]).alias("node")).distinct()
    removed = heat.join(genes, "node", "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    return removed.crossJoin(genes.join(heat.select("node"), "node", "left_anti").agg(F.count(F.lit(1)).alias("zeroed")))
