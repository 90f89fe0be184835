"""Readers of header-less text files, as DataFrame plans with fixed schemas.

Each loader is a parser of ``lines`` (columns ``value`` and the sortable ``line``), so it works on any
table of lines as on files. Where a file may repeat a key its last line wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MUTATION_TYPES = ("snv", "amp", "del", "inactive_snv", "fus")


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """``(value, line)`` of a text file; ``line`` orders rows as in the file, however it is split."""
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    found = spark.read.text(path).select("value", order.alias("line"))
    return without_comments(found) if comments else found


def without_comments(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("value").startswith("#"))


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def words(value: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(F.col(value), r"\s+", " ")), " ")


def tabs(value: str = "value") -> Column:
    """Tab columns of a line without the white space at its end, tabs included."""
    return F.split(F.regexp_replace(F.col(value), r"\s+$", ""), "\t")


def last_wins(rows: DataFrame, key: str, *values: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.max_by(v, "line").alias(v) for v in values])


def _pairs(rows: DataFrame, key: Column, value: Column, names: tuple[str, str]) -> DataFrame:
    return last_wins(rows.where(F.trim("value") != "").select("line", key.alias(names[0]), value.alias(names[1])), *names)


def node_index(rows: DataFrame) -> DataFrame:
    """``(node_id, node)`` of lines ``id name [ignored]``."""
    return _pairs(rows, words()[0].cast("int"), words()[1], ("node_id", "node"))


def indexed_edges(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``(src, dst)`` distinct named edges, orientation kept; an id that the index lacks is an error."""
    ids = rows.where(F.trim("value") != "").select(words()[0].cast("int").alias("a"), words()[1].cast("int").alias("b"))
    left, right = index.select(F.col("node_id").alias("a"), F.col("node").alias("src")), index.select(F.col("node_id").alias("b"), F.col("node").alias("dst"))
    named = ids.join(left, "a", "left").join(right, "b", "left")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("edge of an unknown node id")).cast("string"))
    return named.select(known("src").alias("src"), known("dst").alias("dst")).distinct()


def edge_ids(rows: DataFrame) -> DataFrame:
    """``(src_id, dst_id)`` of lines with two ids, comments skipped."""
    return without_comments(rows).where(F.trim("value") != "").select(words()[0].cast("int").alias("src_id"), words()[1].cast("int").alias("dst_id"))


def node_scores(rows: DataFrame) -> DataFrame:
    """``(node, score)``: heat, or scores for display."""
    return _pairs(rows, words()[0], words()[1].cast("double"), ("node", "score"))


def heat_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(node, score)`` of a heat document, and ``(parameter, value)``."""
    schema = "heat map<string,double>, parameters map<string,string>"
    found = spark.read.schema(schema).json(path, multiLine=True)
    return found.select(F.explode("heat").alias("node", "score")), found.select(F.explode("parameters").alias("parameter", "value"))


def heat_file(spark: SparkSession, path: str, is_json: bool) -> tuple[DataFrame, str]:
    """Heat and its name: of JSON the parameter ``name`` (else the file's stem), else the stem up to the first dot."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    if not is_json:
        return node_scores(lines(spark, path)), stem
    heat, parameters = heat_json(spark, path)
    named = parameters.where("parameter = 'name' and value is not null").first()
    return heat, named["value"] if named else stem


def network(edge_rows: DataFrame, index_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node)`` of the whole index, also those without an edge, and ``(src, dst)``."""
    index = node_index(index_rows)
    return index.select("node").distinct(), indexed_edges(edge_rows, index)


def heat_mutations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The mutations ``(sample, gene, mut_type, valid)`` that a heat document was made from, and ``(sample, type)``.

    None if its parameters name no mutation files. Without a file of types every sample is of type "Cancer".
    """
    named = {r["parameter"]: r["value"] for r in heat_json(spark, path)[1].collect()}
    if not (named.get("snvs") or named.get("cnas")):
        return None
    read = lambda key, parse: parse(lines(spark, named[key])) if named.get(key) else None
    genes, people = read("genes", names), read("samples", samples)
    parts = [read("snvs", lambda x: snvs(x, genes, people)), read("cnas", lambda x: cnas(x, genes, people))]
    parts = [p for p in parts if p is not None]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    types = read("sample_types", lambda x: sample_types(without_comments(x)))
    if types is None:
        types = (every if people is None else people).select("sample").distinct().withColumn("type", F.lit("Cancer"))
    return every, types


def display_names(rows: DataFrame) -> DataFrame:
    return _pairs(rows, tabs()[0], F.trim(tabs()[1]), ("node", "label"))


def names(rows: DataFrame) -> DataFrame:
    """``(gene)``: one name a line."""
    return rows.select(F.trim("value").alias("gene")).where("gene <> ''").distinct()


def gene_lengths(rows: DataFrame) -> DataFrame:
    return _pairs(rows, words()[0], words()[1].cast("bigint"), ("gene", "length"))


def gene_rates(rows: DataFrame) -> DataFrame:
    return _pairs(rows, words()[0], words()[1].cast("double"), ("gene", "bmr"))


def gene_order(rows: DataFrame) -> DataFrame:
    """``(chromo, pos, gene)``: a line is a chromosome, numbered from 0, its genes in order from 0."""
    numbered = rows.withColumn("chromo", F.row_number().over(Window.orderBy("line")) - 1)  # one row a chromosome
    return numbered.select("chromo", F.posexplode(words()).alias("pos", "gene")).where("gene <> ''")


def samples(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("value") != "").select(words()[0].alias("sample")).distinct()


def sample_types(rows: DataFrame) -> DataFrame:
    return _pairs(rows, words()[0], words()[1], ("sample", "type"))


def include(rows: DataFrame, column: str, whitelist: DataFrame | None) -> DataFrame:
    """Rows whose value is in the one-column whitelist; no whitelist, or an empty one, lets all pass."""
    if whitelist is None or whitelist.isEmpty():
        return rows
    listed = whitelist.select(F.col(whitelist.columns[0]).alias(column)).distinct()
    return rows.join(listed, column, "left_semi").select(rows.columns)


def _mutations(rows: DataFrame, genes: DataFrame | None, people: DataFrame | None) -> DataFrame:
    kept = include(include(rows, "gene", genes), "sample", people)
    return kept.select("sample", "gene", "mut_type", F.lit(True).alias("valid"))


def snvs(rows: DataFrame, genes: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """``(sample, gene, mut_type, valid)`` of tab lines ``sample gene...``; duplicates are kept."""
    found = without_comments(rows).select(tabs().alias("t"))
    found = found.select(F.col("t")[0].alias("sample"), F.explode(F.slice("t", 2, 1_000_000_000)).alias("gene"))
    return _mutations(found.withColumn("mut_type", F.lit("snv")), genes, people)


def inactivating_snvs(rows: DataFrame, genes: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Lines ``gene sample``."""
    found = without_comments(rows).where(F.trim("value") != "").select(words()[1].alias("sample"), words()[0].alias("gene"))
    return _mutations(found.withColumn("mut_type", F.lit("inactive_snv")), genes, people)


def mutation_type(token: Column) -> Column:
    return F.when(token.endswith("(A)"), "amp").when(token.endswith("(D)"), "del").otherwise(F.raise_error(F.concat(F.lit("unknown kind of mutation: "), token)).cast("string"))


def cnas(rows: DataFrame, genes: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Tab lines ``sample GENE(A) GENE(D)...``; a gene is what stands before the first bracket."""
    found = without_comments(rows).select(tabs().alias("t"))
    found = found.select(F.col("t")[0].alias("sample"), F.explode(F.slice("t", 2, 1_000_000_000)).alias("token"))
    found = found.select("sample", F.split("token", r"\(")[0].alias("gene"), mutation_type(F.col("token")).alias("mut_type"))
    return _mutations(found, genes, people)


def fusions(rows: DataFrame, genes: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """``(sample, gene1, gene2)``; with a gene list both genes are in it, or neither and the row goes; else an error."""
    found = without_comments(rows).where(F.trim("value") != "").select(*[words()[i].alias(n) for i, n in enumerate(("sample", "gene1", "gene2"))])
    found = include(found, "sample", people)
    if genes is None or genes.isEmpty():
        return found
    listed = genes.select(F.col(genes.columns[0]).alias("g")).distinct()
    for i in (1, 2):
        found = found.join(listed.select(F.col("g").alias(f"gene{i}"), F.lit(True).alias(f"in{i}")), f"gene{i}", "left")
    one = F.coalesce(F.col("in1"), F.lit(False)) != F.coalesce(F.col("in2"), F.lit(False))
    checked = F.when(one, F.raise_error(F.lit("fusion of a listed and an unlisted gene")).cast("string")).otherwise(F.col("gene1"))
    return found.select("sample", checked.alias("gene1"), "gene2", "in1").where("in1").select("sample", "gene1", "gene2")


def driver_scores(fm: DataFrame, amp: DataFrame, deletion: DataFrame) -> DataFrame:
    """``(gene, fm, amp, del)``, every gene of any table, 1 where it has no score.

    ``fm`` lines hold gene and p-value in columns 1 and 2, those without a number left out; the others
    the gene first and the q-value last.
    """
    fm = without_comments(fm).select("line", tabs().alias("t")).where(~F.col("t")[2].isin("", "-", "-0"))
    fm = last_wins(fm.select("line", F.col("t")[1].alias("gene"), F.col("t")[2].cast("double").alias("fm")), "gene", "fm")
    out = fm
    for rows, name in ((amp, "amp"), (deletion, "del")):
        cis = without_comments(rows).select("line", F.element_at(tabs(), 1).alias("gene"), F.element_at(tabs(), -1).cast("double").alias(name))
        out = out.join(last_wins(cis, "gene", name), "gene", "full_outer")
    return out.select("gene", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("fm", "amp", "del")])


def significance_scores(rows: DataFrame) -> DataFrame:
    """``(gene, pval, qval)``: first and last two tab columns."""
    found = without_comments(rows).select("line", F.element_at(tabs(), 1).alias("gene"), F.element_at(tabs(), -2).cast("double").alias("pval"), F.element_at(tabs(), -1).cast("double").alias("qval"))
    return last_wins(found, "gene", "pval", "qval")


def test_rates(rows: DataFrame) -> DataFrame:
    """``(gene, FDR_FCPT, FDR_LRT, FDR_CT)``: tab columns 0 and 10 to 12."""
    columns = [tabs()[10 + i].cast("double").alias(n) for i, n in enumerate(("FDR_FCPT", "FDR_LRT", "FDR_CT"))]
    found = without_comments(rows).select("line", tabs()[0].alias("gene"), *columns)
    return last_wins(found, "gene", "FDR_FCPT", "FDR_LRT", "FDR_CT")


def run_results(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """``(run, delta, components, statistics, parameters)`` of every ``<run>/delta_<d>/results.json`` below the roots, or of such files themselves."""
    schema = "components array<array<string>>, statistics map<string,struct<observed:bigint,expected:double,pval:double>>, parameters map<string,string>"
    paths = [r if r.endswith(".json") else f"{r}/*/delta*/results.json" for r in ([roots] if isinstance(roots, str) else roots)]
    found = spark.read.schema(schema).json(paths, multiLine=True)
    path = F.split(F.col("_metadata.file_path"), "/")
    delta = F.regexp_extract(F.element_at(path, -2), r"delta_?(.+)", 1).cast("double")
    return found.select(F.element_at(path, -3).alias("run"), delta.alias("delta"), "components", "statistics", "parameters")
