"""The text parsers, on lines made of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgraph.queries import data, query
from heatgraph.queries.data import MUT, table
from heatgraph.sources import text


def _lines(rows, *parts, order, sep="\t"):
    return rows.select(F.concat_ws(sep, *parts).alias("value"), F.struct(*order).alias("line"))


@query("select distinct c_nationkey as node_id, arg_max(c_name, c_custkey) over (partition by c_nationkey) as node from customer")
def scan_node_index(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return text.node_index(_lines(rows, "c_nationkey", F.regexp_replace("c_name", " ", "_"), F.lit("x"), order=["c_custkey"], sep="  "))


@query("""select distinct a.n_name as src, b.n_name as dst from supplier join nation a on a.n_nationkey = s_nationkey join nation b on b.n_nationkey = s_suppkey % 25""")
def scan_indexed_edges(spark, sf_dir):
    index = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node_id"), F.col("n_name").alias("node"))
    rows = table(spark, sf_dir, "supplier")
    return text.indexed_edges(_lines(rows, "s_nationkey", F.col("s_suppkey") % 25, F.lit(1), order=["s_suppkey"], sep=" "), index)


@query("select distinct c_mktsegment as node, arg_max(c_acctbal, c_custkey) over (partition by c_mktsegment) as score from customer")
def scan_node_scores(spark, sf_dir):
    return text.node_scores(_lines(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal"), order=["c_custkey"], sep=" "))


@query("select distinct c_nationkey::varchar as node, arg_max(c_name, c_custkey) over (partition by c_nationkey) as label from customer")
def scan_display_names(spark, sf_dir):
    return text.display_names(_lines(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", order=["c_custkey"]))


@query("select distinct p_brand as gene from part")
def scan_names(spark, sf_dir):
    return text.names(table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("value")))


@query("select p_partkey::varchar as gene, p_size::bigint as length from part")
def scan_gene_lengths(spark, sf_dir):
    return text.gene_lengths(_lines(table(spark, sf_dir, "part"), "p_partkey", "p_size", order=["p_partkey"]))


@query("select s_suppkey::varchar as gene, s_acctbal as bmr from supplier")
def scan_gene_rates(spark, sf_dir):
    return text.gene_rates(_lines(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", order=["s_suppkey"]))


@query("""with b as (select p_brand, row_number() over (order by p_brand) - 1 as chromo from part group by p_brand)
  select cast(chromo as integer) as chromo, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as integer) as pos, p_partkey::varchar as gene from part join b using (p_brand)""")
def scan_gene_order(spark, sf_dir):
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    rows = lists.select(F.array_join(F.transform("keys", lambda k: k.cast("string")), " ").alias("value"), F.struct("p_brand").alias("line"))
    return text.gene_order(rows)


@query("select distinct c_mktsegment as sample from customer")
def scan_samples(spark, sf_dir):
    return text.samples(_lines(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", order=["c_custkey"], sep=" "))


@query("select c_custkey::varchar as sample, c_mktsegment as type from customer")
def scan_sample_types(spark, sf_dir):
    return text.sample_types(_lines(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", order=["c_custkey"]))


def _mutation_lines(spark, sf_dir, kinds, token):
    found = data.mutations(spark, sf_dir).where(F.col("mut_type").isin(*kinds)).withColumn("token", token)
    per = found.groupBy("sample").agg(F.array_join(F.array_sort(F.collect_list("token")), "\t").alias("tokens"))
    lines = _lines(per, "sample", "tokens", order=["sample"])
    comment = spark.range(1).select(F.lit("#comment\t1").alias("value"), F.struct(F.lit(-1).cast("bigint").alias("sample")).alias("line"))
    return lines.union(comment)


_LISTED = "gene % 2 = 0 and sample % 5 > 0"


def _lists(spark, sf_dir):
    genes = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("gene"))
    people = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").cast("string").alias("sample"))
    return genes, people


@query(f"with {MUT} select sample::varchar as sample, gene::varchar as gene, mut_type, true as valid, count(*) as n from mut where mut_type = 'snv' and {_LISTED} group by all")
def unpivot_snvs(spark, sf_dir):
    lines = _mutation_lines(spark, sf_dir, ["snv"], F.col("gene").cast("string"))
    return text.snvs(lines, *_lists(spark, sf_dir)).groupBy("sample", "gene", "mut_type", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {MUT} select sample::varchar as sample, gene::varchar as gene, mut_type, true as valid, count(*) as n from mut where mut_type <> 'snv' and {_LISTED} group by all")
def parse_cna_tokens(spark, sf_dir):
    token = F.concat(F.col("gene").cast("string"), F.when(F.col("mut_type") == "amp", "(A)").otherwise("(D)"))
    lines = _mutation_lines(spark, sf_dir, ["amp", "del"], token)
    return text.cnas(lines, *_lists(spark, sf_dir)).groupBy("sample", "gene", "mut_type", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey::varchar as sample, l_suppkey::varchar as gene, 'inactive_snv' as mut_type, true as valid from lineitem")
def scan_inactivating_snvs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return text.inactivating_snvs(_lines(rows, "l_suppkey", "l_orderkey", order=["l_orderkey"], sep=" "))


@query("select l_orderkey::varchar as sample, (l_suppkey % 50)::varchar as gene1, (l_suppkey % 50 + 2)::varchar as gene2 from lineitem where l_suppkey % 2 = 0")
def fusion_whitelist(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_suppkey") % 50)
    listed = spark.range(0, 60, 2).select(F.col("id").cast("string").alias("gene"))
    return text.fusions(_lines(rows, "l_orderkey", "g", F.col("g") + 2, order=["l_orderkey"], sep=" "), listed)


@query("""with fm as (select s_suppkey::varchar as gene, abs(s_acctbal) / 10000 as fm from supplier where s_suppkey % 3 > 0),
  am as (select s_suppkey::varchar as gene, abs(s_acctbal) / 20000 as amp from supplier where s_suppkey % 2 = 0), de as (select s_suppkey::varchar as gene, abs(s_acctbal) / 40000 as del from supplier where s_suppkey % 5 = 0)
  select gene, coalesce(fm, 1.0) as fm, coalesce(amp, 1.0) as amp, coalesce(del, 1.0) as del from fm full join am using (gene) full join de using (gene)""")
def scan_driver_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("a", F.abs("s_acctbal"))
    number = F.when(F.col("s_suppkey") % 3 > 0, (F.col("a") / 10000).cast("string")).otherwise(F.lit("-"))
    fm = _lines(rows, F.lit("x"), "s_suppkey", number, order=["s_suppkey"])
    amp = _lines(rows.where("s_suppkey % 2 = 0"), "s_suppkey", F.lit("y"), F.col("a") / 20000, order=["s_suppkey"])
    deletion = _lines(rows.where("s_suppkey % 5 = 0"), "s_suppkey", F.col("a") / 40000, order=["s_suppkey"])
    return text.driver_scores(fm, amp, deletion)


@query("select s_suppkey::varchar as gene, abs(s_acctbal) / 10000 as pval, abs(s_acctbal) / 5000 as qval from supplier")
def scan_significance_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("a", F.abs("s_acctbal"))
    return text.significance_scores(_lines(rows, "s_suppkey", F.lit("-"), F.col("a") / 10000, F.col("a") / 5000, order=["s_suppkey"]))


@query("select s_suppkey::varchar as gene, abs(s_acctbal) / 10000 as \"FDR_FCPT\", abs(s_acctbal) / 5000 as \"FDR_LRT\", abs(s_acctbal) / 2500 as \"FDR_CT\" from supplier")
def scan_test_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("a", F.abs("s_acctbal"))
    filler = [F.lit("-") for _ in range(9)]
    return text.test_rates(_lines(rows, "s_suppkey", *filler, F.col("a") / 10000, F.col("a") / 5000, F.col("a") / 2500, order=["s_suppkey"]))
