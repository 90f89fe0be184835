"""Queries of what the result pages show; components are suppliers five by five."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgraph.operators import view
from heatgraph.queries import consensus, data, query
from heatgraph.queries.data import HEAT, MUT, net_sql, table

MEMBERS = "members as (select s_suppkey // 5 as component, s_suppkey as node from supplier)"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 5").alias("component"), F.col("s_suppkey").alias("node"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label"))


@query(f"with {MEMBERS} select component, coalesce(case when node % 2 = 0 then s_name end, node::varchar) as name, case when s_acctbal > 1000 then s_acctbal else -1 end as value from members join supplier on s_suppkey = node")
def viz_nodes(spark, sf_dir):
    scores = table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score"))
    return view.nodes(_members(spark, sf_dir), scores, _labels(spark, sf_dir)).withColumn("value", F.when(F.isnan("value"), -1.0).otherwise(F.col("value")))


@query(f"with {MEMBERS}, {net_sql(10)} select a.component, src as source, dst as target from net join members a on a.node = src join members b on b.node = dst and a.component = b.component")
def viz_edges(spark, sf_dir):
    return view.edges(_members(spark, sf_dir), data.net(spark, sf_dir, 10))


@query(f"""with {MEMBERS}, {MUT}, n as (select count(distinct sample) as total from mut)
  select component, count(distinct sample) as n, printf('%d (%.2f%%)', count(distinct sample), count(distinct sample) * 100.0::double / (select total from n)) as coverage from members left join mut on gene = node group by component""")
def viz_coverage(spark, sf_dir):
    muts = data.mutations(spark, sf_dir)
    return view.coverage(_members(spark, sf_dir), muts, muts.select("sample").distinct().count())


@query(f"with {MEMBERS}, {MUT} select gene, sample, string_agg(mut_type, ',' order by mut_type) as types from mut where gene in (select node from members) group by gene, sample")
def viz_mutation_matrix(spark, sf_dir):
    return view.mutation_matrix(data.mutations(spark, sf_dir), _members(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@query(f"with {consensus.CHOSEN} select network, heat, delta, count(distinct component) as n from runs join chosen using (network, heat, delta) group by all")
def viz_run_summary(spark, sf_dir):
    return view.run_summary(*consensus._chosen(spark, sf_dir))


@query(f"with {MEMBERS}, {HEAT} select component, count(*) as size, round(sum(score), 4) as total from members join heat using (node) group by component having count(*) >= 2")
def viz_subnetwork_table(spark, sf_dir):
    return view.subnetwork_table(_members(spark, sf_dir), data.heat(spark, sf_dir))


@query(f"""with {MEMBERS}, {HEAT}, {net_sql(3)}, own as (select component, coalesce(case when node % 2 = 0 then s_name end, node::varchar) as name, score from members join supplier on s_suppkey = node left join heat using (node)),
  shown as (select component, count(*) as nodes, string_agg(name, ',' order by name) as names, round(sum(score), 6) as total from own group by component),
  links as (select a.component, count(*) as edges, string_agg(src || '-' || dst, ',' order by src || '-' || dst) as pairs from net join members a on a.node = src join members b on b.node = dst and a.component = b.component group by a.component)
  select s.component, nodes, names, total, coalesce(edges, 0) as edges, coalesce(pairs, '') as pairs from shown s left join links using (component)""")
def viz_document_parts(spark, sf_dir):
    """What is read back from the JSON of ``viz_document``."""
    kind = "nodes array<struct<name string, value double>>, edges array<struct<source string, target string>>"
    read = viz_document(spark, sf_dir).select("component", F.from_json("json", kind).alias("d"))
    links = F.array_sort(F.transform("d.edges", lambda e: F.concat_ws("-", e["source"], e["target"])))
    total = F.round(F.aggregate("d.nodes", F.lit(0.0), lambda s, n: s + n["value"]), 6)
    return read.select(
        "component", F.size("d.nodes").cast("bigint").alias("nodes"), F.array_join(F.array_sort(F.transform("d.nodes", lambda n: n["name"])), ",").alias("names"),
        total.alias("total"), F.size("d.edges").cast("bigint").alias("edges"), F.array_join(links, ",").alias("pairs"),
    )


@query()
def viz_document(spark, sf_dir):
    return view.document(_members(spark, sf_dir), data.heat(spark, sf_dir), data.net(spark, sf_dir), _labels(spark, sf_dir))


@query()
def viz_first_merges(spark, sf_dir):
    from heatgraph.queries.network import hierarchy_linkage

    return view.first_merges(hierarchy_linkage(spark, sf_dir).drop("network"))
