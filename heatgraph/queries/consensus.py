"""Consensus queries, on runs made of shipments: networks by return flag, heats by line status."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgraph.operators import consensus as c
from heatgraph.operators import permute
from heatgraph.queries import query
from heatgraph.queries.data import closure_sql, table

RUNS = """runs as materialized (select l_returnflag as network, l_linestatus as heat, l_linenumber * 0.5::double as delta,
    (l_suppkey + case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end * (l_suppkey // 20 % 2)) // 4 as component, l_suppkey as node
    from lineitem group by 1, 2, 3, l_suppkey having count(*) >= 12)"""
STATS = """stats as materialized (select network, heat, delta, size, round(size / (size + count(n)), 6) as pval from (select distinct network, heat, delta from runs)
    cross join (select unnest([2, 3, 4, 5]) as size) left join (select network, heat, delta, component, count(*) as n from runs group by all) using (network, heat, delta) where n >= size - 1 group by network, heat, delta, size)"""


def _runs(spark, sf_dir):
    keys = [F.col("l_returnflag").alias("network"), F.col("l_linestatus").alias("heat"), (F.col("l_linenumber") * 0.5).alias("delta")]
    grouped = table(spark, sf_dir, "lineitem").groupBy(*keys, "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    code = F.when(F.col("network") == "N", 0).when(F.col("network") == "A", 1).otherwise(2)
    place = F.col("l_suppkey") + code * (F.expr("l_suppkey div 20") % 2)
    return grouped.select("network", "heat", "delta", F.floor(place / 4).alias("component"), F.col("l_suppkey").alias("node"))


def _stats(runs):
    sizes = runs.groupBy("network", "heat", "delta", "component").agg(F.count(F.lit(1)).alias("n"))
    wide = sizes.withColumn("size", F.explode(F.array(*map(F.lit, (2, 3, 4, 5))))).where("n >= size - 1")
    return wide.groupBy("network", "heat", "delta", "size").agg(F.round(F.col("size") / (F.col("size") + F.count("n")), 6).alias("pval"))


_T = 0.12
CHOSEN = f"""{RUNS}, {STATS}, chosen as materialized (select network, heat, delta from (select *, row_number() over (partition by network, heat order by n, delta) as r
    from (select network, heat, delta, count(*) filter (where pval > {_T}) as n from stats where size >= 2 group by all)) where r = 1)"""
EDGES = f"""{CHOSEN}, m as (select runs.* from runs join chosen using (network, heat, delta)), ce as materialized (select a.node as u, b.node as v, count(distinct a.network) as w
    from m a join m b on a.network = b.network and a.heat = b.heat and a.component = b.component and a.node < b.node group by 1, 2)"""
CORES = f"""{EDGES}, ke as materialized (select u as src, v as dst from ce where w >= (select count(distinct network) from chosen)), kw as materialized (select src, dst from ke union select dst, src from ke),
    {closure_sql("kw", "r")}, core as materialized (select a as node, min(b) as component from r group by a)"""
ROLES = f"""{CORES}, ways as (select u, v, w from ce union all select v, u, w from ce), outer_w as (select ways.u, core.component, max(w) as m from ways join core on core.node = ways.v where ways.u not in (select node from core) group by 1, 2),
    top as (select *, rank() over (partition by u order by m desc) as r from outer_w), found as (select u, count(*) as n, max(m) as m, min(component) as component from top where r = 1 group by u),
    roles as materialized (select component, node, 'core' as role from core union all select component, u, 'expansion' from found where n = 1 union all select null, u, 'linker' from found where n > 1 and m > 1)"""


def _chosen(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs, c.chosen_deltas(_stats(runs), _T)


def _edges(spark, sf_dir):
    runs, chosen = _chosen(spark, sf_dir)
    return c.consensus_edges(runs.join(chosen, ["network", "heat", "delta"], "left_semi"))


@query(f"with {CHOSEN} select * from chosen")
def consensus_choose_delta(spark, sf_dir):
    return _chosen(spark, sf_dir)[1]


@query(f"with {EDGES} select u, v, w from ce")
def consensus_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"with recursive {CORES} select node, component from core")
def consensus_cores(spark, sf_dir):
    runs, chosen = _chosen(spark, sf_dir)
    like, classes = c.node_classes(runs.join(chosen, ["network", "heat", "delta"], "left_semi"))
    return c.of_nodes(c.cores(c.class_edges(classes), 3), like)


@query(f"with recursive {ROLES} select component, node, role from roles")
def consensus_roles(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return c.identified(runs, _stats(runs), _T)[0]


_COUNTS = "counts as (select k.size, count(s) as n from (select unnest([2, 3, 4, 5, 6, 7, 8, 9, 10]) as size) k left join (select count(*) as s from roles where component is not null group by component) on s >= k.size group by k.size)"


@query(f"with recursive {ROLES}, {_COUNTS} select size, n from counts")
def consensus_size_counts(spark, sf_dir):
    return c.size_counts(consensus_roles(spark, sf_dir))


@query(f"""with recursive {ROLES}, {_COUNTS}, p as (select perm_id, size, (size * perm_id) % 7 as n from counts cross join (select unnest([1, 2, 3, 4]) as perm_id))
  select size, counts.n as observed, sum(p.n) / 4.0::double as expected, count(*) filter (where p.n >= counts.n) / 4.0::double as pval from counts join p using (size) group by size, counts.n""")
def consensus_stats(spark, sf_dir):
    real = consensus_size_counts(spark, sf_dir)
    made = real.select("size", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("perm_id")).withColumn("n", F.col("size") * F.col("perm_id") % 7)
    return c.consensus_statistics(real, made, 4)


@query("select l_linenumber as size, count(*) as observed, round(sum(l_quantity) / 50, 6) as expected, round(count(*) filter (where l_quantity >= 25) / 50.0::double, 6) as pval from lineitem group by l_linenumber")
def permutation_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    real = rows.groupBy(F.col("l_linenumber").alias("size")).agg(F.count(F.lit(1)).alias("real"))
    permuted = rows.select(F.col("l_linenumber").alias("size"), F.col("l_quantity").alias("n"))
    found = permute.statistics(real.select("size", F.lit(25).alias("n")), permuted, 50).join(real, "size")
    return found.select("size", F.col("real").alias("observed"), F.round("expected", 6).alias("expected"), F.round("pval", 6).alias("pval"))
