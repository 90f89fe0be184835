"""Heat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgraph.operators import heat as h
from heatgraph.queries import data, query
from heatgraph.queries.data import HEAT, MUT, flagged_sql, table


@query(f"with {HEAT} select node, score from heat")
def heat_mutation_freq(spark, sf_dir):
    return data.heat(spark, sf_dir)


@query(f"""with {flagged_sql(0.51)}, n as (select count(distinct sample) as n from mut)
  select s_suppkey as node, round(case when count(distinct case when mut_type = 'snv' then sample end) < 180 then count(distinct case when mut_type <> 'snv' and valid then sample end)
  else count(distinct case when valid then sample end) end / cast((select n from n) as double), 9) as score from supplier left join flg on gene = s_suppkey group by s_suppkey""")
def heat_mutation_minfreq(spark, sf_dir):
    snvs, cnas = data.split_mutations(spark, sf_dir)
    n = data.mutations(spark, sf_dir).agg(F.countDistinct("sample"))
    found = h.mutation_heat(data.genes(spark, sf_dir), n, snvs, h.filter_cnas(cnas, 0.51), 180)
    return found.select("node", F.round("score", 9).alias("score"))


@query(f"with {flagged_sql(0.51)} select gene, mut_type, valid, count(*) as n from flg where mut_type <> 'snv' group by all")
def cna_filter_flags(spark, sf_dir):
    return h.filter_cnas(data.split_mutations(spark, sf_dir)[1], 0.51).groupBy("gene", "mut_type", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {flagged_sql(0.51)} select gene, count(*) filter (where mut_type = 'snv') as snvs, count(*) filter (where mut_type <> 'snv' and valid) as cnas from flg group by gene")
def cna_filter_counts(spark, sf_dir):
    snvs, cnas = data.split_mutations(spark, sf_dir)
    every = snvs.unionByName(h.filter_cnas(cnas, 0.51))
    return every.groupBy("gene").agg(h.num_snvs().alias("snvs"), h.num_cnas().alias("cnas"))


def _balances(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("score"))


@query("select s_suppkey as node, case when s_acctbal >= 5000 then s_acctbal else 0.0 end as score from supplier")
def heat_filter_zero(spark, sf_dir):
    return h.filter_heat(_balances(spark, sf_dir), 5000, zero_genes=True)


@query("select s_suppkey as node, s_acctbal as score from supplier where s_acctbal >= 5000")
def heat_filter_drop(spark, sf_dir):
    return h.filter_heat(_balances(spark, sf_dir), 5000)


@query("select s_suppkey as node, s_acctbal as score from supplier where s_acctbal >= (select min(s_acctbal) from supplier where s_acctbal > 0)")
def heat_filter_auto_min(spark, sf_dir):
    return h.filter_heat(_balances(spark, sf_dir))


@query("select s_suppkey as node from supplier where s_acctbal < 5000")
def heat_filter_removed(spark, sf_dir):
    scores = _balances(spark, sf_dir)
    return h.filtered_nodes(scores, h.filter_heat(scores, 5000))


@query("select s_suppkey as node, case when abs(s_acctbal) >= 2000 then abs(s_acctbal) else 0.0 end as score from supplier")
def heat_direct(spark, sf_dir):
    return h.direct_heat(_balances(spark, sf_dir).withColumn("score", F.abs("score")), 2000)


_RATES = """s as (select l_suppkey as gene, round(avg(l_discount), 6) as fm, round(avg(l_tax), 6) as amp,
  round(avg(case when l_returnflag = 'R' then 0.1 else 0.02 end), 6) as del from lineitem group by l_suppkey)"""


def _rates(spark, sf_dir):
    returned = F.when(F.col("l_returnflag") == "R", 0.1).otherwise(0.02)
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gene"))
    return grouped.agg(F.round(F.avg("l_discount"), 6).alias("fm"), F.round(F.avg("l_tax"), 6).alias("amp"), F.round(F.avg(returned), 6).alias("del"))


@query(f"with {_RATES} select gene as node, round(-log10(fm), 9) as score, 'fm' as source from s where fm < 0.05")
def heat_oncodrive_fm(spark, sf_dir):
    return h.fm_heat(_rates(spark, sf_dir), 0.05).withColumn("score", F.round("score", 9))


_CIS = f"""{_RATES}, c as (select gene, case when fm < 0.049 then fm else 100 end as fm, case when amp < 0.04 then amp else 100 end as amp, case when del < 0.04 then del else 100 end as del from s),
  o as (select gene as node, round(-log10(least(fm, amp, del)), 9) as score, case when fm <= least(amp, del) then 'fm' when amp <= del then 'amp' else 'del' end as source from c where least(fm, amp, del) < 100)"""


@query(f"with {_CIS} select * from o")
def heat_oncodrive_cis(spark, sf_dir):
    return h.fm_heat(_rates(spark, sf_dir), 0.049, 0.04, cis=True).withColumn("score", F.round("score", 9))


@query(f"with {_CIS} select source, count(*) as n from o group by source")
def heat_oncodrive_source_counts(spark, sf_dir):
    return h.fm_heat(_rates(spark, sf_dir), 0.049, 0.04, cis=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_RATES} select gene as node, round(-log10(amp), 9) as score from s where amp < 0.04")
def heat_mutsig(spark, sf_dir):
    return h.mutsig_heat(_rates(spark, sf_dir).select("gene", F.col("amp").alias("qval")), 0.04).withColumn("score", F.round("score", 9))


@query(f"""with {_RATES}, m as (select gene, list_sort([fm, amp, case when gene % 7 = 0 then 0 else del end])[2] as q from s),
  z as (select gene, case when gene % 21 = 0 then 0 else q end as q from m)
  select gene as node, round(case when q = 0 then 15 else -log10(nullif(q, 0)) end, 9) as score from z where q < 0.045""")
def heat_music_median(spark, sf_dir):
    zero = (F.col("gene") % 21) == 0
    s = _rates(spark, sf_dir)
    rates = s.select("gene", F.when(zero, 0.0).otherwise(F.col("fm")).alias("FDR_CT"), F.when(zero, 0.0).otherwise(F.col("amp")).alias("FDR_LRT"), F.when((F.col("gene") % 7) == 0, 0.0).otherwise(F.col("del")).alias("FDR_FCPT"))
    return h.music_heat(rates, 0.045).withColumn("score", F.round("score", 9))


@query("select s_suppkey as node, s_acctbal as score from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49 and l_discount > 0.09)")
def heat_network_semi(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("node"))
    return h.in_network(_balances(spark, sf_dir), nodes)


@query("select distinct l_partkey as node, coalesce(s_acctbal, 0.0) as score from lineitem left join supplier on s_suppkey = l_partkey where l_partkey % 3 = 0")
def heat_reconcile_tested(spark, sf_dir):
    return h.reconciled(_balances(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select("l_partkey"))


@query("""with t as (select distinct l_partkey as node from lineitem where l_partkey % 3 = 0)
  select (select count(*) from supplier where s_suppkey not in (select node from t)) as removed, (select count(*) from t where node not in (select s_suppkey from supplier)) as zeroed""")
def heat_reconcile_counts(spark, sf_dir):
    return h.reconciled_counts(_balances(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select("l_partkey"))


@query(f"""with {MUT}, n as (select count(distinct sample) as n from mut)
  select gene as node, round(count(distinct sample) / cast((select n from n) as double), 9) as score from mut group by gene""")
def heat_mutation_loaded(spark, sf_dir):
    found = h.loaded_mutation_heat(*data.split_mutations(spark, sf_dir))
    return found.select("node", F.round("score", 9).alias("score"))
