"""Views of the star schema as nodes, edges, heat and mutations, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgraph.plans.lineage import cut

BETA = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a task that aggregates, joins or sorts them.
LINES = 250_000


def tasks(lines: DataFrame) -> int:
    """Tasks for a table, by its rows, so that what each holds doesn't grow with it."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, 1 + lines.count() // LINES)


KIND_SQL = "case l_returnflag when 'N' then 'snv' when 'A' then 'amp' else 'del' end"
MUT = f"mut as (select o_custkey as sample, l_suppkey as gene, {KIND_SQL} as mut_type from lineitem join orders on l_orderkey = o_orderkey)"
SHARE = "share as (select gene, count(*) filter (where mut_type = 'amp') as a, count(*) filter (where mut_type = 'del') as d from mut group by gene)"


def flagged_sql(threshold: float) -> str:
    return f"""{MUT}, {SHARE}, flg as (select m.*, case when mut_type = 'snv' or a + d is null or a + d = 0 then true
      when a / cast(a + d as double) >= {threshold} then mut_type = 'amp' when d / cast(a + d as double) >= {threshold} then mut_type = 'del' else false end as valid
      from mut m left join share using (gene))"""


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "snv").when(F.col("l_returnflag") == "A", "amp").otherwise("del")
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", F.col("l_suppkey").alias("gene"), kind.alias("mut_type")).repartition(tasks(lines), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    return lines.join(orders, "l_orderkey").select("sample", "gene", "mut_type", F.lit(True).alias("valid"))


def split_mutations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = mutations(spark, sf_dir)
    return every.where("mut_type = 'snv'"), every.where("mut_type <> 'snv'")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"))


def net_sql(k: int, name: str = "net") -> str:
    return f"""{name} as materialized (select least(u, v) as src, greatest(u, v) as dst from (select u, v, row_number() over (partition by u order by n desc, v) as rk from (
      select a.l_suppkey as u, b.l_suppkey as v, count(distinct a.l_orderkey) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
      where a.l_suppkey <> b.l_suppkey group by 1, 2)) where rk <= {k} group by 1, 2)"""


def net(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Each supplier with the ``k`` suppliers that share most orders with it."""
    lines = table(spark, sf_dir, "lineitem")
    parts = tasks(lines)
    items = lines.select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey").distinct()
    pairs = items.select("l_orderkey", F.col("l_suppkey").alias("u")).join(items.select("l_orderkey", F.col("l_suppkey").alias("v")), "l_orderkey").where("u <> v")
    pairs = pairs.select("u", "v").repartition(4 * parts, "u")  # about three for each line; counts and ranks then stay where they are
    counted = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))
    best = counted.withColumn("rk", rank).where(F.col("rk") <= k)
    return best.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


PARTS = "parts as materialized (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_quantity = b.l_quantity and a.l_partkey < b.l_partkey)"


def parts_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an order has in the same quantity: many components."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.col("l_partkey").alias("src")).distinct()
    return items.join(items.withColumnRenamed("src", "dst"), ["l_orderkey", "l_quantity"]).where("src < dst").select("src", "dst").distinct()


def closure_sql(edges: str, name: str, keys: str = "") -> str:
    """Reachability ``name(keys, a, b)`` along ``edges(keys, src, dst)``, each vertex from itself."""
    k = "".join(f"{x}, " for x in keys.split(",") if x)
    rk = "".join(f"r.{x}, " for x in keys.split(",") if x)
    on = "".join(f" and r.{x} = e.{x}" for x in keys.split(",") if x)
    return f"{name}({k}a, b) as (select {k}src, src from {edges} union select {k}dst, dst from {edges} union select {rk}r.a, e.dst from {name} r join {edges} e on r.b = e.src{on})"


HEAT = f"""{flagged_sql(0.51)}, heat as materialized (select s_suppkey as node, round(count(distinct case when valid then sample end) / cast((select count(distinct sample) from mut) as double), 9) as score
  from supplier left join flg on gene = s_suppkey group by s_suppkey)"""


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heatgraph.operators import heat as h

    snvs, cnas = split_mutations(spark, sf_dir)
    n = mutations(spark, sf_dir).agg(F.countDistinct("sample"))
    found = h.mutation_heat(genes(spark, sf_dir), n, snvs, h.filter_cnas(cnas, 0.51))
    return found.select("node", F.round("score", 9).alias("score"))


def kernel_sql(beta: float = BETA, terms: int = 70, edges: str = "net") -> str:
    """The restart kernel as an unrolled Neumann series."""
    steps = "".join(
        f", k{i} as materialized (select w.dst, k.src, sum({1 - beta} * w.w * k.p) as p from k{i - 1} k join walk w on w.src = k.dst group by w.dst, k.src)"
        for i in range(1, terms + 1)
    )
    union = " union all ".join(f"select * from k{i}" for i in range(terms + 1))
    return f"""ways as (select src, dst from {edges} union all select dst, src from {edges}), degree as (select src as node, count(*) as degree from ways group by src),
      walk as materialized (select dst, src, 1.0::double / degree as w from ways join degree on node = src),
      k0 as (select node as dst, node as src, {beta}::double as p from degree){steps},
      kernel as materialized (select dst, src, round(sum(p), 6) as p from ({union}) group by dst, src)"""


def kernel(spark: SparkSession, sf_dir: str, least: float | None = None, **kind) -> DataFrame:
    """With ``least`` only entries of at least that: the others never leave the arrays that they are found in."""
    from heatgraph.operators.network import restart_kernel

    return restart_kernel(net(spark, sf_dir), BETA, places=6, least=least, **kind)


def reaching(heat: DataFrame, delta: float) -> float:
    """Kernel entries below this have less than ``delta`` with any score, as rounded as :func:`kernel` has them."""
    most = heat.agg(F.max("score")).first()[0] or 0.0
    return delta / most * (1 - 1e-6) - 1e-6 if most > 0 else float("inf")


SIM = f"{HEAT}, {net_sql(3)}, {kernel_sql()}, sim as materialized (select k.src, k.dst, p * h.score as w from kernel k join heat h on h.node = k.src)"
DELTA = 0.02


def sim(spark: SparkSession, sf_dir: str, delta: float | None = None) -> DataFrame:
    from heatgraph.operators.similarity import similarity

    own = heat(spark, sf_dir)
    if delta is None:
        return similarity(kernel(spark, sf_dir), own)
    own = cut(own)
    return similarity(kernel(spark, sf_dir, reaching(own, delta)), own, delta=delta)


SCC = f"{SIM}, e as materialized (select src, dst from sim where w >= {DELTA}), {closure_sql('e', 'r')}, scc as materialized (select x.a as node, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a)"


def levels_sql(rounds: int = 10) -> str:
    """``m(a, b, w)``: the highest threshold at which two vertices are in one strong component; paths of up to ``2 ** rounds`` edges.

    The best way from a to b is the one whose weakest edge is heaviest; ways are joined to ways, so their length doubles each round.
    """
    steps = "".join(
        f", way{i} as materialized (select a, b, max(w) as w from (select a, b, w from way{i - 1} union all select x.a, y.b, least(x.w, y.w) from way{i - 1} x join way{i - 1} y on x.b = y.a) where a <> b group by a, b)"
        for i in range(1, rounds + 1)
    )
    return f"""way0 as materialized (select src as a, dst as b, max(w) as w from sim where src <> dst group by src, dst){steps},
      m as materialized (select x.a, x.b, least(x.w, y.w) as w from way{rounds} x join way{rounds} y on x.a = y.b and x.b = y.a), vertex as (select src as node from sim union select dst from sim),
      level as (select distinct w as delta from m), grouped as materialized (select delta, node, coalesce(min(b), node) as top from (select delta, node, case when b < node then b end as b from level cross join vertex left join m on a = node and w >= delta) group by delta, node)"""
