"""URL filters: rules by host and path, and trust that spreads along links for all that no rule names.

Personalised PageRank runs over the edges between hosts: trust starts at hosts by the share of their
pages that rules allow and follows the links; distrust starts by the share that rules block and follows
them backwards, as who links to blocked hosts is suspect itself. A host is blocked where distrust is
at least ``DISTRUST`` of both together (and not next to nothing). Masses are whole numbers (``UNIT`` for a host whose pages are all
allowed, or all blocked) and every share is rounded down, so no order of sums can change a verdict.

Everything is DataFrame functions; what is joined by host are short rows, one for each page or link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgraph.plans.bounded import join_checked
from heatgraph.plans.lineage import cut

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path) as the contract of ``op12`` names them.
RULES = [(ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/")]
#: Rules up to this number are compared with each row; more of them are joined by the ends of hosts.
FEW = 100
UNIT, DAMPING, ROUNDS, DISTRUST = 1_000_000_000, 85, 20, 0.75
#: Less distrust than that of a host with a tenth of its pages blocked blocks no host.
LEAST = UNIT // 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of links that name a host, quoted or not; relative links stay on their page's host.
LINK = r"(?i)href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?[ \t\r\n\f]*(?:https?:)?//([^/?#\"' \t\r\n\f<>]+)"


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def parted(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``_host`` and ``_path``, both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("_host", _lower(host)).withColumn("_path", path)


def _ends(host: Column) -> Column:
    """A host and all hosts that it is a subdomain of."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``pages`` of ``parted`` with ``_rule`` and ``_said``: name and verdict of the longest rule that fits, else null.

    A rule fits its host and subdomains where the path starts with its path. Length is that of host and path
    together; of equals the longer host wins, then block. A few rules are compared with each row; a
    DataFrame ``(verdict, host, path)`` of any size is joined by the ends of the distinct hosts.
    """
    rank = lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("own"), (r["verdict"] == BLOCK).alias("blocks"), F.concat(r["host"], r["path"]).alias("rule"))
    if isinstance(rules, list) and len(rules) <= FEW:
        known = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]) if rules else None
        if known is None:
            return pages.withColumn("_rule", F.lit(None).cast("string")).withColumn("_said", F.lit(None).cast("string"))
        fits = F.filter(known, lambda r: ((F.col("_host") == r["host"]) | F.endswith(F.col("_host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("_path"), r["path"]))
        best = F.array_max(F.transform(fits, rank))
        return pages.withColumn("_best", best).withColumn("_rule", F.col("_best.rule")).withColumn("_said", F.when(F.col("_best.blocks"), BLOCK).when(F.col("_best").isNotNull(), ALLOW)).drop("_best")
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, "verdict string, host string, path string") if isinstance(rules, list) else rules
    hosts = pages.select("_host").distinct().select("_host", F.explode(_ends(F.col("_host"))).alias("host"))
    known = cut(hosts.join(table.select("verdict", "host", "path"), "host").groupBy("_host").agg(F.collect_set(F.struct("verdict", "host", "path")).alias("_rules")))
    fits = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    found = join_checked(pages, known, "_host").withColumn("_best", F.array_max(F.transform(fits, rank)))
    return found.withColumn("_rule", F.col("_best.rule")).withColumn("_said", F.when(F.col("_best.blocks"), BLOCK).when(F.col("_best").isNotNull(), ALLOW)).drop("_best", "_rules")


def host_edges(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``(src, dst, n)``: how many links the pages of a host have to another host, over whole pages."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    own = parted(pages.select(url, html), url).select(F.col("_host").alias("src"), F.explode(links).alias("dst"))
    return own.select("src", _lower(F.col("dst")).alias("dst")).where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """``(kind, host, mass)`` from rows of ``ruled``: the shares of a host's pages that rules allow and block, in units."""
    hosts = judged.where(F.col("_host") != "").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_said") == ALLOW).alias(ALLOW), F.count_if(F.col("_said") == BLOCK).alias(BLOCK))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in (ALLOW, BLOCK)]))
    share = F.call_function("div", F.col("x.m").cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(11,0)"), F.col("n").cast("decimal(19,0)"))
    return hosts.select("_host", "n", kinds.alias("x")).where("x.m > 0").select("x.kind", F.col("_host").alias("host"), share.alias("mass"))


def spread(start: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """``(kind, host, mass)``: personalised PageRank of both kinds at once, ``damping`` percent of each mass moving on.

    Trust moves along the edges, distrust against them; what a host without edges would pass on is lost.
    After ``rounds`` rounds at most ``(damping / 100) ** rounds`` of the masses is still to come (4 % by default).
    """
    both = edges.select(F.lit(ALLOW).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    both = both.unionByName(edges.select(F.lit(BLOCK).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    walk = cut(both.join(out, ["kind", "host"]))
    start = cut(start)
    if walk.isEmpty():
        return start
    moved = F.call_function("div", F.col("mass").cast("decimal(19,0)") * F.col("n").cast("decimal(12,0)") * F.lit(damping).cast("decimal(3,0)"), F.col("total").cast("decimal(15,0)") * F.lit(100).cast("decimal(3,0)"))
    now = start
    for i in range(rounds):
        step = now.join(walk, ["kind", "host"]).select("kind", F.col("to").alias("host"), moved.alias("mass"))
        now = step.unionByName(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        now = cut(now) if i % 5 == 4 else now
    return now


def distrusted(mass: DataFrame, distrust: float = DISTRUST, least: int = LEAST) -> DataFrame:
    """``(host)``: the hosts whose distrust is at least ``least``, and at least that share of all that reached them."""
    sums = mass.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in (ALLOW, BLOCK)])
    return sums.where((F.col(BLOCK) >= max(1, least)) & (F.col(BLOCK) >= distrust * (F.col(ALLOW) + F.col(BLOCK)))).select("host")


def judged_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame = RULES,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    rounds: int = ROUNDS,
    distrust: float = DISTRUST,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` of every row: the verdict of the longest rule, else that of the host.

    Urls that are null or without ``://`` have an empty host and path, which no rule fits and no link reaches: they are
    allowed, as is every host that no distrust reaches. Repeated rows and null ids come back as given and
    count as often; other columns are not read; an empty table gives an empty result.
    """
    short = parted(pages.select(F.col(id_col).alias("_id"), F.col(url).alias("url")), "url")
    judged = ruled(short, rules)
    mass = spread(seeds(judged), host_edges(pages, html, url), rounds)
    bad = cut(distrusted(mass, distrust)).select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    found = join_checked(judged, bad, "_host")
    verdict = F.coalesce("_said", F.when(F.col("_bad"), BLOCK), F.lit(ALLOW))
    return found.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"))


def sql(rounds: int = ROUNDS) -> str:
    """The same for ``RULES`` as DuckDB SQL."""
    known = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rest = "case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end"
    link = LINK.replace("'", "''")
    steps = "".join(
        f", m{i} as materialized (select kind, host, sum(mass)::bigint as mass from (select kind, w.goes as host, mass::hugeint * n * {DAMPING} // (total::hugeint * 100) as mass from m{i - 1} join walk w using (kind, host) union all select * from m0) group by 1, 2)"
        for i in range(1, rounds + 1)
    )
    return f"""with rules(verdict, rh, rp) as (values {known}),
  split as (select page_id, html, {rest} as rest, row_number() over () as row from pages),
  parts as materialized (select page_id, html, row, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split),
  best as (select row, arg_max(struct_pack(rule := rh || rp, verdict := verdict), length(rh) + length(rp)) as b from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by row),
  judged as materialized (select page_id, host, path, b.rule as rule, b.verdict as said from parts left join best using (row)),
  links as (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{_UPPER}', '{_LOWER}') as dst from parts where host <> ''),
  edges as materialized (select src, dst, count(*) as n from links where src <> dst group by 1, 2),
  ways as (select 'allow' as kind, src as host, dst as goes, n from edges union all select 'block', dst, src, n from edges),
  walk as materialized (select *, sum(n) over (partition by kind, host) as total from ways),
  hosts as (select host, count(*) as n, count(*) filter (where said = 'allow') as a, count(*) filter (where said = 'block') as b from judged where host <> '' group by host),
  m0 as materialized (select 'allow' as kind, host, (a::hugeint * {UNIT} // n)::bigint as mass from hosts where a > 0 union all select 'block', host, (b::hugeint * {UNIT} // n)::bigint from hosts where b > 0){steps},
  bad as (select host from (select host, coalesce(sum(mass) filter (where kind = 'allow'), 0) as a, coalesce(sum(mass) filter (where kind = 'block'), 0) as b from m{rounds} group by host) where b >= {LEAST} and b >= {DISTRUST}::double * (a + b))
  select page_id, host, path, rule, coalesce(said, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from judged"""
