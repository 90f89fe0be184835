"""Length buckets of least padding, and token-budget batches inside each.

The histogram of all lengths up to the token budget (so at most that many bins) goes to the driver,
where dynamic programming chooses the bucket boundaries that minimise the padding of all rows. The
cost is Monge, so each of its levels takes divide and conquer over monotone minima. A batch of a
bucket with boundary ``b`` holds ``budget // b`` rows, each padded to ``b``. A row longer than the
budget is a batch of its own, unpadded and whole.

Rows are ranked inside their bucket by (length, id). A rank is the sum of three counts: shorter rows
(from the histogram), rows of the same length in lower id ranges, and lower ids in the same range.
So no task holds a bucket or a length, however many rows it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.plans.lineage import cut
from heatgraph.plans.ranges import range_bounds, range_index

BUCKETS = 8
BUDGET = 32768
#: A length unit: a run of letters, a run of digits, or one mark of punctuation or symbol.
UNIT = r"[\p{L}\p{M}]+|\p{N}+|[\p{P}\p{S}]"


def unit_length(text: str = "text") -> Column:
    """Units of a text plus one for its end mark; null and empty texts have length 1."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(UNIT)), F.lit(0)) + 1).cast("bigint")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds of at most ``buckets`` buckets of least padding; ties take fewer, then lower ones."""
    order = np.argsort(lengths)
    n, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    if not len(n):
        return []
    rows, units = np.cumsum(c), np.cumsum(c * n)
    cost = n * rows - units
    chosen = []
    for _ in range(buckets - 1):
        best, at = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
        todo = [(1, len(n) - 1, 0, len(n) - 2)]
        while todo:  # leftmost minima move right with j
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            stop = min(b, j - 1) + 1
            value = cost[a:stop] + n[j] * (rows[j] - rows[a:stop]) - (units[j] - units[a:stop])
            k = int(np.argmin(value))
            best[j], at[j] = value[k], a + k
            todo += [(lo, j - 1, a, a + k), (j + 1, hi, a + k, b)]
        stay = cost <= best
        chosen.append(np.where(stay, np.arange(len(n)), at))
        cost = np.minimum(cost, best)
    j, bounds = len(n) - 1, [int(n[-1])]
    for back in reversed(chosen):
        if back[j] != j:
            j = int(back[j])
            bounds.append(int(n[j]))
    return bounds[::-1]


def length_buckets(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """``(id_col, length, bucket, padded, batch, slot)`` for every row.

    ``length`` is any positive column (by default the units of ``text``); null lengths count 0.
    ``bucket`` counts from 0 by boundary, ``padded`` is the boundary; rows over the budget are in
    bucket ``buckets``, padded to themselves. ``batch`` and ``slot`` count from 0 in a bucket in the
    order of (length, id), null ids last; ids are numbers, as ranges are cut by value. Rows of one id and length are interchangeable. An empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    size = F.coalesce((unit_length() if length is None else length).cast("bigint"), F.lit(0).cast("bigint"))
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("id"), size.alias("length")))

    histogram = rows.where(F.col("length") <= budget).groupBy("length").count().collect()
    lengths = np.array([r["length"] for r in histogram], np.int64)
    bounds = boundaries(lengths, np.array([r["count"] for r in histogram], np.int64), buckets)
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    bucket = F.when(F.col("length") > budget, F.lit(buckets)).otherwise(F.size(F.filter(limits, lambda b: b < F.col("length"))))

    ranges = range_bounds(rows, "id", 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.coalesce(range_index(F.col("id"), ranges), F.lit(len(ranges) + 1))
    placed = rows.withColumn("bucket", bucket).withColumn("part", part)
    cells = placed.groupBy("bucket", "length", "part").agg(F.count(F.lit(1)).alias("n"))
    shorter = cells.groupBy("bucket", "length").agg(F.sum("n").alias("n"))
    # one row for each length: at most the budget's number of them in a bucket, and few lengths beyond
    shorter = shorter.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("length")) - F.col("n"))
    inside = F.sum("n").over(Window.partitionBy("bucket", "length").orderBy("part")) - F.col("n")
    starts = cells.withColumn("inside", inside).join(shorter.select("bucket", "length", "before"), ["bucket", "length"])
    starts = starts.select("bucket", "length", "part", (F.col("before") + F.col("inside")).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket", "length", "part").orderBy(F.col("id").asc_nulls_last())) - 1
    ranked = placed.withColumn("within", within).join(starts, ["bucket", "length", "part"])
    padded = F.when(F.col("bucket") == buckets, F.col("length")).otherwise(F.element_at(limits, F.col("bucket") + 1) if bounds else F.col("length"))
    capacity = F.when(F.col("bucket") == buckets, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(padded, F.lit(1)))))
    rank = F.col("start") + F.col("within")
    return ranked.select(
        F.col("id").cast(kind).alias(id_col),
        "length",
        F.col("bucket").cast("int").alias("bucket"),
        padded.cast("bigint").alias("padded"),
        F.floor(rank / capacity).cast("bigint").alias("batch"),
        (rank % capacity).cast("bigint").alias("slot"),
    )


def batches(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(bucket, batch, padded, ids, lengths)``: each batch whole; a batch is bounded by the budget."""
    members = F.array_sort(F.collect_list(F.struct("slot", id_col, "length")))
    grouped = placed.groupBy("bucket", "batch").agg(F.max("padded").alias("padded"), members.alias("m"))
    return grouped.select("bucket", "batch", "padded", F.col(f"m.{id_col}").alias("ids"), F.col("m.length").alias("lengths"))


def sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same over ``documents`` in one statement, the dynamic programme as a chain of joins."""
    levels = ["d1 as materialized (select j, n * cc - ss as cost, j as i from x)"]
    for k in range(2, buckets + 1):
        levels.append(
            f"""s{k} as materialized (select b.j as j, min(d.cost + b.n * (b.cc - a.cc) - (b.ss - a.ss)) as cost,
            arg_min(a.j, (d.cost + b.n * (b.cc - a.cc) - (b.ss - a.ss)) * 1000000 + a.j) as i
            from x b join x a on a.j < b.j join d{k - 1} d on d.j = a.j group by b.j),
            d{k} as materialized (select p.j, least(p.cost, coalesce(s.cost, p.cost)) as cost,
            case when s.cost is null or p.cost <= s.cost then p.j else s.i end as i from d{k - 1} p left join s{k} s on s.j = p.j)"""
        )
    backs = [f"b{buckets} as (select max(j) as j from x)"]
    for k in range(buckets, 1, -1):
        backs.append(f"b{k - 1} as (select i as j from d{k} join b{k} using (j))")
    union = " union ".join(f"select j from b{k}" for k in range(1, buckets + 1))
    return f"""with lens as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '{UNIT}')) + 1 as bigint) as length from documents),
    h as (select length as n, count(*) as c from lens where length <= {budget} group by length),
    x as materialized (select n, row_number() over (order by n) as j, cast(sum(c) over (order by n) as bigint) as cc, cast(sum(c * n) over (order by n) as bigint) as ss from h),
    {", ".join(levels)}, {", ".join(backs)},
    bounds as (select n as padded, row_number() over (order by n) - 1 as bucket from x where j in ({union})),
    placed as (select doc_id, length, min(b.padded) as padded from lens join bounds b on b.padded >= length where length <= {budget} group by doc_id, length
      union all select doc_id, length, length from lens where length > {budget}),
    ranked as (select p.doc_id, p.length, coalesce(b.bucket, {buckets}) as bucket, p.padded,
      row_number() over (partition by coalesce(b.bucket, {buckets}) order by p.length, p.doc_id) - 1 as r,
      case when b.bucket is null then 1 else greatest(1, {budget} // p.padded) end as cap from placed p left join bounds b on p.length <= {budget} and b.padded = p.padded)
    select doc_id, length, cast(bucket as integer) as bucket, cast(padded as bigint) as padded, cast(r // cap as bigint) as batch, cast(r % cap as bigint) as slot from ranked"""
