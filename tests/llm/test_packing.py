import itertools
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from heatgraph.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_boundaries_like_all_choices():
    rng = random.Random(7)
    for _ in range(150):
        lengths = [rng.randint(1, 14) for _ in range(rng.randint(1, 30))]
        hist = Counter(lengths)
        keys = sorted(hist)
        k = rng.randint(1, 4)
        best = min(padding(lengths, (*c, keys[-1])) for r in range(k) for c in itertools.combinations(keys[:-1], min(r, len(keys) - 1)))
        got = packing.boundaries(np.array(keys), np.array([hist[x] for x in keys]), k)
        assert len(got) <= k and got[-1] == keys[-1] and padding(lengths, got) == best
    assert packing.boundaries(np.array([], int), np.array([], int), 3) == []


def plain(rows, buckets, budget):
    fit = [n for _, n in rows if n <= budget]
    hist = Counter(fit)
    bounds = packing.boundaries(np.array(list(hist), int), np.array(list(hist.values()), int), buckets)
    groups = {}
    for i, n in rows:
        b = buckets if n > budget else sum(x < n for x in bounds)
        groups.setdefault(b, []).append((n, i is None, i))
    for b, members in groups.items():
        for r, (n, _, i) in enumerate(sorted(members, key=lambda m: (m[0], m[1], m[2] or 0))):
            padded = n if b == buckets else bounds[b]
            cap = 1 if b == buckets else max(1, budget // max(padded, 1))
            yield i, n, b, padded, r // cap, r % cap


def test_against_plain_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    for buckets, budget in ((8, 32768), (3, 400)):
        got = packing.length_buckets(docs, buckets=buckets, budget=budget)
        rows = sorted(tuple(r) for r in got.collect())
        assert rows == sorted(con.sql(packing.sql(buckets, budget)).fetchall())
        assert rows == sorted(plain([r[:2] for r in rows], buckets, budget))
        whole = packing.batches(got).collect()
        assert sorted(i for r in whole for i in r.ids) == sorted(r[0] for r in rows)
        assert all(len(r.ids) * r.padded <= budget or len(r.ids) == 1 for r in whole)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, bucket string, batch int, length int, part int"
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "w " * 90000), (5, "d e f"), *((i, "same two") for i in range(100, 160))]
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
    got = packing.length_buckets(frame, buckets=2, budget=12)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain([(i, 90001 if i == 4 else len((t or "").split()) + 1) for i, t in rows], 2, 12)))
    assert packing.length_buckets(spark.createDataFrame([], schema)).collect() == []
    assert packing.length_buckets(frame, length=F.lit(None)).where("length <> 0").count() == 0
