import json
import os

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heatgraph import cli
from heatgraph.catalog import ORACLE_SQL, QUERIES
from heatgraph.operators import consensus, delta, network, permute, similarity
from heatgraph.operators import heat as h
from heatgraph.operators.connected import connected_components
from heatgraph.plans import runs
from heatgraph.plans.bounded import join_checked
from heatgraph.plans.ranges import range_bounds, range_index
from heatgraph.sources import sinks, text
from heatgraph.streaming import event_stream, mutation_counts, windowed_heat

MUT = "sample string, gene string, mut_type string, valid boolean"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def write(path, body):
    path.write_text(body)
    return str(path)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_like_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.sql(f"create view {table.split('.')[0]} as select * from '{sf}/{table}'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda r, o: tuple(str(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in o)
    mine = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    assert sorted(norm(r, mine) for r in got.collect()) == sorted(norm(r, order) for r in want.fetchall())


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u int, v int"))))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5} | {i: 100 for i in range(100, 161)}
    assert rows(connected_components(spark.createDataFrame([], "u int, v int"))) == []


def test_ranges_and_checked_joins(spark):
    frame = spark.range(1000).withColumn("k", (F.col("id") * F.col("id")).cast("bigint"))
    bounds = range_bounds(frame, "k", 30)
    got = frame.select("k", range_index(F.col("k"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.k for b in bounds) for r in got) and range_bounds(frame.limit(0), "k", 4) == []
    small = spark.range(5).toDF("id")
    assert join_checked(frame, small, "id", "inner").count() == join_checked(frame, small, "id", "inner", max_rows=2).count() == 5


def test_readers(spark, tmp_path):
    lines = lambda body: text.lines(spark, write(tmp_path / f"f{abs(hash(body))}.txt", body))
    index = text.node_index(lines("1 a x\n2  b\n1 c\n"))
    assert rows(index) == [(1, "c"), (2, "b")]
    assert rows(text.indexed_edges(lines("1 2 1\n1 2\n2 1\n"), index)) == [("b", "c"), ("c", "b")]
    with pytest.raises(PySparkException):
        text.indexed_edges(lines("1 7\n"), index).collect()
    assert rows(text.node_scores(lines("a 1.5\nb 2\na 3\n"))) == [("a", 3.0), ("b", 2.0)]
    assert rows(text.display_names(lines("a\tOne name \n"))) == [("a", "One name")]
    assert rows(text.snvs(lines("#x\ns1\tg1\tg2\tg1\n"))) == [("s1", "g1", "snv", True)] * 2 + [("s1", "g2", "snv", True)]
    listed = spark.createDataFrame([("g1",)], "gene string")
    assert rows(text.cnas(lines("s1\tg1(A)\tg2(D)\n"), listed)) == [("s1", "g1", "amp", True)]
    assert rows(text.cnas(lines("s1\tg1(A)\n"), listed.limit(0))) == [("s1", "g1", "amp", True)]
    for bad in (lambda: text.cnas(lines("s1\tg1(Z)\n")), lambda: text.fusions(lines("s g1 g9\n"), listed)):
        with pytest.raises(PySparkException):
            bad().collect()
    assert rows(text.fusions(lines("s g1 g1\ns g8 g9\n"), listed)) == [("s", "g1", "g1")]
    assert rows(text.gene_order(lines("a b\nc\n"))) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    path = write(tmp_path / "one.two.json", json.dumps({"heat": {"a": 1.5}, "parameters": {"name": "N"}}))
    heat, name = text.heat_file(spark, path, True)
    assert rows(heat) == [("a", 1.5)] and name == "N"
    assert text.heat_file(spark, write(tmp_path / "x.y.txt", "a 1\n"), False)[1] == "x"
    assert text.whole_file(spark, path).first().value.startswith("{")


def test_heat_rules(spark):
    scores = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 5.0)], "node string, score double")
    assert rows(h.filter_heat(scores)) == [("b", 2.0), ("c", 5.0)]
    assert rows(h.filter_heat(scores, 0, True)) == [("a", 0.0), ("b", 2.0), ("c", 5.0)]
    with pytest.raises(PySparkException):
        h.filter_heat(scores.where("score = 0")).collect()
    with pytest.raises(PySparkException):
        h.direct_heat(scores.withColumn("score", -F.col("score"))).collect()
    with pytest.raises(ValueError):
        h.filter_cnas(scores, 0.5)
    with pytest.raises(PySparkException):
        h.mutsig_heat(spark.createDataFrame([("a", 0.0)], "gene string, qval double")).collect()


def test_mutation_heat_of_small_table(spark):
    cnas = spark.createDataFrame([("s1", "g", "amp", True), ("s2", "g", "amp", True), ("s3", "g", "del", True), ("s1", "k", "amp", True), ("s2", "k", "del", True)], MUT)
    flagged = h.filter_cnas(cnas, 0.6)
    assert rows(flagged.select("gene", "mut_type", "valid")) == [("g", "amp", True), ("g", "amp", True), ("g", "del", False), ("k", "amp", False), ("k", "del", False)]
    snvs = spark.createDataFrame([("s1", "g", "snv", True), ("s4", "g", "snv", True), ("s4", "z", "snv", True)], MUT)
    genes = spark.createDataFrame([("g",), ("k",), ("q",)], "gene string")
    assert rows(h.mutation_heat(genes, 4, snvs, flagged)) == [("g", 0.75), ("k", 0.0), ("q", 0.0)]
    assert rows(h.mutation_heat(genes, 4, snvs, flagged, min_freq=3)) == [("g", 0.5), ("k", 0.0), ("q", 0.0)]
    assert rows(h.loaded_mutation_heat(snvs, cnas, cna_threshold=0.6)) == [("g", 0.75), ("k", 0.0), ("z", 0.25)]


def grid(spark, n=5):
    pairs = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)]
    return spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in pairs], "src string, dst string")


def test_kernels_and_permutations(spark):
    edges = grid(spark)
    kernel = network.restart_kernel(edges, 0.4, block=7)
    assert kernel.count() == 625 and all(abs(r[0] - 1) < 1e-9 for r in kernel.groupBy("src").agg(F.sum("p").alias("t")).select("t").collect())
    seeds = spark.createDataFrame([("n00",), ("n12",)], "node string")
    want = {(r.dst, r.src): r.p for r in kernel.collect()}
    assert all(abs(r.p - want[r.dst, r.src]) < 1e-8 for r in network.restart_iteration(edges, seeds, 0.4).collect())
    heat = spark.createDataFrame([(f"n{i:02}", float(i % 5 + 1)) for i in range(25)], "node string, score double")
    sim = similarity.similarity(kernel, heat)
    cut = similarity.similarity(kernel, heat, delta=0.3)
    assert rows(cut) == rows(sim.where("w >= 0.3"))
    found = delta.by_heats(kernel, permute.permuted_heat(heat, heat, 2), [5])
    assert found.count() == 2
    with pytest.raises(ValueError):
        delta._chosen(None, [2], "other", True)
    with pytest.raises(NotImplementedError):
        network.stored_kernel("other", edges, 1.0, "x")


def test_blocks_without_room(spark):
    order = spark.createDataFrame([("c", i, f"g{i}") for i in range(3)], "chromo string, pos int, gene string")
    blocks = spark.createDataFrame([("s", "c", 1, "amp", 0, 2), ("s", "c", 2, "del", 2, 1)], "sample string, chromo string, block bigint, mut_type string, start int, n bigint")
    with pytest.raises(PySparkException):
        permute.permuted_blocks(blocks, order).collect()


def test_consensus_without_permutations(spark):
    real = spark.createDataFrame([(2, 3)], "size int, n bigint")
    assert rows(consensus.consensus_statistics(real, None, 0)) == [(2, 3, 0.0, 1.0)]


def test_bundle(spark, tmp_path):
    path = network.stored_kernel("restart", grid(spark, 3), 0.4, str(tmp_path / "k"))
    found = sinks.load_bundle(spark, path)
    assert found["parameters"] == {"kind": "restart", "parameter": 0.4} and dict(found["kernel"].dtypes)["p"] == "float"
    assert set(sinks.load_bundle(spark, path, ("edges",))) == {"edges"}


def test_command_line(spark, tmp_path):
    names = [f"n{i:02}" for i in range(16)]
    pairs = [(i, i + 1) for i in range(15)] + [(i, i + 4) for i in range(12)]
    index = write(tmp_path / "index.txt", "".join(f"{i + 1} {n}\n" for i, n in enumerate(names)))
    edges = write(tmp_path / "edges.txt", "".join(f"{a + 1} {b + 1} 1\n" for a, b in pairs))
    heat = write(tmp_path / "heat.txt", "".join(f"{n} {(i * 7) % 5 + 1}\n" for i, n in enumerate(names)))
    out = str(tmp_path / "out")
    config = write(tmp_path / "run.config", f"# comment\n--output {out}\n--network Net {index} {edges}\n--heat Heat {heat}\n--network_permutations 2 --heat_permutations 3\n")
    cli.run(spark, ["run", f"@{config}"])
    folders = os.listdir(f"{out}/net-heat")
    assert any(f.startswith("delta_") for f in folders) and "viz" in folders
    found = json.load(open(f"{out}/consensus/subnetworks.json"))
    assert set(found) == {"params", "deltas", "stats", "linkers", "consensus"}
    results = text.run_results(spark, out).collect()
    assert results and results[0].run == "net-heat" and results[0].components
    cli.run(spark, ["heat-scores", "--scores", heat, "--output", f"{out}/heat.json"])
    assert json.load(open(f"{out}/heat.json"))["heat"]["n00"] == 1.0
    cli.run(spark, ["beta", "--edges", edges, "--output", f"{out}/beta.txt"])
    assert 0 < float(open(f"{out}/beta.txt").read()) < 1
    cli.run(spark, ["dendrogram", "--index", index, "--edges", edges, "--heat", heat, "--output", f"{out}/tree"])
    assert open(f"{out}/tree/hierarchy.newick.txt").read().strip().endswith(";")
    named = write(tmp_path / "named.txt", "#c\nb\ta\nb\tb\nc\tb\nx\ty\n")
    cli.run(spark, ["create-network", "--edges", named, "--output", f"{out}/made"])
    assert [r.value for r in spark.read.text(f"{out}/made_index_gene").collect()] == ["1\ta", "2\tb", "3\tc"]
    cli.run(spark, ["network", "--index", index, "--edges", edges, "--output", f"{out}/kernel", "--permutations", "2", "--swaps", "3"])
    assert json.load(open(f"{out}/kernel/swaps.json")) == {"1": 3 * len(pairs), "2": 3 * len(pairs)}
    assert spark.read.parquet(f"{out}/kernel/permuted").groupBy("perm_id").count().orderBy("perm_id").collect() == [(1, len(pairs)), (2, len(pairs))]
    snv = write(tmp_path / "snv.txt", "s1\tg1\ns2\tg1\tg2\n")
    cna = write(tmp_path / "cna.txt", "s1\tg2(A)\n")
    cli.run(spark, ["heat-mutation", "--snvs", snv, "--cnas", cna, "--output", f"{out}/m.json"])
    assert json.load(open(f"{out}/m.json"))["heat"] == {"g1": 1.0, "g2": 1.0}


def test_permuted_consensus(spark):
    settings = runs.Settings(network_permutations=2, heat_permutations=2, sizes=(2, 3), deltas=(0.05,))
    heat = spark.createDataFrame([(f"n{i:02}", float(i % 3)) for i in range(9)], "node string, score double")
    got = runs.permuted_consensus({"a": grid(spark, 3)}, {"h": heat}, settings, 1)
    assert got.count() == 9 and {r.perm_id for r in got.collect()} == {1}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_heat(event_stream(spark, str(tmp_path / "in"), events.schema), "30 days")
    job = stream.writeStream.format("memory").queryName("heat_stream").outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.sql("select node, sum(n) as n from heat_stream group by node")
    assert rows(got) == rows(events.groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    muts = spark.createDataFrame([("s", "g", "snv", True), ("s", "g", "amp", False), ("t", "g", "del", True)], MUT)
    assert rows(mutation_counts(muts)) == [("g", 1, 1)]
