import math

import corpus_pipeline as p
import regex

from heatgraph.llm import packing, pii, simhash, toxicity
from plain_forms import best_alignment, plain_components, plain_pack, words_plainly


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = toxicity.Scorer(model)
    rows = {r.doc_id: r.text for r in docs.collect()}

    steps, frame = {}, docs
    for name, stage in p.STAGES:
        frame = stage(spark, frame, sf).cache()
        steps[name] = frame
        if name != "packing":
            assert frame.schema == docs.schema

    rows = {k: t for k, t in rows.items() if score(t) < 0.5}
    assert {r.doc_id for r in steps["toxicity"].collect()} == rows.keys()

    groups = plain_components(list(rows.items()))
    rows = {k: t for k, t in rows.items() if groups[k][1] == k}
    assert sorted(r.doc_id for r in steps["simhash near-dedup"].collect()) == sorted(rows)

    bench = [words_plainly(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, t in list(rows.items()):
        own = words_plainly(t)
        if any(best_alignment(item, own) >= min(len(item), max(6, math.ceil(len(item) / 2))) for item in bench):
            del rows[k]
    assert {r.doc_id for r in steps["benchmark decontamination"].collect()} == rows.keys()

    told = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.personal_data(steps["benchmark decontamination"]).collect()}
    rows = {k: pii.sanitised(t, pii.base_spans(t), told[k]) for k, t in rows.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in steps["pii"].collect()}
    assert got == {k: (t, len(t)) for k, t in rows.items()}
    assert not any(pii.base_spans(t) for t in rows.values())

    final = sorted(tuple(r) for r in steps["packing"].collect())
    lengths = [(k, len(regex.findall(packing.UNIT, t)) + 1) for k, t in rows.items()]
    assert final == sorted(plain_pack(lengths, packing.BUCKETS, packing.BUDGET))


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert {r.doc_id for r in p.run(spark, sf).collect()}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_toxicity_stage_without_labels_keeps_all(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for name, known in (("none", labels.limit(0)), ("clean", labels.where("toxic = 0"))):
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert p.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == docs.count()


def test_deduplicated_odd_rows(spark):
    """One row of each group by (id, hash of the text), null ids last; other columns of whatever name stay."""
    schema = "doc_id bigint, text string, _leads int, extra string, _rank map<string,int>, key int, `end` array<int>, _id string"
    rows = [(4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e"), (7, "q w e r t y"), (7, "q w e r t y"), (9, None), (8, ""), (None, "a b c d e"), (None, None)]
    rows += [(11, "one id two texts"), (11, "another of them here"), (None, "alone without any id"), (None, "alone without any id")]
    frame = spark.createDataFrame([(*r, 1, "x", {"a": 1}, None, [2], "z") for r in rows], schema)
    for most in (500_000, 1):
        got = simhash.deduplicated(frame, most=most)
        assert got.columns == frame.columns
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert kept == sorted([(2, "a b c d e"), (7, "q w e r t y"), (8, ""), (11, "one id two texts"), (11, "another of them here"), (None, "alone without any id")], key=str)
        assert {(r._leads, r.extra, r._rank["a"], r.end[0], r._id) for r in got.collect()} == {(1, "x", 1, 2, "z")}
    assert simhash.deduplicated(frame.limit(0)).collect() == []
    # one id on rows of different texts: the row that leads its group stays, the copy of a lower id goes
    mixed = spark.createDataFrame([(1, "copied text of some words"), (5, "copied text of some words"), (5, "zebra words of its own here")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.deduplicated(mixed).collect()) == [(1, "copied text of some words"), (5, "zebra words of its own here")]
