import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from heatgraph.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    return docs, labels, truth


def auc(pairs):
    ranks = {i: r for r, i in enumerate(sorted(range(len(pairs)), key=lambda i: pairs[i][0]))}
    good = [ranks[i] for i, (_, y) in enumerate(pairs) if y]
    return (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * (len(pairs) - len(good)))


def test_folds_and_sample(spark, tables):
    docs, labels, truth = tables
    for r in docs.select("doc_id", labelled.fold().alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 5
    rows = labelled.sample(docs, labels, "toxic", 20).collect()
    assert sum(r.label == 0 for r in rows) == 20 and all(r.fold for r in rows)
    assert sorted(rows) == sorted(labelled.sample(docs.repartition(7), labels.repartition(3), "toxic", 20).collect())


def test_quality_held_out(spark, tables):
    docs, labels, truth = tables
    net, prior = quality.fitted(docs, labels)
    assert 0.7 < prior < 0.95
    got = quality.scores(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id][0]) for r in got if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.9
    assert np.mean([s >= 0.3 for s, y in held if y]) > 0.97


def test_quality_slope_is_the_risks_gradient():
    rng = np.random.default_rng(0)
    good, web, prior = rng.normal(size=5), rng.normal(size=8) + 2, 0.4
    risk = lambda g: prior * np.logaddexp(0, -g[:5]).mean() + np.logaddexp(0, g[5:]).mean() - prior * np.logaddexp(0, g[:5]).mean()
    seen = []

    class Spy(quality.Net):
        def fit(self, x, slope, steps, **kw):
            seen.append(slope)

    real, quality.Net = quality.Net, Spy
    try:
        width = len(quality.features(""))
        quality.train(np.zeros((5, width)), np.zeros((8, width)), prior)
    finally:
        quality.Net = real
    g = np.concatenate([good, web])
    for i in range(13):
        d = np.zeros(13)
        d[i] = 1e-6
        assert abs((risk(g + d) - risk(g - d)) / 2e-6 - seen[0](g)[i]) < 1e-6
    low = np.concatenate([np.full(5, 3.0), np.full(8, -9.0)])  # bad risk below zero: step back
    assert (seen[0](low)[5:] < 0).all()


def test_class_prior():
    rng = np.random.default_rng(1)
    for share in (0.4, 0.7, 0.9):
        web = np.concatenate([rng.normal(2, 1, int(6000 * share)), rng.normal(-3, 1, int(6000 * (1 - share)))])
        assert abs(quality.class_prior(rng.normal(2, 1, 4000), web) - share) < 0.06


def test_toxicity_held_out(spark, tables):
    docs, labels, truth = tables
    got = toxicity.scores(docs, toxicity.fitted(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id][1]) for r in got if r.held_out and r.doc_id in truth]
    assert auc(held) > 0.85


def test_cnn_pools_like_plain_form():
    model = toxicity.TextCnn()
    x = np.random.default_rng(2).normal(size=(9, toxicity.DIMENSION)).astype(np.float32)
    pooled, where = model._pool(x)
    at = 0
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            filters = [model.filters[:, at + k * toxicity.FILTERS + f] for k in range(width)]
            plain = [sum(float(x[i + k] @ filters[k]) for k in range(width)) for i in range(len(x) - width + 1)]
            assert abs(max(plain) - pooled[w * toxicity.FILTERS + f]) < 1e-4
            assert where[w * toxicity.FILTERS + f] == int(np.argmax(plain))
        at += width * toxicity.FILTERS


def test_thresholds():
    assert toxicity.best_threshold(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([1, 1])) == 0.0
    assert toxicity.best_threshold(np.array([]), np.array([])) == 0.0


def test_odd_rows(spark, tables):
    docs, labels, _ = tables
    schema = "doc_id bigint, text string, score string, label int, quality int, toxic int"
    rows = [(1, None), (2, ""), (2, ""), (None, "the idiot"), (3, "w " * 150000)]
    frame = spark.createDataFrame([(*r, "x", 1, None, None) for r in rows], schema)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for known in (labels.limit(0), labels.limit(30)):
            fit = module.fitted(docs, known)
            fit = fit[0] if module is quality else fit
            got = module.scores(frame, fit).collect()
            assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 2, 3] and all(0 <= r.score <= 1 for r in got)
        assert module.scores(frame.limit(0), fit).collect() == []
    model = toxicity.fitted(docs, labels)
    kept = toxicity.clean(frame, model)
    assert kept.columns == frame.columns and kept.count() <= 5


def test_toxicity_without_usable_labels(spark, sf, tmp_path):
    """No labels, or labels of one kind: nothing is toxic, and no document is lost."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for known in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        model = toxicity.fitted(docs, known)
        got = toxicity.scores(docs, model).collect()
        assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
        assert toxicity.clean(docs, model).count() == docs.count() == len(got)


def plain_toxicity(model, text):
    """The score by plain loops over words, filters and places."""
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in text.lower().split()]
    vector = {}
    for w in set(words):
        keys = ["=" + w, "4" + w[:4], "5" + w[:5], "7" + w[:7]]
        vector[w] = sum(model.table[xxhash.xxh64_intdigest(k.encode()) % (1 << 16)].astype(float) for k in keys)
    x = [vector[w] for w in words] + [np.zeros(16)] * max(0, 3 - len(words))
    z, column, f = float(model.base), 0, 0
    for width in (1, 2, 3):
        blocks = [model.filters[:, column + 12 * k : column + 12 * (k + 1)].astype(float) for k in range(width)]
        top = np.max([sum(x[i + k] @ blocks[k] for k in range(width)) for i in range(len(x) - width + 1)], axis=0)
        for best in top:
            z += max(0.0, best + float(model.bias[f])) * float(model.out[f])
            f += 1
        column += 12 * width
    votes = [sum(w in spoken.split() for w in words) for spoken in toxicity.LANGUAGES.values()]
    z -= float(model.thresholds[votes.index(max(votes)) if any(votes) else 4])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_like_plain_loops(spark, sf, tables):
    docs, labels, _ = tables
    model = toxicity.fitted(docs, labels)
    few = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in toxicity.scores(few, model).collect()}
    for r in few.collect():
        assert abs(plain_toxicity(model, r.text) - got[r.doc_id]) < 2e-3


def plain_features(text):
    """The features one after the other, by their definitions."""
    raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".!?", ",;:", "|", "#$%&*@^~", "<>{}[]()", "=+_\\/`", "\"'"]
    counts = [sum(raw.count(c.encode()) for c in own) for own in classes]
    counts += [sum(b > 127 for b in raw), sum(b < 9 or 13 < b < 32 or b == 127 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)]
    shares = [c / max(1, len(raw)) for c in counts]
    sizes, lengths = [len(w) for w in words] or [0], [len(x) for x in lines] or [0]
    seen = sorted(Counter(words).values(), reverse=True) + [0, 0]
    return [math.sqrt(s) for s in shares] + [
        math.log(1 + len(words)) / 8, np.mean(sizes) / 10, np.std(sizes) / 10, min(max(sizes), 200) / 50,
        len(set(words)) / n, len(set(words)) / n**0.8, seen[0] / n, seen[1] / n,
        sum(not any(c.isalnum() for c in w) for w in words) / n,
        sum(re.fullmatch(r"[\w\s.,;:!?\"')\]»…-]", w[-1]) is None for w in words) / n,
        math.log(1 + m) / 5, len(set(lines)) / m, math.log(1 + np.mean(lengths)) / 6,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / m, sum(w[0].isupper() for w in words) / n,
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1), (shares[4] + shares[5]) * 10, 0.0 if words else 1.0,
    ]


def test_quality_scores_like_plain_loops(spark, sf, tables):
    docs, labels, _ = tables
    net, _ = quality.fitted(docs, labels)
    few = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.score for r in quality.scores(few, net).collect()}
    w1, b1, w2, b2 = [w.tolist() for w in net.weights]
    for r in few.collect():
        x = [max(-6.0, min(6.0, (v - m) / s)) for v, m, s in zip(plain_features(r.text), net.mean, net.scale)]
        hidden = [math.tanh(sum(v * w1[i][j] for i, v in enumerate(x)) + b1[j]) for j in range(len(b1))]
        z = sum(h * w[0] for h, w in zip(hidden, w2)) + b2[0]
        assert abs(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - got[r.doc_id]) < 1e-9
