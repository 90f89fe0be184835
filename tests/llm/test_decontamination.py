import random

import numpy as np
import pyarrow as pa

from heatgraph.llm import decontamination as d
from plain_forms import best_alignment, words_plainly


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_like_plain_form():
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 15))]
        b = [rng.randrange(5) for _ in range(rng.randint(1, 25))]
        score, i, j = d.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain_align(a, b)
        if score:
            assert plain_align(a[:i], b[:j]) == score


def test_edited_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 700
    item = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(30):
        copy = list(item)
        for at in rng.sample(range(40), 5):
            copy[at] = "edit"
        if k % 3 == 0:
            del copy[7]
        rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(k * 9)) + " " + " ".join(copy).upper() + "."))
    rows += [(100 + k, " ".join(rng.choice(vocabulary) for _ in range(150))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, None), (7, ""), (5, " ".join(item))], "item_id bigint, text string")
    got = d.leaks(docs, bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(30)) and {r.item_id for r in got} == {5}
    assert all(0 <= r.start_word < r.end_word for r in got)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, item_id int, score string"
    rows = [(1, None), (2, ""), (3, "alpha beta gamma delta epsilon zeta eta"), (3, "alpha beta gamma delta epsilon zeta eta"), (None, "x alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta " * 4000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], schema)
    bench = spark.createDataFrame([(9, "Alpha, beta gamma. delta epsilon zeta", 1), (10, "q", 2), (None, "eta", 3)], "item_id int, text string, doc_id int")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.score) for r in d.leaks(docs, bench, block=4).collect())
    assert got == [(0, 9, 6), (3, 0, 1), (3, 0, 1), (3, 9, 6), (3, 9, 6), (4, 9, 6)]
    assert d.leaks(docs.limit(0), bench).collect() == [] and d.leaks(docs, bench.limit(0)).collect() == []
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [1, 2] and d.clean(docs, bench).columns == docs.columns


def test_edited_copies_without_long_runs(spark):
    """Against the alignment of every item with every whole document, no run of words in common asked for."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in [10, 20, 12, 7, 6, 4, 2, 1, *range(15, 40)]]
    rows = []
    for item in items:
        substituted = [w if (at + 1) % 5 else f"x{rng.randrange(999)}" for at, w in enumerate(item)]
        spread = [x for at, w in enumerate(item) for x in ([w] if at % 2 == 0 else [w, f"y{rng.randrange(999)}"])]
        dropped = [w for w in item if rng.random() > 0.15]
        for copy in (substituted, spread, dropped):
            around = [[rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(2)]
            rows.append((len(rows), " ".join(around[0] + copy + around[1])))
    rows += [(len(rows) + k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    want = {}
    for k, text in rows:
        for i, item in enumerate(items):
            score = best_alignment(item, words_plainly(text))
            if score >= min(len(item), max(6, -(-len(item) // 2))):
                want[k, i] = score
    assert {(0, 0), (3, 1), (4, 1)} <= want.keys()
    assert {(r.doc_id, r.item_id): r.score for r in d.leaks(docs, bench, block=200).collect()} == want
    assert {r.doc_id for r in d.clean(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def test_documents_against_all_alignments(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: words_plainly(r.text) for r in bench.collect()}
    want, every = {}, set()
    for r in docs.collect():
        text = words_plainly(r.text)
        every.add(r.doc_id)
        for i, w in items.items():
            score = best_alignment(w, text)
            if score >= max(6, 0.5 * len(w)):
                want[r.doc_id, i] = score
    assert want and {(r.doc_id, r.item_id): r.score for r in d.leaks(docs, bench).collect()} == want
    kept = d.clean(docs, bench, block=700)
    assert {r.doc_id for r in kept.collect()} == every - {k for k, _ in want} and kept.columns == docs.columns


def test_recall_of_edited_copies(spark, sf):
    """Items of the table with a share of their words replaced, inside other words: each that still scores is found."""
    rng = random.Random(12)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect()]
    vocabulary = sorted({w for _, words in items for w in words})
    rows, want = [], set()
    for share in (0.1, 0.15, 0.2, 0.25):
        for key, words in items:
            copy = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
            around = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80))) for _ in range(2)]
            rows.append((len(rows), f"{around[0]} {' '.join(copy)} {around[1]}"))
            plain = words_plainly(" ".join(words))
            if best_alignment(plain, words_plainly(rows[-1][1])) >= max(6, 0.5 * len(plain)):
                want.add((rows[-1][0], key))
    got = {(r.doc_id, r.item_id) for r in d.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert len(want) > 3 * len(items) and want <= got


def test_words_like_plain_form():
    texts = ["", None, "--- ...", " É\u201ca\u201db_c  x\ty\n", "ÉABC éabc", "3.5% a", "\u3000wide\u3000"]
    words, begin = d.column_words(pa.array(texts, pa.string()))
    plain = [words_plainly(t) for t in texts]
    assert np.diff(begin).tolist() == [len(w) for w in plain]
    flat = [w for ws in plain for w in ws]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    assert all(d.words_of(w).tolist() == [h] for w, h in zip(flat, words.tolist()))
