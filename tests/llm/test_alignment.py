"""Token alignment against whole texts encoded at once."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from heatgraph.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", "a  ", " a", "foo\tbar baz", "a▁b c", "<s> x</s> <|endoftext|> y", "<0x41> z", "ﬁ Å é", "a\x00b", "\n\nfoo  bar\n", "x \n\n y\r\n  z", "\xa0 \xa0 x",
    "日本語 テキスト 🙂 🙂🙂", "a  b 　 c", "'s 't don't I'm  it's", "1234567 89", "w" * 3000, "​ x ﻿ y", "é́ ́x", "a\x1c b \x85 c", "x᠎ y", "a ▁ b", " . , ; ", "end \n",
]


def brute(texts):
    pair = alignment.Pair(A, B)
    per, counts = [], Counter()
    for t in texts:
        if not t:
            per.append(None)
            continue
        whole = (" " + t).encode()
        x, y = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        if b"".join(pair.a_bytes[i] for i in x) != whole or b"".join(pair.b_bytes[i] for i in y) != whole:
            per.append(None)
            continue
        ends = []
        for ids, sizes in ((x, pair.a_bytes), (y, pair.b_bytes)):
            at = 0
            ends.append([at := at + len(sizes[i]) for i in ids])
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, ids in enumerate((x, y)):
            for i, e in zip(ids, ends[k]):
                groups[bisect.bisect_left(cuts, e)][k].append(i)
        links = [(a, b) for u, v in groups for a in u for b in v]
        per.append((len(x), len(y), groups, links))
        counts.update(set(links))
    most = defaultdict(int)
    for (a, _), c in counts.items():
        most[a] = max(most[a], c)
    for p in per:
        if p is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            spelled = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in p[2])
            yield p[0], p[1], len(p[2]), len(p[3]), sum(counts[x] == most[x[0]] for x in p[3]), sum(counts[x] for x in p[3]), hashlib.sha256(spelled.encode()).hexdigest()


def test_vocabularies_are_separable():
    pair = alignment.Pair(A, B)
    assert pair.separable
    pair.b_bytes = pair.b_bytes[:1]
    pair.a_bytes = {0: b"a b"}
    assert not pair._separable()


def test_segments():
    assert alignment.segments(" a  b \n c. ") == [" a", "  b", " \n c. "]
    assert all("".join(alignment.segments(" " + t)) == " " + t for t in ODD if t)


@pytest.mark.parametrize("chunk,most_pairs,separable", [(1000, 10, True), (1 << 24, 1 << 20, True), (5000, 1 << 20, False)])
def test_against_whole_texts(spark, sf, chunk, most_pairs, separable, monkeypatch):
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80 if separable else 10).collect()]
    texts = own + ODD + ODD + own[:3] + [" ".join(own[:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    if not separable:
        monkeypatch.setattr(alignment._pair(A, B), "separable", False)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignments(docs, A, B, chunk=chunk, most_pairs=most_pairs).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want and sum(w[-1] != "" for w in want.values()) > 20


def test_segments_of_many_tokens(spark):
    """Over 65,535 tokens in a segment: numbers of four bytes, beside others of two."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("qxzjkvw") for _ in range(220_000)), "a few words, and more words.", "words, and a few words."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignments(docs, A, B).collect()}
    assert got == dict(enumerate(brute(texts))) and got[0][0] > 65_535


def test_odd_rows(spark):
    schema = "id string, body string, chunk int, segment string, a string, pair string"
    rows = [(None, "x y", 1, "s", "t", "u"), ("k", None, 1, "", "", ""), ("k", "x y", None, None, None, None), ("k", "x y", 2, "", "", "")]
    got = alignment.alignments(spark.createDataFrame(rows, schema), A, B, id_col="id", text_col="body").collect()
    assert sorted((r.id or "", r.n_a, r.count_sum) for r in got) == [("", 2, 6), ("k", 0, 0), ("k", 2, 6), ("k", 2, 6)]
    assert alignment.alignments(spark.createDataFrame([], schema), A, B, id_col="id", text_col="body").collect() == []
    nothing = alignment.alignments(spark.createDataFrame([("k", None, 1, "", "", "")], schema), A, B, id_col="id", text_col="body").collect()
    assert [tuple(r) for r in nothing] == [("k", 0, 0, 0, 0, 0, 0, "")]


def test_lists_of_numbers_without_objects():
    import numpy as np

    from heatgraph.llm.alignment import _one_list

    assert [_one_list(np.array(x, np.int64)).to_pylist() for x in ([], [3, 1 << 40])] == [[[]], [[3, 1 << 40]]]


def test_links_are_rated_in_parts(monkeypatch):
    blobs = [[2, 1, 1, 1, 2, 7, 8, 9, 5, 6], [1, 1, 1, 7, 9], [], [1, 2, 1, 7, 8, 9], [1, 1, 1, 1, 2]]
    packed = pa.array([np.array(x, "<u2").tobytes() for x in blobs], pa.binary())
    pairs = np.array([7 << 32 | 9, 8 << 32 | 9], np.int64)
    given = pairs, np.array([3, 2], np.int64), np.array([1, 0], np.int64)
    whole = alignment._rated(packed, False, *given)
    sizes, made = [], alignment.Aligned
    monkeypatch.setattr(alignment, "PART", 2)
    monkeypatch.setattr(alignment, "Aligned", lambda x, wide: sizes.append(len(x)) or made(x, wide))
    parts = alignment._rated(packed, False, *given)
    assert sizes == [2, 2, 1] and parts[2] == whole[2] and np.array_equal(parts[0], whole[0])
    assert all(np.array_equal(a, b) for a, b in zip(parts[1], whole[1])) and whole[1][5].tolist()[1] == 3
    assert [x.tolist() for x in alignment._rated(packed, False, *(x[:0] for x in given))[1]][4:] == [[0] * 5, [0] * 5]


def test_links_are_composed_in_parts(monkeypatch):
    blobs = [[2, 1, 1, 1, 2, 7, 8, 9, 5, 6], [1, 1, 1, 7, 9], [], [1, 2, 1, 7, 8, 9], [1, 1, 1, 1, 2]]
    packed = pa.array([np.array(x, "<u2").tobytes() for x in blobs], pa.binary())
    whole, sizes, made = alignment.Aligned(packed), [], alignment.Aligned
    monkeypatch.setattr(alignment, "PART", 2)
    monkeypatch.setattr(alignment, "Aligned", lambda x, wide: sizes.append(len(x)) or made(x, wide))
    parts = alignment._linked(packed, False)
    assert sizes == [2, 2, 1] and all(np.array_equal(getattr(parts, k), getattr(whole, k)) for k in ("ok", "pairs", "n_held", "held"))
    assert [x.tolist() for x in alignment._linked(packed[:0], False)] == [[], [], [], []]


def test_chunks_are_made_without_vocabularies(spark):
    """A worker that has aligned segments before lets its vocabularies go; a bucket is a small part of an executor's memory."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")

    class Taken:
        schema = docs.schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def withColumn(self, *column):
            return self

    alignment._pair(A, B)
    taken = alignment._chunks(Taken(), "doc_id", "text", 1 << 20, True)
    made = list(taken.run(iter([pa.RecordBatch.from_pydict({"id": [1], "text": ["a b"]})])))
    assert made[0].column("entries").to_pylist() == [2]
    assert alignment._pair.cache_info().currsize == 0 and alignment.BUCKET <= 100_000
