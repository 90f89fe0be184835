import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heatgraph.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def odd_texts(n):
    rng = random.Random(4)
    parts = ["don't", "It'S", "'RE", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", "é", "é", "İx", "ΣΑΣ", "漢字", "a_b", "__", "12³", "¼", "\xa0", "\x85", "\x1c", "\t\n", " ", "  ", "word", "UPPER", "ß", "🙂", "‍", "—", "…", "ª", "x" * 90, "#$%", "ſ's", "'", "̃", "<|", "|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_like_the_library(plain):
    own = tokens.Counter(PATH)
    for text in ["", *odd_texts(600), *(chr(c) + "a" + chr(c) + " 's" + chr(c) for c in range(0x250))]:
        assert own.count(text) == plain(text), repr(text)


def test_spliced_chunks_like_the_library(plain):
    for chunk, overlap in ((7, 3), (40, 8), (64, 16)):
        own = tokens.Counter(PATH, chunk, overlap)
        for text in odd_texts(250):
            assert own.count(text) == plain(text), (chunk, repr(text))
    own = tokens.Counter(PATH, 50, 5)
    assert own.count("x" * 1000) == plain("x" * 1000)  # one piece: overlaps widen to the whole text
    assert own.count("漢" * 700) == plain("漢" * 700)


def test_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.token_counts(docs, PATH, chunk=500, overlap=50).collect()
    assert len(got) == len(want)
    for r in got:
        n = plain(want[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 2048)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, n_tokens string, id array<int>"
    rows = [(1, None, "x", [1]), (2, "", None, None), (2, "", None, None), (None, "a b", "", None), (3, "word " * 300000, "", None)]
    got = sorted(tuple(r) for r in tokens.token_counts(spark.createDataFrame(rows, schema), PATH).na.fill(-1).collect())
    assert got == [(-1, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 1500000, 300000, True)]
    assert tokens.token_counts(spark.createDataFrame([], schema), PATH).collect() == []
