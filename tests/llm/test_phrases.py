"""Collocations against counting by hand, and against SQL."""

import re
from collections import Counter

import duckdb
import pytest

from heatgraph.llm import phrases


def brute(rows, least, most_words, top, cover):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(upper, lower))):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = [b for (m, q), b in candidates.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= cover * a for b in inside):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    for lang, found in out.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            yield lang, rank, p.decode(), -a, l, r, totals[lang], -score


def rows_of(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


ROWS = [
    ("New York City is in New York, and new york city. NEW YORK\tcity", "en"), ("a a a a a a a b a a a", "en"), ("a a a a a. a a, a", None), ("x y z x y z\x0bx y z", "und"), ("the end of the end of the line! the end of  the line", "en"),
    ("É é ä Ä ß", "de"), (None, "en"), ("", None), (" . , ", "fr"), ("one", "fr"), ("\x00 b \x00 b \x00 b", "fr"), ("z" * 9000 + " q " + "z" * 9000 + " q", "fr"),
]


@pytest.mark.parametrize("least,most_words,top,cover,chunk", [(2, 3, 2000, 50, 1 << 20), (2, 3, 3, 50, 4), (1, 5, 50, 80, 30), (3, 2, 2000, 50, 10), (2, 4, 2000, 101, 1)])
def test_by_hand(spark, least, most_words, top, cover, chunk, monkeypatch):
    docs = spark.createDataFrame(ROWS * 2, "text string, lang string").repartition(3)
    if chunk < 20:
        monkeypatch.setattr(phrases, "MOST_NAMES", 2)
    got = rows_of(phrases.collocations(docs, least=least, most_words=most_words, top=top, cover=cover, chunk=chunk))
    assert got == sorted(brute(ROWS * 2, least, most_words, top, cover)) and got


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    level = spark.createDataFrame([(1, "en", "a b", 10**12, [4 * 10**12, 10**12], [5 * 10**12, 10**12])], "id bigint, lang string, phrase string, f bigint, firsts array<bigint>, lasts array<bigint>")
    assert phrases.scored(level, 2).select(F.col("score")).first()[0] == 1_000_000 * 10**24 // (20 * 10**24)


def test_sql(spark, sf):
    path = f"{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = sorted(con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({phrases.sql()})").fetchall())
    assert rows_of(phrases.collocations(spark.read.parquet(path))) == want and len(want) > 20


def test_odd_tables(spark):
    schema = "text string, lang string, chunk int, f string, id string, left string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b", "en", 1, "x", "y", "z")], schema)).collect() == []
    assert [r.phrase for r in phrases.collocations(spark.createDataFrame([("a b", "en", 1, "x", "y", "z")] * 10, schema)).collect()] == ["a b"]
