import random

import duckdb

from heatgraph.llm import chat

TURN = "role string, text string"


def render(turns):
    text, spans = "", []
    for role, body in turns:
        start = len(text) + len(f"<|{role}|>\n")
        text += f"<|{role}|>\n{body}<|end|>\n"
        if role == "assistant":
            spans.append((start, len(text)))
    return text, spans


def plain(a, b):
    a, b = a or [], b or []
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (n, render(a[:n])[0], *render(a[n:]), *render(b[n:]))


def test_pairs_like_plain_form(spark):
    rng = random.Random(10)
    turn = lambda: (rng.choice(["user", "assistant", "system", ""]), rng.choice(["", "a", "bé🙂", "c d"]))
    rows = []
    for i in range(200):
        stem = [turn() for _ in range(rng.randint(0, 4))]
        rows.append((i, stem + [turn() for _ in range(rng.randint(0, 4))], stem + [turn() for _ in range(rng.randint(0, 4))], "extra"))
    rows += [(200, None, [("user", "x")], ""), (201, None, None, ""), (202, [], [], "")]
    frame = spark.createDataFrame(rows, f"pair_id int, chosen array<struct<{TURN.replace(' string', ':string')}>>, rejected array<struct<{TURN.replace(' string', ':string')}>>, prompt_ string")
    for r in chat.formatted(frame).collect():
        got = (r.prefix_turns, r.prompt, r.chosen_text, [tuple(s) for s in r.chosen_mask], r.rejected_text, [tuple(s) for s in r.rejected_mask])
        assert got == plain(*rows[r.pair_id][1:3])


def test_conversations_like_sql(spark, sf):
    from heatgraph.llm.queries import QUERIES

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op3_preference_format"](spark, sf).collect())
    assert got and got == sorted(con.sql(chat.sql()).fetchall())


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, turns string, part int"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "bye"), (2, 0, "assistant", "a"), (3, None, None, None), (None, 0, "assistant", "z"), (5, 0, "user", "q"), (5, 1, "assistant", None), (5, 1, "assistant", None)]
    pairs = lambda rows: {r.pair_id: r for r in chat.formatted(chat.negative_pairs(chat.conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)))).collect()}
    got = pairs(rows)
    assert {k: (r.rejected_id, r.prefix_turns) for k, r in got.items()} == {1: (2, 2), 2: (5, 0), 5: (1, 2)}
    assert got[1].chosen_text == "" and got[5].prompt.endswith("<|assistant|>\n<|end|>\n")
    assert {k: r.rejected_id for k, r in pairs(rows[:3]).items()} == {1: 1}
    assert pairs([]) == {}


def test_names_that_clash(spark):
    schema = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, _a int, _b int, a int, b int, n int, own int, prompt string, prefix_turns int"
    got = chat.formatted(spark.createDataFrame([(1, [("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "y")], 1, 2, 3, 4, 5, 6, "old", 9)], schema))
    assert got.columns == ["pair_id", "_a", "_b", "a", "b", "n", "own", "prefix_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask"]
    r = got.first()
    assert tuple(r)[:9] == (1, 1, 2, 3, 4, 5, 6, 1, "<|user|>\nq<|end|>\n")
    only = chat.formatted(spark.createDataFrame([([("user", "q")], None)], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"))
    assert only.first().prompt == ""
