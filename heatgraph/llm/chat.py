"""Preference formatting of chosen and rejected conversations, all in DataFrame functions.

The longest common prefix of turns (same role, same text) is rendered once as the prompt. What each
conversation has beyond it is its completion, with the code points that are to be learned: the
assistant's texts and their end marks, nothing of headers or of other roles.

Where a table holds conversations but no preferences, :func:`negative_pairs` makes pairs: a
conversation up to its last assistant turn is chosen; rejected is the same with the last answer of
the next conversation in place of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.plans.lineage import cut
from heatgraph.plans.ranges import range_bounds, range_index

#: The chat template.
HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)``, turns by number, then role and text.

    Null roles and texts are empty; a null turn number comes first; turns of a null id form one
    conversation. A repeated row is a repeated turn. An empty table gives an empty result; other
    columns are not read.
    """
    picked = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    grouped = picked.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def negative_pairs(talks: DataFrame) -> DataFrame:
    """``(pair_id, rejected_id, chosen, rejected)`` of every conversation with an id and an assistant turn.

    Next is by id, after the last the first; so a single conversation is paired with itself. Ids are
    ranked in ranges, of which only the first ids meet in one task. Ids are numbers, as ranges are cut by value.
    """
    spark = talks.sparkSession
    answers = F.transform("turns", lambda t: t["role"] == LEARNED)
    last = F.size("turns") - F.array_position(F.reverse(answers), True) + 1
    held = talks.where(F.col("conv_id").isNotNull() & F.array_contains(answers, True)).select("conv_id", F.slice("turns", 1, last).alias("turns"))
    held = cut(held)
    ranges = range_bounds(held, "conv_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = held.select("conv_id", range_index(F.col("conv_id"), ranges).alias("part"))
    firsts = placed.groupBy("part").agg(F.min("conv_id").alias("first"))
    whole = Window.orderBy("part")
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("part", F.coalesce(F.lead("first").over(whole), F.first("first").over(around)).alias("after"))
    within = F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id"))
    pairs = placed.withColumn("within", within).join(F.broadcast(following), "part")  # at most one row for each range
    pairs = pairs.select(F.col("conv_id").alias("pair_id"), F.coalesce("within", "after").alias("rejected_id"))
    answer = held.select(F.col("conv_id").alias("rejected_id"), F.element_at("turns", -1).alias("answer"))
    own = held.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"))
    stem = F.slice("chosen", 1, F.size("chosen") - 1)
    return pairs.join(answer, "rejected_id").join(own, "pair_id").select(
        "pair_id", "rejected_id", "chosen", F.concat(stem, F.array("answer")).alias("rejected")
    )


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(TAIL), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans ``(start, end)`` in code points of what is learned in the rendered turns."""
    frame = len(HEAD) + len(TAIL) + len(END)
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + len(HEAD) + len(TAIL)
        end = state["at"] + F.length(t["role"]) + F.length(t["text"]) + frame
        span = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        spans = F.when(t["role"] == LEARNED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds ``prefix_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask`` in place of the turns.

    All other columns are kept, save that one of these six names is replaced. Null conversations have no turns. Equal conversations, or one that continues the other, have an
    empty completion with an empty mask.
    """
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    made = ("prefix_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *made)]
    # nested, so that no name of the input can meet a name used here
    a, b = F.coalesce(F.col(chosen), none).alias("a"), F.coalesce(F.col(rejected), none).alias("b")
    own = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own")] if kept else []
    taken = pairs.select(*own, a, b)
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & (x["role"] == y["role"]) & (x["text"] == y["text"]))
    # the first turn that differs; beyond both ends there is one that does
    taken = taken.withColumn("n", (F.array_position(F.concat(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.array(F.lit(False))), False) - 1).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    found = (F.col("n"), _rendered(F.slice("a", 1, F.col("n"))), _rendered(rest("a")), _mask(rest("a")), _rendered(rest("b")), _mask(rest("b")))
    return taken.select(*[F.col("own")[c].alias(c) for c in kept], *[f.alias(name) for f, name in zip(found, made)])


def digest(rows: DataFrame) -> DataFrame:
    """The formatted pairs with masks spelt as ``start-end,...``."""
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return rows.select("pair_id", "rejected_id", "prefix_turns", "prompt", "chosen_text", spell("chosen_mask"), "rejected_text", spell("rejected_mask"))


def sql() -> str:
    """The same over ``conversations`` in one statement."""
    turn = f"'{HEAD}' || role || '{TAIL}' || text || '{END}'".replace("\n", "' || chr(10) || '")
    head = len(HEAD) + len(LEARNED) + len(TAIL)

    def body(text: str, out: str) -> str:
        rendered = turn.replace("role", f"'{LEARNED}'").replace("|| text ||", f"|| {text} ||")
        return f"""case when own = other then '' else {rendered} end as {out}_text,
          case when own = other then '' else '{head}-' || cast({head + len(END)} + length({text}) as varchar) end as {out}_mask"""

    return f"""with t as materialized (select conv_id, row_number() over (partition by conv_id order by turn, role, text) as k, role, text
      from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
    last as (select conv_id, max(k) as k from t where role = '{LEARNED}' group by conv_id),
    answers as (select conv_id, k, text from last join t using (conv_id, k)),
    pairs as (select conv_id as pair_id, coalesce(lead(conv_id) over (order by conv_id), min(conv_id) over ()) as rejected_id from answers),
    duo as (select p.pair_id, p.rejected_id, a.k, a.text as own, b.text as other from pairs p join answers a on a.conv_id = p.pair_id join answers b on b.conv_id = p.rejected_id),
    prompts as (select conv_id as pair_id, string_agg({turn}, '' order by t.k) as prompt from t join duo on conv_id = pair_id and (t.k < duo.k or t.k = duo.k and own = other) group by conv_id)
    select pair_id, rejected_id, cast(case when own = other then k else k - 1 end as integer) as prefix_turns, coalesce(prompt, '') as prompt, {body("own", "chosen")}, {body("other", "rejected")}
    from duo left join prompts using (pair_id)"""
