"""Collocations by hierarchical pair naming.

Texts are held as chunks: sequences of small numbers beside a dictionary of what these stand for. A
level of naming joins the dictionaries (never the occurrences) with the frequent units of all
documents, replaces the numbers by those globally joined ids, and numbers which ids stand side by
side; the pairs found are the units of the next level. All chunks' pairs meet in buckets by hash, where they are counted, the
frequent ones named, and the names given back to the chunks. So a phrase of ``k`` words is a pair of phrases
of ``k - 1`` words, and its two ids are parent pointers: the left one leads to all its beginnings, the
right one to all its endings, and it tells both what longer phrase they are part of.

A phrase is only as frequent as its parts, so dropping the infrequent units of a level loses nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.llm.tables import packed, release, slices, unpacked
from heatgraph.plans.lineage import dropped, stored

LEAST, MOST_WORDS, TOP, COVER, SCALE = 10, 3, 2000, 50, 1_000_000
UNKNOWN = "und"
#: Words that a task holds in chunks, one for each language (more only if one document has more).
CHUNK = 1 << 21
#: Frequent words up to this number are broadcast to the dictionaries; more of them are shuffled with these.
MOST_NAMES = 1_000_000
#: Places of words for each bucket of pairs.
BUCKET = 2_000_000

_CUT = re.compile(r"[.,;:!?\x0a-\x0d]+")
_CUT_MARK = "\n"  # can't be a word, as it ends a piece


class _Chunk:
    """Words of one language, as numbers; -1 wherever a piece ends."""

    def __init__(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[""], self.numbers[_CUT_MARK] = 0, 1
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        words = _CUT.sub(f" {_CUT_MARK} ", text).replace("\t", " ").split(" ")
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        found = found[found != 0]
        self.parts += [found, np.ones(1, np.int32)]
        self.size += len(found) + 1

    def row(self, lang: str) -> tuple:
        codes = np.concatenate(self.parts) - 2
        units = list(self.numbers)[2:]
        self.numbers.default_factory = None  # it refers to the numbers, which go as soon as nothing does
        return lang, packed(codes + 1), units, np.bincount(codes[codes >= 0], minlength=len(units))


_CHUNK = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("units", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _chunks(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """``(chunk, lang, codes, units, counts)``: all words of all documents, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Chunk] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, chunk in held.items():
                row = chunk.row(lang)
                if row[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK.types)], schema=_CHUNK)
            held.clear()

        for batch in slices(batches, "text"):
            lower = pc.fill_null(pc.ascii_lower(batch.column(1)), "")
            for lang, text in zip(batch.column(0).to_pylist(), lower.to_pylist()):
                held.setdefault(lang, _Chunk()).add(text)
                if sum(c.size for c in held.values()) > size:
                    yield from out()
        yield from out()

    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    found = source.mapInArrow(run, "lang string, codes binary, units array<string>, counts array<bigint>")
    return found.withColumn("chunk", F.monotonically_increasing_id())  # for good once it is written


def _places(units: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``(chunk, code, id)`` as ``(chunk, placed)``: codes and ids of a chunk packed together, where they are."""
    schema = pa.schema([("chunk", pa.int64()), ("placed", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            chunk, code, name = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, chunk))
            chunk, code, name = chunk[order], code[order], name[order]
            ends = np.flatnonzero(np.diff(chunk, append=-1)) + 1
            bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
            rows = [[packed(code[a:b]), packed(name[a:b], "<i8")] for a, b in bounds]
            return pa.RecordBatch.from_arrays([pa.array(chunk[ends - 1]), pa.array(rows, pa.list_(pa.binary()))], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
            if n >= most:
                yield out()
                held, n = [], 0
        if held:
            yield out()
        held.clear()
        release()

    return units.select("chunk", "code", "id").mapInArrow(run, "chunk bigint, placed array<binary>")


_PAIRED = pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("bucket", pa.int64()), ("units", pa.list_(pa.binary()))])
_KINDS = ("<u4", "<i8", "<i8", "<i8")  # of codes, left ids, right ids and counts
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # odd numbers that spread ids over buckets


def _paired(chunks: DataFrame, placed: DataFrame, buckets: int) -> DataFrame:
    """Sequences of the next level: ids of ``placed`` side by side, numbered in each chunk.

    Of each chunk a row with the ``codes`` of the sequence, and one for each of its buckets with ``units``: codes, left ids, right
    ids and counts of its pairs. ``placed`` has codes and ids, packed, in any number of rows of a chunk.
    """

    def run(sequence: pa.Table, names: pa.Table) -> Iterator[pa.RecordBatch]:
        if not sequence.num_rows or not names.num_rows:
            return
        chunk = sequence.column("chunk")[0].as_py()
        codes = unpacked(sequence.column("codes")[0].as_py()) - 1  # the end of a piece is -1
        found = [(unpacked(x[0]), unpacked(x[1], "<i8")) for x in names.column("placed").to_pylist()]
        code, name = (np.concatenate(x) for x in zip(*found))
        ids = np.full(max(int(codes.max(initial=-1)), int(code.max())) + 2, -1, np.int64)  # the last one stands for -1
        ids[code] = name
        known = ids[codes] >= 0
        both = np.flatnonzero(known[:-1] & known[1:])
        unique, number, counts = np.unique(codes[both] * len(ids) + codes[both + 1], return_inverse=True, return_counts=True)
        following = np.zeros(max(len(codes) - 1, 0), np.int64)
        following[both] = number + 1
        left, right = ids[unique // len(ids)], ids[unique % len(ids)]
        mixed = (left.astype(np.uint64) * _MIX[0]) ^ (right.astype(np.uint64) * _MIX[1])
        bucket = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        rows = [(chunk, packed(following), None, None)]
        for first, last in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = order[first:last]
            rows.append((chunk, None, int(bucket[own[0]]), [packed(x[own], kind) for x, kind in zip((np.arange(len(unique)), left, right, counts), _KINDS)]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAIRED.types)], schema=_PAIRED)
        release()

    def whole(sequence: pa.Table, names: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(sequence, names), _PAIRED)

    sequences = chunks.select("chunk", "codes").groupBy("chunk")
    return sequences.cogroup(placed.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(whole, "chunk bigint, codes binary, bucket bigint, units array<binary>")


_NAMED = pa.schema([("chunk", pa.int64()), ("placed", pa.list_(pa.binary())), ("id", pa.list_(pa.int64())), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])


def _named_pairs(paired: DataFrame, least: int, place: bool) -> DataFrame:
    """Of each bucket a row with the frequent pairs ``(id, left, right, f)`` and, with ``place``, for each chunk the codes and ids of its own."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        parts = [[unpacked(x, kind) for x, kind in zip(row, _KINDS)] for row in table.column("units").to_pylist()]
        code, left, right, n = (np.concatenate(x) for x in zip(*parts))
        lefts, a = np.unique(left, return_inverse=True)
        rights, b = np.unique(right, return_inverse=True)
        pairs, number = np.unique(a * len(rights) + b, return_inverse=True)
        f = np.bincount(number, n, len(pairs)).astype(np.int64)  # exact below 2 ** 53
        often = np.flatnonzero(f >= least)
        ids = np.full(len(pairs), -1, np.int64)
        ids[often] = (key[0].as_py() << 32) + np.arange(len(often))
        rows = [(None, None, ids[often], lefts[pairs[often] // len(rights)], rights[pairs[often] % len(rights)], f[often])] if len(often) else []
        if place:
            at = 0
            for chunk, part in zip(table.column("chunk").to_pylist(), parts):
                own = ids[number[at : at + len(part[0])]]
                at += len(part[0])
                if (own >= 0).any():
                    rows.append((chunk, [packed(part[0][own >= 0]), packed(own[own >= 0], "<i8")], None, None, None, None))
        out = pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_NAMED.types)], schema=_NAMED)
        release()
        return out

    pairs = paired.where(F.col("bucket").isNotNull()).select("chunk", "bucket", "units")
    return pairs.groupBy("bucket").applyInArrow(run, "chunk bigint, placed array<binary>, id array<bigint>, left array<bigint>, right array<bigint>, f array<bigint>")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``, and for each length the frequent phrases ``(id, lang, phrase, last, f, firsts, lasts, left, right)``.

    ``n`` counts all words of a language, ``f`` all places of the phrase inside pieces, overlaps included.
    ``firsts`` has the counts of the phrase's first 1, 2, ... words (the last entry is ``f``), ``lasts`` those
    of its last 1, 2, ... words; ``left`` and ``right`` are the ids of its two parents.

    Null texts are empty, null languages ``und``; repeated rows count as often as given; ids aren't needed.
    """
    held = stored(_chunks(docs, text_col, lang_col, chunk))
    zipped = F.arrays_zip("units", "counts")
    units = held.select("chunk", "lang", F.posexplode(zipped).alias("code", "x")).select("chunk", "lang", "code", F.col("x.units").alias("word"), F.col("x.counts").alias("n"))
    counted = units.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    totals = stored(held.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    one = F.array("f")
    words = stored(counted.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"))  # written, so that ids stay what they are
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", one.alias("firsts"), one.alias("lasts"), F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"))]
    names = words.select("lang", "word", "id")
    few = names.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    placed = _places(units.join(F.broadcast(names) if few else names, ["lang", "word"]))
    buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET
    for k in range(2, most_words + 1):
        paired = _paired(held, placed, buckets)
        if k < most_words:
            paired = stored(paired)
            dropped(held)
            held = paired.where(F.col("codes").isNotNull())
        found = stored(_named_pairs(paired, least, k < most_words))
        zipped = F.explode(F.arrays_zip("id", "left", "right", "f")).alias("x")
        pairs = found.where(F.col("chunk").isNull()).select(zipped).select("x.*")
        left = levels[-1].select(F.col("id").alias("left"), "lang", "phrase", "firsts")
        right = levels[-1].select(F.col("id").alias("right"), "last", "lasts")
        own = F.array("f")
        spelled = pairs.join(left, "left").join(right, "right").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("firsts", own).alias("firsts"), F.concat("lasts", own).alias("lasts"), "left", "right")
        levels.append(stored(spelled))
        placed = found.where(F.col("chunk").isNotNull()).select("chunk", "placed")
    dropped(held)
    return totals, levels


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(level: DataFrame, words: int) -> DataFrame:
    """``(lang, phrase, id, a, l, r, score)``: by the cut of the lowest score, of equals the first."""
    cuts = []
    for k in range(1, words):
        l, r = F.col("firsts")[k - 1], F.col("lasts")[words - k - 1]  # noqa: E741
        score = F.call_function("div", _wide(F.lit(SCALE)) * F.col("f").cast("decimal(16,0)") * F.col("f").cast("decimal(16,0)"), l.cast("decimal(19,0)") * r.cast("decimal(19,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    least = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return level.withColumn("c", least).select("lang", "phrase", "id", F.col("f").alias("a"), "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, cover: int = COVER, chunk: int = CHUNK) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``most_words`` words.

    ``score`` is the lowest of ``floor(1000000 a a / (l r))`` over the cuts, exact. Phrases inside a longer one
    of at least ``cover`` percent of their count go first. An empty table, or one without frequent phrases, gives an empty result.
    """
    totals, levels = phrases(docs, text_col, lang_col, least, most_words, chunk)
    kept = []
    for words, level in enumerate(levels[1:], 2):
        found = scored(level, words)
        if words < most_words:  # the parents of a phrase are what it covers, and no longer one is more frequent
            above = levels[words]
            over = above.select(F.col("left").alias("id"), "f").unionByName(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("over"))
            found = found.join(over, "id", "left").where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a"))).drop("over")
        kept.append(found)
    every = kept[0]
    for x in kept[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, top: int = TOP, cover: int = COVER) -> str:
    """The same for 2 and 3 words as DuckDB SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cuts = "1000000::hugeint * a * a // (l::hugeint * r)"
    return f"""with pieces as (select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
  seqs as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces),
  places as (select lang, w, unnest(range(1, len(w) + 1)) as i from seqs),
  one as materialized (select lang, w[i] as p, count(*) as f from places group by 1, 2),
  two as materialized (select lang, w[i] as x, w[i + 1] as y, count(*) as a from places where i < len(w) group by 1, 2, 3 having count(*) >= {least}),
  three as materialized (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z, count(*) as a from places where i + 1 < len(w) group by 1, 2, 3, 4 having count(*) >= {least}),
  totals as (select lang, sum(f)::bigint as n from one group by lang),
  over as (select lang, x, y, max(a) as m from (select lang, x, y, a from three union all select lang, y, z, a from three) group by 1, 2, 3),
  short as (select t.lang, t.x || ' ' || t.y as phrase, t.a, p.f as l, q.f as r from two t join one p on p.lang = t.lang and p.p = t.x join one q on q.lang = t.lang and q.p = t.y
    left join over o on o.lang = t.lang and o.x = t.x and o.y = t.y where o.m is null or 100 * o.m < {cover} * t.a),
  long as (select t.lang, t.x || ' ' || t.y || ' ' || t.z as phrase, t.a, p.f as l1, yz.a as r1, xy.a as l2, q.f as r2 from three t
    join one p on p.lang = t.lang and p.p = t.x join one q on q.lang = t.lang and q.p = t.z
    join two xy on xy.lang = t.lang and xy.x = t.x and xy.y = t.y join two yz on yz.lang = t.lang and yz.x = t.y and yz.y = t.z),
  cut as (select lang, phrase, a, l, r, {cuts} as score from short
    union all select lang, phrase, a, case when {cuts.replace('l::', 'l1::').replace('* r)', '* r1)')} <= {cuts.replace('l::', 'l2::').replace('* r)', '* r2)')} then l1 else l2 end as l,
      case when {cuts.replace('l::', 'l1::').replace('* r)', '* r1)')} <= {cuts.replace('l::', 'l2::').replace('* r)', '* r2)')} then r1 else r2 end as r,
      least({cuts.replace('l::', 'l1::').replace('* r)', '* r1)')}, {cuts.replace('l::', 'l2::').replace('* r)', '* r2)')}) as score from long),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from cut)
  select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= {top}"""
