"""Personal data: fixed patterns, and terms that give protected entities away.

The patterns find the entities (mail addresses, IPv4 addresses, card and phone numbers). Corpus
co-occurrence by document then estimates how much a term tells about an entity, in the way of
information-theoretic sanitisation: with ``p`` the share of documents, the disclosure of entity ``e``
by term ``t`` is ``PMI(t, e) / IC(e) = log(p(t, e) / (p(t) p(e))) / -log p(e)``, 1 if the term
determines the entity and 0 if they are independent. Terms at or above ``GENERALISE`` are
generalised to their shape, those at or above ``REMOVE`` removed, wherever they are, also in documents
without any entity. A pair counts only if the entity was seen in ``SUPPORT`` different surroundings in
documents with the term, so that mere copies of one passage prove nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heatgraph.llm.tables import slices, texts
from heatgraph.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE = 0.8, 0.95
SUPPORT = 3
WINDOW = 8
BLOCK = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits, so the look-behind only saves time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"\w+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From each @ back over the local part, which is the leftmost match, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` in code points, by start, then kind as listed in ``KINDS``."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _outside(spans: list[Span]) -> Callable[[re.Match], bool]:
    """Whether a match touches no span."""
    starts, ends = [], []  # the spans without overlaps
    for _, a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)

    def free(m: re.Match) -> bool:
        i = bisect_left(starts, m.end())
        return i == 0 or ends[i - 1] <= m.start()

    return free


def _entity(text: str, span: Span) -> int:
    return _hash(f"{span[0]}|{text[span[1] : span[2]].lower()}")


def _before(text: str, at: int, count: int) -> list[str]:
    """The last ``count`` words before ``at``, whole whatever their length."""
    reach = 16 * (count + 1)
    while True:
        start = max(0, at - reach)
        found = [m.group().lower() for m in _TERM.finditer(text, start, at)]
        if not start:
            return found[-count:] if count else []
        if len(found) > count:  # the first may be cut
            return found[len(found) - count :]
        reach *= 4


def _after(text: str, at: int, count: int) -> list[str]:
    return [m.group().lower() for m in islice(_TERM.finditer(text, at), count)]


def evidence(text: str, spans: list[Span], window: int) -> tuple[dict[int, set[int]], set[int]]:
    """The entities with their surroundings (``window`` words each side, over line ends), and all terms of the text."""
    free = _outside(spans)
    places: dict[int, set[int]] = {}
    for kind, a, b in spans:
        left, right = _before(text, a, window), _after(text, b, window)
        places.setdefault(_entity(text, (kind, a, b)), set()).add(_hash(" ".join([*left, "", *right])))
    return places, {_hash(w) for w in {m.group().lower() for m in _TERM.finditer(text) if free(m)}}


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("entity", pa.int64()), ("arounds", pa.list_(pa.int64()))]))


def _evidence(docs: DataFrame, id_col: str, text_col: str, window: int, support: int) -> DataFrame:
    """``(id, digest, places, words)`` of the documents with entities; of a document ``support`` surroundings do."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, digest, places, words = [], [], [], []
            for i, t in enumerate(texts(batch)):
                if spans := base_spans(t):
                    seen, terms = evidence(t, spans, window)
                    rows.append(i)
                    digest.append(_hash(t))
                    places.append([{"entity": e, "arounds": sorted(a)[: max(1, support)]} for e, a in seen.items()])
                    words.append(list(terms))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(digest, pa.int64()), pa.array(places, _PLACES), pa.array(words, pa.list_(pa.int64()))],
                ["id", "digest", "places", "words"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, digest bigint, places array<struct<entity:bigint,arounds:array<bigint>>>, words array<bigint>")


def _document_counts(docs: DataFrame, text_col: str, flush: int = 400_000) -> DataFrame:
    """``(term, df)``: in how many documents each term is, all documents; summed first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            keys = [_hash(w) for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in slices(batches, "text"):
            for text in texts(batch):
                counts.update({w.lower() for w in set(_TERM.findall(text))})
            if len(counts) > flush:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def _doc_keys(found: DataFrame) -> DataFrame:
    """``found`` with ``d1, d2``, 128 bits that stand for a document (id and text), instead of both."""
    keys = [F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), "digest", F.lit(i)).alias(f"d{i}") for i in (1, 2)]
    return found.select(*keys, *[c for c in found.columns if c not in ("id", "digest")])


def most_documents(k: Column, total: float, generalise: float) -> Column:
    """In how many of ``total`` documents a term may be at most if it is to disclose an entity of ``k`` documents.

    With ``b <= min(k, df)`` documents in common, ``log(N b / (df k)) >= g log(N / k)`` needs ``df <= k (N / k) ** (1 - g)`` where ``df``
    is over ``k``; a thousandth more keeps rounding from mattering.
    """
    return F.greatest(k.cast("double"), k * F.pow(total / k, F.lit(1 - generalise))) * 1.001


def document_disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, window: int = WINDOW, generalise: float = 0.0) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs in the same documents, however far apart, with enough support; those below ``generalise`` may be missing.

    A document is an id with a text: null ids count like any other, repeated rows once for an entity and
    as often as given for the frequency of terms. All pairs are listed here, which are many where documents list many entities;
    ``disclosing`` works on one of each kind.
    """
    told, entities, terms = _disclosures(docs, id_col, text_col, support, window, generalise)
    named = told.withColumnRenamed("entity", "like_entity").withColumnRenamed("term", "like")
    return named.join(entities, "like_entity").join(terms.select("term", "like"), "like").select("entity", "term", "disclosure")


def _disclosures(docs: DataFrame, id_col: str, text_col: str, support: int, window: int, generalise: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The disclosures ``(entity, term, disclosure)`` of representatives, and ``(entity, like_entity)`` and ``(term, df, like)``.

    No document pairs all its entities with all its words: entities whose surroundings are spread over the same documents, and terms of
    the same documents and frequency, are equal in every count, so one of each stands for all; and terms that are too
    frequent to reach ``generalise`` for any entity of a document go before.
    """
    total = float(max(1, docs.count()))
    doc = ["d1", "d2"]
    found = cut(_doc_keys(_evidence(docs, id_col, text_col, window, support)).dropDuplicates(doc))
    seen = found.select(*doc, F.explode("places").alias("x")).select(*doc, "x.entity", "x.arounds")
    around = seen.select(*doc, "entity", F.explode("arounds").alias("around")).groupBy("entity", "around").agg(*[F.bit_xor(d).alias(d) for d in doc])
    label = [F.sum(F.xxhash64(*doc, F.lit(i)).cast("decimal(38,0)")).alias(f"e{i}") for i in (1, 2)]
    spread = around.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), *label).where(F.col("n") >= support)
    kinds = ["e1", "e2", "n"]
    spread = cut(spread)
    alike = cut(spread.join(spread.groupBy(*kinds).agg(F.min("entity").alias("like_entity")), kinds).select("entity", "like_entity"))
    placed = cut(seen.join(alike.where(F.col("entity") == F.col("like_entity")).select("entity"), "entity"))
    of = placed.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).withColumn("most", most_documents(F.col("of_entity"), total, generalise))
    placed = cut(placed.join(of, "entity"))
    reach = placed.groupBy(*doc).agg(F.max("most").alias("reach"))
    words = found.join(reach, doc).select(*doc, "reach", F.explode("words").alias("term"))
    terms = words.groupBy("term").agg(*[F.bit_xor(d).alias(d) for d in doc], F.max("reach").alias("reach"))
    known = terms.join(_document_counts(docs, text_col), "term").where(F.col("df") <= F.col("reach")).select("term", "df", *doc)
    like = cut(known.join(known.groupBy(*doc, "df").agg(F.min("term").alias("like")), [*doc, "df"]).select("term", "df", "like"))
    chosen = like.where(F.col("term") == F.col("like")).select("term", "df")
    held = words.join(chosen, "term").where(F.col("df") <= F.col("reach")).select(*doc, "term", "df")
    both = placed.join(held, doc).where(F.col("df") <= F.col("most"))
    # a document counts at the first of its surroundings
    counted = both.select("entity", "term", "df", "of_entity", F.posexplode("arounds").alias("at", "around"))
    places = counted.groupBy("entity", "term", "df", "of_entity", "around").agg(F.count_if(F.col("at") == 0).alias("n"))
    pairs = places.groupBy("entity", "term", "df", "of_entity").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("both")).where(F.col("support") >= support)
    pmi = F.log(total * F.least("both", "of_entity", "df") / (F.col("df") * F.col("of_entity")))
    content = F.log(total / F.col("of_entity"))
    return pairs.select("entity", "term", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")), alike, like


def estimated_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """``(entities, estimated)``: how many entities there are, and how many have the surroundings that an estimate asks for."""
    seen = _evidence(docs, id_col, text_col, window, support).select(F.explode("places").alias("x")).select("x.entity", F.explode("x.arounds").alias("around"))
    each = seen.groupBy("entity").agg(F.countDistinct("around").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") >= support).alias("estimated"))


def disclosing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """``(term, disclosure)``: the terms that disclose any entity, with the most that they disclose."""
    told, _, like = _disclosures(docs, id_col, text_col, support, window, generalise)
    most = told.where(F.col("disclosure") >= generalise).groupBy(F.col("term").alias("like")).agg(F.max("disclosure").alias("disclosure"))
    return cut(like.join(most, "like").select("term", "disclosure"))


class Told:
    """The disclosing terms of a block, looked up by spelling."""

    def __init__(self, terms: np.ndarray, disclosure: np.ndarray, cache: int = 1 << 18):
        self.terms, self.disclosure, self.cache, self.known = terms, disclosure, cache, {}

    def _look(self, word: str) -> float:
        key = _hash(word.lower())
        at = int(np.searchsorted(self.terms, key))
        return float(self.disclosure[at]) if at < len(self.terms) and self.terms[at] == key else 0.0

    def __call__(self, text: str, spans: list[Span]) -> list[tuple[int, int, float]]:
        """``(start, end, disclosure)`` of every place of the terms outside the spans."""
        if not len(self.terms):
            return []
        if len(self.known) > self.cache:
            self.known.clear()
        known, told = self.known, False
        for word in set(_TERM.findall(text)):
            found = known.get(word)
            if found is None:
                found = known[word] = self._look(word)
            told = told or found > 0
        if not told:
            return []
        free = _outside(spans)
        return [(*m.span(), known[m.group()]) for m in _TERM.finditer(text) if known.get(m.group()) and free(m)]


def _blocks(told: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms in sorted blocks, read one after the other; at least one."""
    held: list = []
    first = True
    for row in told.orderBy("term").toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield np.array([r["term"] for r in held], np.int64), np.array([r["disclosure"] for r in held])
            held, first = [], False
    if held or first:
        yield np.array([r["term"] for r in held], np.int64), np.array([r["disclosure"] for r in held], float)


_TERMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("disclosure", pa.float64())]))


def _free(name: str, columns: list[str]) -> str:
    """``name``, longer while a column is called so."""
    while name in columns:
        name += "_"
    return name


Finish = Callable[[list[pa.Array], list[str], list[list[Span]], list[list[dict]]], pa.RecordBatch]


def _marked(docs: DataFrame, text_col: str, told: DataFrame, block: int, finish: Finish, schema: StructType | str) -> DataFrame:
    """What ``finish`` makes of each batch: of the columns of ``docs``, the texts, their base spans, and the places of all disclosing terms, by start.

    Texts are searched block after block of terms in one pass of tasks; base spans are found once, by the first.
    """
    sc, names = docs.sparkSession.sparkContext, docs.columns
    base, terms = _free("_base", names), _free("_terms", names)
    added = StructType.fromDDL(f"{base} array<struct<kind:string,start:bigint,end:bigint>>, {terms} array<struct<start:bigint,end:bigint,disclosure:double>>")
    carried = StructType([*docs.schema.fields, *added.fields])

    def scan(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Told(*shared.value)
            for batch in slices(batches, text_col):
                own, found = list(batch.columns[: len(names)]), texts(batch, text_col)
                if first:
                    spans, before = [base_spans(t) for t in found], [[]] * len(found)
                else:
                    spans = [[(x["kind"], x["start"], x["end"]) for x in s] for s in batch.column(len(names)).to_pylist()]
                    before = batch.column(len(names) + 1).to_pylist()
                marks = [sorted([*b, *({"start": x, "end": y, "disclosure": d} for x, y, d in find(t, s))], key=lambda x: x["start"]) for t, s, b in zip(found, spans, before)]
                if last:
                    yield finish(own, found, spans, marks)
                else:
                    yield pa.RecordBatch.from_arrays([*own, _spelled(spans), pa.array(marks, _TERMS)], [*names, base, terms])

        return run

    out, parts = docs, _blocks(told, block)
    part, first = next(parts), True
    while part is not None:
        following = next(parts, None)
        out = out.mapInArrow(scan(sc.broadcast(part), first, following is None), carried if following is not None else schema)
        part, first = following, False
    return out


def _spelled(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _SPANS)


def personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = GENERALISE,
    support: int = SUPPORT,
    window: int = WINDOW,
    most: int = BLOCK,
) -> DataFrame:
    """``(id_col, digest, base, terms)`` for every row: spans of the patterns, and of disclosing terms.

    ``terms`` has ``(start, end, disclosure)`` by start, every place of a term that discloses an entity,
    whether that is in the text or not; offsets are code points, ends exclusive; terms never overlap
    base spans. ``digest`` (hash of the text) tells rows of one id apart. Null texts are empty and have
    no spans. Repeated rows and null ids come back as given; an empty table gives an empty result;
    other columns are not read. Terms go out in broadcast blocks of ``most``.
    """
    told = disclosing(docs, id_col, text_col, generalise, support, window)
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(own: list[pa.Array], found: list[str], spans: list[list[Span]], marks: list[list[dict]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own[0], pa.array([_hash(t) for t in found], pa.int64()), _spelled(spans), pa.array(marks, _TERMS)], ["id", "digest", "base", "terms"])

    schema = f"id {kind}, digest bigint, base array<struct<kind:string,start:bigint,end:bigint>>, terms array<struct<start:bigint,end:bigint,disclosure:double>>"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _marked(source, "text", told, most, finish, schema).withColumnRenamed("id", id_col)


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash and spelling of the spans of ``personal_data``."""
    spell = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform("base", spell), ",")
    rank = lambda x: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), x["kind"])
    as_span = lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    every = F.transform(
        F.array_sort(F.transform(F.concat("base", F.transform("terms", as_span)), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        spell,
    )
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


def shape(term: str) -> str:
    """What a generalised term becomes."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitised(text: str, base: list[Span], terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """The text with entities replaced by their kind, and disclosing terms generalised or removed."""
    edits = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    edits += [(a, b, "" if d >= remove else shape(text[a:b])) for a, b, d in terms]
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a < at:  # inside what was just replaced: keep nothing of it
            at = max(at, b)
            continue
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = BLOCK,
    generalise: float = GENERALISE,
    support: int = SUPPORT,
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with sanitised texts, all columns and rows kept; ``n_chars``, if there, follows the text.

    Texts do not move: patterns and terms are found again where the text is, the terms by broadcast
    blocks of ``most``. Null and empty texts stay as they are.
    """
    told = disclosing(docs, id_col, text_col, generalise, support, window)
    columns = docs.columns
    at = columns.index(text_col)

    def finish(kept: list[pa.Array], found: list[str], spans: list[list[Span]], marks: list[list[dict]]) -> pa.RecordBatch:
        there = kept[at].is_valid().to_pylist()
        new = [sanitised(t, s, [(x["start"], x["end"], x["disclosure"]) for x in m]) if own else None for t, s, m, own in zip(found, spans, marks, there)]
        kept[at] = pa.array(new, pa.string())
        if "n_chars" in columns:
            i = columns.index("n_chars")
            kept[i] = pa.array([o if t is None else len(t) for t, o in zip(new, kept[i].to_pylist())], pa.int64()).cast(kept[i].type)
        return pa.RecordBatch.from_arrays(kept, columns)

    return _marked(docs, text_col, told, most, finish, docs.schema)
