"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment (match +1, mismatch and gap -1) of ``m`` matches and ``e`` edits scores ``m - e``. Its
matches stand in at most ``e + 1`` runs, so a score ``s`` holds ``s - 1`` or more word 2-grams of the
item, all within as many words as the item has plus the edits that the score allows. Texts are read
once: that pass counts the document frequency of every 2-gram of every test item over the whole corpus,
and keeps the word hashes around places dense enough in such 2-grams for any alignment that reaches
its score. 2-grams that no document holds can't be in an alignment. Of the others, all but the
``s - 1 - VOTES`` most frequent are seeds, so every alignment that reaches the score holds ``VOTES``
seeds (or all its 2-grams, if those are fewer). Rarity only ranks an item's own 2-grams: an item leaked
into a third of all documents keeps its seeds. Kept passages with so many seeds on near diagonals whose
words could reach the score at all are aligned with the item word by word. No leak is missed.

Items go out in broadcast blocks of at most ``BLOCK`` words, each compared with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heatgraph.llm.tables import slices
from heatgraph.plans.bounded import join_checked
from heatgraph.plans.lineage import cut, stored

GRAM = 2
VOTES = 2
THRESHOLD = 0.5
LEAST = 6
BLOCK = 1_000_000
_NOT_WORD = r"[^\p{L}\p{N}]+"
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(3)], np.uint64)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def word_hashes(tokens: pa.Array) -> np.ndarray:
    """64-bit hashes of the tokens in lower case, letters and digits only; 0 of those that have none."""
    lower = pc.utf8_lower(tokens)
    mixed = pc.invert(pc.utf8_is_alnum(lower))
    lower = pc.replace_with_mask(lower, mixed, pc.replace_substring_regex(lower.filter(mixed), _NOT_WORD, ""))
    ends = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    found = np.frombuffer(lower.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    powers = np.cumprod(np.full(size.max(initial=0) + 1, _FACTORS[0]))
    each = _BYTES[found] * powers[np.arange(len(found)) - np.repeat(starts, size)]
    hashed = np.add.reduceat(np.append(each, np.uint64(0)), starts) if len(starts) else np.zeros(0, np.uint64)
    hashed ^= hashed >> np.uint64(29)
    hashed *= _FACTORS[1]
    hashed ^= hashed >> np.uint64(32)
    return np.where(size > 0, hashed | np.uint64(1), np.uint64(0))


def column_words(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts of a column (null: none), and where each text's begin, one more than texts.

    Words are white-space tokens in lower case without their punctuation.
    """
    tokens = pc.utf8_split_whitespace(found.cast(pa.string()).fill_null(""))
    spelled = tokens.flatten().dictionary_encode()
    words = word_hashes(spelled.dictionary)[spelled.indices.to_numpy(zero_copy_only=False)]
    real = words != 0
    begin = np.concatenate([[0], np.cumsum(real)])[tokens.offsets.to_numpy() - tokens.offsets[0].as_py()]
    return words[real], begin


def words_of(text: str | None) -> np.ndarray:
    return column_words(pa.array([text], pa.string()))[0]


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the n-grams, one for each start."""
    count = len(words) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    mixed = np.full(count, n, np.uint64)
    for i in range(n):
        mixed += words[i : i + count] * _FACTORS[i]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the end (exclusive) of its first best alignment in item and passage."""
    same = np.where(item[:, None] == passage[None, :], 1, -1)
    steps = np.arange(len(passage))
    above = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i in range(len(item)):
        row = np.maximum(np.maximum(above[:-1] + same[i], above[1:] - 1), 0)
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j + 1)
        above[1:] = row
    return best


class Items:
    """A block of test items with their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray], threshold: float, least: int):
        self.ids, self.words, self.threshold = ids, words, threshold
        self.least = [min(len(w), max(least, int(np.ceil(threshold * len(w))))) for w in words]
        self.sizes = [min(GRAM, m) for m in self.least]
        self.grams = {n: [grams(w, n) if size == n else np.zeros(0, np.uint64) for w, size in zip(words, self.sizes)] for n in range(1, GRAM + 1)}
        self.sorted = [np.unique(w) for w in words]
        self.length = np.array([len(w) for w in words], np.int64)
        self.slack = self.length - np.array(self.least, np.int64)  # edits of an alignment that reaches the score, at most
        self.votes = np.array([max(1, min(VOTES, m - n + 1)) for m, n in zip(self.least, self.sizes)], np.int64)
        self.seeds: dict[int, np.ndarray] = {}
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def every(self) -> dict[int, np.ndarray]:
        """All distinct n-grams, by n (single words only for items that leak by one)."""
        return {n: np.unique(np.concatenate([*g, np.zeros(0, np.uint64)])) for n, g in self.grams.items()}

    def dense(self) -> dict[int, list[tuple[int, int]]]:
        """``(hits, words)`` by n: an alignment that reaches the score has so many n-grams within so many words.

        Items of like numbers of hits share the least of them and the most words.
        """
        out: dict[int, dict[int, tuple[int, int]]] = {n: {} for n in self.grams}
        for i, n in enumerate(self.sizes):
            if len(self.words[i]):
                hits, width = self.least[i] - n + 1, int(self.length[i] + self.slack[i])
                like = int(4 * np.log2(hits))
                low, most = out[n].get(like, (hits, width))
                out[n][like] = min(low, hits), max(most, width)
        return {n: sorted(found.values()) for n, found in out.items()}

    def choose(self, every: dict[int, np.ndarray], frequency: dict[int, np.ndarray]) -> None:
        """Seeds: of an item's n-grams in the corpus all but the most frequent, that an alignment can't do with alone."""
        for n, all_grams in self.grams.items():
            rows = []
            for i, g in enumerate(all_grams):
                counts = frequency[n][np.searchsorted(every[n], g)].tolist() if len(g) else []
                live = sorted((c, at) for at, c in enumerate(counts) if c)
                held = self.least[i] - n + 1  # by every alignment that reaches the score
                if len(live) >= held:
                    rows += [(int(g[at]), i, at) for _, at in live[: len(live) - held + int(self.votes[i])]]
            rows.sort()
            self.seeds[n], starts = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            self.places[n] = (np.append(starts, len(rows)).astype(np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))


def _hits(sorted_seeds: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``found`` that hold a seed, and the seeds' numbers."""
    if not len(sorted_seeds) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_seeds, found)
    at[at == len(sorted_seeds)] = 0
    hit = np.nonzero(sorted_seeds[at] == found)[0]
    return hit, at[hit]


class Seeds:
    """Sorted hashes behind a table of their low bits, which most other hashes don't pass."""

    def __init__(self, hashes: np.ndarray):
        bits = min(24, max(12, int(len(hashes)).bit_length() + 7))
        self.sorted, self.mask = hashes, np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[hashes & self.mask] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = np.nonzero(self.table[found & self.mask])[0]
        at, number = _hits(self.sorted, found[may])
        return may[at], number


class Aligner:
    """Leaks of a block of items in one document; outcomes for equal passages are kept."""

    def __init__(self, items: Items, cache: int = 1 << 13):
        self.items, self.cache, self.known = items, cache, {}
        self.seeds = {n: Seeds(s) for n, s in items.seeds.items() if len(s)}
        self.bags = [np.unique(items.grams[n][i]) if n else items.words[i] for i, n in enumerate(items.sizes)]

    def _passages(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) around enough seeds on near diagonals; overlapping ones of an item as one."""
        for n, seeds in self.seeds.items():
            at, seed = seeds.hits(grams(words, n))
            if not len(at):
                continue
            starts, items, offsets = self.items.places[n]
            first, count = starts[seed], starts[seed + 1] - starts[seed]
            place = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
            item, diagonal = items[place], np.repeat(at, count) - offsets[place]
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            slack, last = self.items.slack[item], np.arange(len(item)) + self.items.votes[item] - 1
            end = np.minimum(last, len(item) - 1)
            kept = np.nonzero((last == end) & (item[end] == item) & (diagonal[end] - diagonal <= slack))[0]
            item, start, slack = item[kept], diagonal[kept], slack[kept]
            stop = np.minimum(start + self.items.length[item] + slack, len(words)).tolist()
            now, a, b = None, 0, 0
            for i, x, y in zip(item.tolist(), np.maximum(start - slack, 0).tolist(), stop):
                if i == now and x <= b:
                    b = max(b, y)
                    continue
                if now is not None:
                    yield now, a, b
                now, a, b = i, x, y
            if now is not None:
                yield now, a, b

    def _score(self, item: int, passage: np.ndarray) -> tuple[int, int, int]:
        """Score and span in the passage, score 0 if it falls short."""
        own, least = self.items.words[item], self.items.least[item]
        if len(_hits(self.items.sorted[item], passage)[0]) < least:  # no alignment scores more than its matches
            return 0, 0, 0
        n = self.items.sizes[item]
        if len(_hits(self.bags[item], grams(passage, n))[0]) < least - n + 1:  # nor has fewer n-grams
            return 0, 0, 0
        score, i, j = align(own, passage)
        if score < least:
            return 0, 0, 0
        back = align(own[:i][::-1], passage[:j][::-1])
        return score, j - back[2], j

    def __call__(self, parts: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """``(item number, score, start, end)`` of the best (first) alignment of each leaked item, in words.

        ``parts``: where the kept words of the document start, and those words.
        """
        best: dict[int, tuple[int, int, int]] = {}
        for begin, words in parts:
            for item, start, end in self._passages(words):
                passage = words[start:end]
                key = (item, passage.tobytes())
                if key not in self.known:
                    if len(self.known) > self.cache:
                        self.known.clear()
                    self.known[key] = self._score(item, passage)
                score, a, b = self.known[key]
                if score and score > best.get(item, (0,))[0]:
                    best[item] = (score, begin + start + a, begin + start + b)
        return [(i, *best[i]) for i in sorted(best)]


class Survey:
    """Counts of wanted n-grams by document, and the stretches of texts that could hold an alignment."""

    def __init__(self, wanted: dict[int, np.ndarray], dense: dict[int, list[tuple[int, int]]]):
        self.dense = dense
        self.filters = {n: Seeds(w) for n, w in wanted.items() if len(w)}
        self.counts = {n: np.zeros(len(w), np.int64) for n, w in wanted.items()}

    def __call__(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words of a column of texts, where each text begins, and starts and ends of stretches, none touching two texts."""
        words, begin = column_words(found)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, seeds in self.filters.items():
            at, seed = seeds.hits(grams(words, n))
            row = np.searchsorted(begin, at, "right") - 1
            inside = at + n <= begin[row + 1]
            at, seed, row = at[inside], seed[inside], row[inside]
            total = len(self.counts[n])
            self.counts[n] += np.bincount(np.unique(row * total + seed) % total, minlength=total)
            for hits, width in self.dense[n]:
                first, last = at[: max(0, len(at) - hits + 1)], at[hits - 1 :]
                near = np.nonzero((row[: len(first)] == row[hits - 1 :]) & (last + n - first <= width))[0]
                starts.append(np.maximum(first[near] - width, begin[row[near]]))
                ends.append(np.minimum(last[near] + n + width, begin[row[near] + 1]))
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        opens = np.nonzero(np.concatenate([[True], start[1:] >= reach[:-1]]))[0] if len(start) else np.zeros(0, np.int64)
        return words, begin, start[opens], reach[np.append(opens[1:], len(start)) - 1] if len(opens) else reach

    def frequencies(self) -> Iterator[pa.RecordBatch]:
        for n, c in self.counts.items():
            seen = np.nonzero(c)[0]
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n)), pa.array(seen), pa.array(c[seen])], ["n", "at", "df"])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _surveyed(docs: DataFrame, id_col: str, text_col: str, items: Items) -> DataFrame:
    """One pass over the texts, stored: rows ``(n, at, df)`` of counts, and ``(id, digest, starts, sizes, words)`` of documents with stretches."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((items.every(), items.dense()))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey = Survey(*shared.value)
        names, id_type = ["id", "digest", "starts", "sizes", "words", "n", "at", "df"], None
        for batch in slices(batches, "text"):
            id_type = batch.column(0).type
            words, begin, start, end = survey(batch.column(2))
            if not len(start):
                continue
            row = np.searchsorted(begin, start, "right") - 1
            rows, firsts = np.unique(row, return_index=True)
            parts, size = np.diff(np.append(firsts, len(row))), end - start
            kept = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            none = pa.nulls(len(rows), pa.int64())
            own = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
            lists = [_lists(start - begin[row], parts), _lists(size, parts), _lists(words[kept].view(np.int64), np.add.reduceat(size, firsts))]
            yield pa.RecordBatch.from_arrays([*own, *lists, none, none, none], names)
        for batch in survey.frequencies():
            none = [pa.nulls(batch.num_rows, t) for t in (id_type, pa.int64(), longs, longs, longs)]
            yield pa.RecordBatch.from_arrays([*none, *batch.columns], names)

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return stored(source.mapInArrow(run, f"id {kind}, digest bigint, starts array<bigint>, sizes array<bigint>, words array<bigint>, n bigint, at bigint, df bigint"))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The distinct items and their words in blocks of at most ``block`` words (or one item), read one after the other."""
    ids, held, size = [], [], 0
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    for row in items.orderBy("item", "text").toLocalIterator():
        own = words_of(row["text"])
        if ids and size + len(own) > block:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(row["item"])
        held.append(own)
        size += len(own)
    if ids:
        yield ids, held


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, threshold: float, least: int, block: int) -> Iterator[DataFrame]:
    """By block of items ``(id, digest, item, score, item_words, likeness, start_word, end_word)``."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"id {kind}, digest bigint, item {item_kind}, score bigint, item_words bigint, likeness double, start_word bigint, end_word bigint"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            find = Aligner(items)
            for batch in slices(batches, "words"):
                id_type, out = batch.column(0).type, []
                for key, digest, starts, sizes, words in zip(*(batch.column(i).to_pylist() if i < 2 else batch.column(i) for i in range(5))):
                    words, ends = words.values.to_numpy().view(np.uint64), np.cumsum(sizes.as_py()).tolist()
                    parts = [(s, words[a:b]) for s, a, b in zip(starts.as_py(), [0, *ends], ends)]
                    for i, score, a, b in find(parts):
                        size = len(items.words[i])
                        out.append((key, digest, items.ids[i], score, size, score / size, a, b))
                if out:
                    kinds = [id_type, pa.int64(), item_arrow, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    names = ["id", "digest", "item", "score", "item_words", "likeness", "start_word", "end_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        return run

    for ids, words in _blocks(benchmark, item_col, item_text_col, block):
        items = Items(ids, words, threshold, least)
        every = items.every()
        surveyed = _surveyed(docs, id_col, text_col, items)
        counted = surveyed.where("n is not null").groupBy("n", "at").agg(F.sum("df").alias("df")).toArrow()
        n, at, df = (counted.column(i).to_numpy() for i in range(3))
        frequency = {k: np.zeros(len(every[k]), np.int64) for k in every}
        for k in every:
            frequency[k][at[n == k]] = df[n == k]
        items.choose(every, frequency)
        kept = surveyed.where("words is not null").select("id", "digest", "starts", "sizes", "words")
        yield kept.mapInArrow(scan(spark.sparkContext.broadcast(items)), schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``(id_col, item_col, score, item_words, likeness, start_word, end_word)`` of every document and item it leaks.

    A leak scores at least ``threshold`` of the item's words, and at least ``least`` (the whole item if
    it is shorter); ``likeness = score / item_words``. Of several places in a document the best, first
    one is reported, in words. Null and empty texts and items leak nothing. A repeated document row
    comes back for each time it was given, a repeated item once; items of one id but different texts
    are different. Null ids come back as null. Empty tables give an empty result; other columns are
    not read. ``block``: words of items that are broadcast at once; every block reads the texts once.
    """
    found = None
    for part in _found(docs, benchmark, id_col, text_col, item_col, item_text_col, threshold, least, block):
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"id {kind}, item {item_kind}, score bigint, item_words bigint, likeness double, start_word bigint, end_word bigint")
    return found.drop("digest").withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that leak no test item, all columns kept, rows told apart by hashes of id and text.

    Those two numbers of each leaking row are broadcast up to a million rows, else the texts are shuffled once.
    """
    gone = None
    for part in _found(docs, benchmark, id_col, text_col, item_col, item_text_col, threshold, least, block):
        keys = part.select(F.xxhash64("id").alias("_id"), F.col("digest").alias("_digest"))
        gone = keys if gone is None else gone.unionByName(keys)
    if gone is None:
        return docs
    gone = cut(gone.distinct())
    same = (F.xxhash64(docs[id_col]) == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_digest"])
    return join_checked(docs, gone, same, "left_anti", 1_000_000)
