"""Threshold-scaled document sketches.

The sketch of a text is every 32-bit hash of its word shingles below a fixed fraction of the hash
range. As the fraction is fixed, a sketch grows with its document, the sketch of a union is the union
of the sketches, and containment can be estimated between documents of very unequal length. A text
none of whose hashes is below the threshold keeps its single smallest hash; that rule merges too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.tables import slices
from heatgraph.plans.ranges import range_bounds, range_index

WIDTH = 5
SCALE = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Sketcher:
    """Sketches of texts; word hashes are kept for speed, at most ``cache`` of them."""

    def __init__(self, scale: int = SCALE, width: int = WIDTH, cache: int = 1 << 20):
        self.threshold, self.width, self.cache = (1 << 32) // scale, width, cache
        self.hashes: dict[str, int] = {}
        self.factors = np.array([pow(int(_ODD[0]), i + 1, 1 << 64) | 1 for i in range(width)], np.uint64)

    def _words(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.hashes) > self.cache:
                self.hashes.clear()
            for w in words:
                if w not in self.hashes:
                    self.hashes[w] = xxhash.xxh64_intdigest(w.encode())
            return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        """The kept hashes in ascending order (uint32)."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint32)
        h = self._words(words)
        n = max(1, len(h) - self.width + 1)
        mixed = np.full(n, len(h) if len(h) < self.width else self.width, np.uint64)
        for i in range(min(self.width, len(h))):
            mixed += h[i : i + n] * self.factors[i]
        for factor in _ODD[1:3]:
            mixed ^= mixed >> np.uint64(33)
            mixed *= factor
        short = (mixed >> np.uint64(32)).astype(np.uint32)
        kept = short[short < self.threshold]
        return np.unique(kept) if len(kept) else short.min(keepdims=True)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty sketches are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``(id_col, sketch array<bigint>)`` of every whole text; null, empty and wordless texts: empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(scale, width)
        for batch in slices(batches, "text"):
            made = [make(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "sketch"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, sketch array<bigint>").withColumnRenamed("id", id_col)


def merged(sketch: Column, scale: int = SCALE) -> Column:
    """Aggregate: the sketch of the union of a group's texts."""
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketch))))
    below = F.filter(union, lambda h: h < F.lit((1 << 32) // scale))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(union, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds (null for an empty a)."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness (1 for two empty sketches)."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def _hex(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many (or
    all) of the next row's, in order of descending id (rows of one id by text; null ids last), after
    the last row that of the first. Null texts are empty. A single row is its own next. An empty
    table gives an empty result; columns other than the two named are not read. Ids are numbers, as ranges are cut
    by value; ids of any other kind that can't be cast to one are an error of the cast.

    Texts are dealt once, by ranges of the id. A range's first row also goes to the range before it,
    as context for that one's last row, so no row needs another task and the extra rows are as many
    as the ranges.
    """
    spark = docs.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bounds = range_bounds(source, "id", ranges)
    at = F.coalesce(range_index(F.col("id"), bounds), F.lit(-1)).cast("int")
    # the first row of each range in descending order, at most one for each range: a bounded table
    heads = source.select("id", at.alias("at")).groupBy("at").agg(F.max("id").alias("head")).collect()
    order = sorted((r["at"] for r in heads), reverse=True)
    head = {r["at"]: r["head"] for r in heads}
    before = {order[(i + 1) % len(order)]: a for i, a in enumerate(order)} if order else {}
    wanted = F.create_map(*[F.lit(x) for r, a in before.items() for x in (r, a)]) if before else None
    starts = F.create_map(*[F.lit(x).cast("bigint") for r in before if head[r] is not None for x in (r, head[r])]) if any(head[r] is not None for r in before) else None

    rows = source.withColumn("at", at)
    if before:
        opens = F.col("id").isNull()
        if starts is not None:
            opens = F.coalesce(F.col("id") == F.element_at(starts, F.col("at").cast("bigint")), F.lit(False)) | opens
        own = F.struct(F.col("at").alias("at"), F.lit(False).alias("context"))
        also = F.struct(F.element_at(wanted, F.col("at")).alias("at"), F.lit(True).alias("context"))
        rows = rows.withColumn("to", F.explode(F.when(opens, F.array(own, also)).otherwise(F.array(own)))).select(
            F.col("to.at").alias("at"), F.col("to.context").alias("context"), "id", "text"
        )
    else:
        rows = rows.withColumn("context", F.lit(False)).select("at", "context", "id", "text")
    placed = rows.repartition("at").sortWithinPartitions(
        "at", "context", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit(""))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(scale, width)
        held = None  # the row before: range, id, text, sketch
        done = None  # the range whose context row has been seen
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for at, context, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = text or ""
                if context and done == at:
                    continue
                sketch = make(text)
                if held is not None and held[0] == at:
                    _, was, old, mine = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    theirs = make(edited)
                    out.append((was, len(old), hashlib.sha256(edited.encode()).hexdigest(), _hex(mine), _hex(theirs), likeness(mine, theirs), likeness(mine, sketch)))
                held, done = (None, at) if context else ((at, key, text, sketch), done)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    kind = docs.schema[id_col].dataType.simpleString()
    found = placed.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.select(F.col("id").cast(kind).alias(id_col), *_NAMES[1:])


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
