"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three disjoint segments of 21, 21 and 22 bits, each zero-padded to
a 23-bit word of the perfect binary Golay code (covering radius 3). A word's *indices* are its
nearest codeword and, if that one is 3 away, the five codewords 4 away, so 1 or 6 in all. Two words
at most 2 bits apart share an index: their midpoint is within 3 of some codeword, hence both are
within 4 of it. Two words at most 1 bit apart share the nearest codeword of either.

Pigeonhole: if two fingerprints differ in at most 4 bits, their two better segments differ in
``(0, <=2)`` or ``(1, 1)``. So every fingerprint gives

* for each ordered pair of segments: the exact bits of one, and each index of the other
  (up to 36 keys of 22 + 12 bits), and
* for each unordered pair: each pair of indices (up to 108 keys of 24 bits), where one of the
  partners must hold the key through its two nearest codewords (3 keys).

Fingerprints meeting under a key are compared exactly. Under a key only a spanning forest of the
links is emitted, which keeps connectivity and is linear in the key's rows, so a large group of near
copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.tables import slices, texts
from heatgraph.operators.connected import connected_components
from heatgraph.plans.bounded import join_checked
from heatgraph.plans.lineage import cut

BITS = 64
MAX_DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
GOLAY_POLY = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
_EMPTY = np.zeros(0, np.uint64)


def _remainder(word: int) -> int:
    """Remainder of a 23-bit word modulo the generator, which is the word's syndrome."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY_POLY << (bit - 11)
    return word


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and for each syndrome the error patterns of its indices (0 and 5 repeated)."""
    unit = np.array([_remainder(1 << b) for b in range(23)], np.uint32)
    errors: list[list[int]] = [[] for _ in range(2048)]
    weight_4: list[list[int]] = [[] for _ in range(2048)]

    def extend(pattern: int, syndrome: int, start: int, weight: int) -> None:
        (errors if weight < 4 else weight_4)[syndrome].append(pattern)
        if weight < 4:
            for b in range(start, 23):
                extend(pattern | 1 << b, syndrome ^ int(unit[b]), b + 1, weight + 1)

    extend(0, 0, 0, 0)
    table = np.zeros((2048, 6), np.uint32)
    for s in range(2048):
        leader = errors[s][0]
        table[s] = [leader, *weight_4[s]] if leader.bit_count() == 3 else [leader] * 6
    return unit, table


_UNIT, _ERRORS = _golay_tables()


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of its codewords, the nearest first; short lists repeat it."""
    words = words.astype(np.uint32)
    syndrome = np.zeros(len(words), np.uint32)
    for b in range(23):
        syndrome ^= np.where(words >> np.uint32(b) & np.uint32(1), _UNIT[b], np.uint32(0))
    return (words[:, None] ^ _ERRORS[syndrome]) >> np.uint32(11)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, anchor)`` of all keys of the fingerprints; anchor: the key may meet any other."""
    n = len(prints)
    parts = [prints >> np.uint64(at) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    indices = [golay_indices(p).astype(np.uint64) for p in parts]
    real = [np.concatenate([np.ones((n, 1), bool), i[:, 1:] != i[:, :1]], axis=1) for i in indices]
    rows, keys, anchors = [], [], []

    def add(kind: int, key: np.ndarray, keep: np.ndarray, anchor: np.ndarray) -> None:
        r, c = np.nonzero(keep)
        rows.append(r)
        keys.append(np.uint64(kind << 40) | key[r, c])
        anchors.append(anchor[r, c])

    kind = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                add(kind, parts[a][:, None] << np.uint64(12) | indices[b], real[b], np.ones((n, 6), bool))
                kind += 1
    first = np.zeros((n, 36), bool)
    first[:, 0] = True
    for a, b in ((0, 1), (0, 2), (1, 2)):
        key = (indices[a][:, :, None] << np.uint64(12) | indices[b][:, None, :]).reshape(n, 36)
        add(kind, key, (real[a][:, :, None] & real[b][:, None, :]).reshape(n, 36), first)
        kind += 1
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(anchors)


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of the ``width``-word shingles (XXH64, seed 42) of an A-Z lower-cased text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, stops[width - 1 :])]
    bits = np.zeros(BITS, np.int64)
    view = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(view), 4096):
        bits += np.unpackbits(view[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, fp)``: the signed 64-bit SimHash of each text, one row per input row.

    A null or wordless text has fingerprint 0. Texts of fewer than ``width`` words are one shingle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t, width) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def _forest(prints: np.ndarray, anchor: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one key."""
    left, right = [], []
    rest, rest_anchor = prints, anchor
    while len(rest):
        frontier = [(rest[0], rest_anchor[0])]
        rest, rest_anchor = rest[1:], rest_anchor[1:]
        while frontier and len(rest):
            x, free = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if not free:
                near &= rest_anchor
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                frontier.extend(zip(found, rest_anchor[near]))
                rest, rest_anchor = rest[~near], rest_anchor[~near]
    return left, right


def _links_of(key: np.ndarray, prints: np.ndarray, anchor: np.ndarray, distance: int, small: int = 6) -> np.ndarray:
    """Links of whole keys, sorted by key: by shifts for keys of few rows, else by a forest."""
    n = len(key)
    starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [n]]).astype(np.int64)
    lengths = np.diff(starts)
    big = np.repeat(lengths > small, lengths)
    left, right = [_EMPTY], [_EMPTY]
    for d in range(1, min(small, int(lengths.max(initial=0)))):
        same = (key[d:] == key[:-d]) & ~big[d:] & (anchor[d:] | anchor[:-d])
        same &= np.bitwise_count(prints[d:] ^ prints[:-d]) <= distance
        left.append(prints[:-d][same])
        right.append(prints[d:][same])
    for k in np.nonzero(lengths > small)[0]:
        at, to = starts[k], starts[k + 1]
        a, b = _forest(prints[at:to], anchor[at:to], distance)
        left += a
        right += b
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def fingerprint_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``(u, v)``: links that connect all ``fp`` at most ``distance`` (4 or fewer) bits apart."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the segments guarantee up to {MAX_DISTANCE} bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                row, key, anchor = golay_keys(fp)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(anchor)],
                    ["key", "fp", "anchor"],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), _EMPTY, np.zeros(0, bool))
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[1] = cols[1].view(np.uint64)
            whole = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            stop = int(np.searchsorted(whole[0], whole[0][-1])) if len(whole[0]) else 0
            held = tuple(c[stop:] for c in whole)
            if stop:
                yield _pairs(_links_of(*(c[:stop] for c in whole), distance))
        if len(held[0]):
            yield _pairs(_links_of(*held, distance))

    keyed = prints.select("fp").distinct().mapInArrow(emit, "key bigint, fp bigint, anchor boolean")
    grouped = keyed.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(link, "u bigint, v bigint")


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row: its group of linked SimHash fingerprints.

    Fingerprints link at 4 or fewer differing bits; ``component_id`` is the smallest id reachable,
    the row's own included. Null and wordless texts (fingerprint 0) link like any others. A repeated
    row comes back as often as it was given; a null id never is the smallest, so a component of null
    ids only has a null component_id. An empty table gives an empty result. Other columns are not
    read, so their names may clash with anything.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    lowest = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    groups = connected_components(fingerprint_links(lowest)).select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )
    rooted = cut(lowest.join(groups, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select(
        id_col, "fp", "component_id"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 500_000) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id's, of repeated ids the smallest text hash's.

    All columns are kept. Rows are told apart by their id and a hash of their text; a null id is larger
    than any other. Of rows alike in both one stays, the one whose columns hash lowest. What goes is
    known by two 64-bit hashes a row, broadcast up to ``most`` of them; beyond that the texts are
    shuffled once. An empty table gives an empty result.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    groups = cut(near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", width))
    leads = F.col("key") == F.col("component_id")
    hashes = (F.xxhash64("key.id").alias("_id"), F.col("key.digest").alias("_digest"))
    repeated = cut(groups.where(leads).select(*hashes).groupBy("_id", "_digest").count().where("count > 1").select("_id", "_digest"))
    going = cut(groups.where(~leads).select(*hashes).unionByName(repeated).distinct())
    same = lambda keys: (F.xxhash64(docs[id_col]) == keys["_id"]) & (F.xxhash64(docs[text_col]) == keys["_digest"])
    once = join_checked(docs, going, same(going), "left_anti", most)
    if repeated.isEmpty():
        return once
    several = join_checked(docs, repeated, same(repeated), "left_semi", most)
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*hashed))
    first = several.groupBy(F.xxhash64(id_col), F.xxhash64(text_col)).agg(row.alias("row"))
    return once.unionByName(first.select("row.*"))
