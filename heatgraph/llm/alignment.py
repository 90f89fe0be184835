"""Alignment of two tokenizers' ids over whole texts, by distinct segments.

A text (with a space before it) is cut before every run of white space that starts with a space.
No token of either vocabulary reaches over such a place: that is verified for every entry when the
vocabularies are loaded, and the first one's pre-tokenizer ends a piece there anyhow. So a text's tokens
are those of its segments one after the other, and both kinds of tokens end together at every cut.

Texts are held as chunks: numbers beside a dictionary of distinct segments. Only dictionaries are shuffled, never
occurrences: all chunks' segments meet in buckets by hash, where each is tokenised and aligned once, and
the alignments are joined back to the chunks, which compose their documents from them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heatgraph.llm.tables import packed, release, slices, texts, unpacked
from heatgraph.plans.lineage import dropped, stored

#: Characters of a chunk (more only if one document has more).
CHUNK = 18 << 20
#: Linked id pairs up to this number are sent to the tasks as a sorted list; more of them are shuffled to the chunks.
MOST_PAIRS = 2_000_000
#: Segments that are tokenised together, and those that are spelled together.
TOGETHER, BLOCK = 64, 1 << 15
#: Segments of a chunk whose links are held at once when they are rated.
PART = 1 << 16
#: Entries of dictionaries for each bucket.
BUCKET = 100_000
#: White space in any of the definitions in use (this module's is the widest) never comes before a cut.
_SEGMENT = re.compile(r"(?<=\S)(?= .)", re.S)
_SPACE = "▁"


def segments(text: str) -> list[str]:
    """``text``, which starts with a space, cut before runs of white space; a single space at the end stays where it is."""
    return _SEGMENT.split(text)


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes: dict[int, bytes] = {}
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.zeros(1 + max(self.a_bytes), np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.separable = self._separable()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _separable(self) -> bool:
        """No entry has a space after anything but white space; cut-off characters before it are looked at as bytes of those."""
        crosses = re.compile(r"\S ")
        for entry in self.a_bytes.values():
            if b" " in entry and crosses.search(entry.decode("utf-8", "surrogateescape")):
                return False
        return not any(crosses.search(self.b.id_to_piece(i).replace(_SPACE, " ")) for i in range(len(self.b_bytes)) if not self.b.is_byte(i))

    def encoded(self, cut: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both for all segments, how many of each a segment has, and whether both spell exactly its bytes.

        Segments that end in no white space are tokenised ``TOGETHER``, as what the vocabularies can't merge doesn't depend on its
        neighbours; if that doesn't spell them, and for all others, each is tokenised for itself.
        """
        if self.separable and not any(s[-1:].isspace() for s in cut):
            pieces = ["".join(cut[i : i + TOGETHER]) for i in range(0, len(cut), TOGETHER)]
            x = np.array([i for e in self.a.encode_batch_fast(pieces, add_special_tokens=False) for i in e.ids], np.int64)
            y = np.array([i for z in self.b.encode([p[1:] for p in pieces], num_threads=1) for i in z], np.int64)
            whole = "".join(pieces).encode()
            if self._spelled(x, y, whole):
                ends = np.cumsum([len(s.encode()) for s in cut])
                n_x = np.diff(np.searchsorted(np.cumsum(self.a_size[x]), ends, side="right"), prepend=0)
                n_y = np.diff(np.searchsorted(np.cumsum(self.b_size[y]), ends, side="right"), prepend=0)
                return x, y, n_x, n_y, np.ones(len(cut), bool)
        xs = [e.ids for e in self.a.encode_batch(cut, add_special_tokens=False)]
        ys = self.b.encode([s[1:] for s in cut], num_threads=1)
        ok = np.array([self._spelled(x, y, s.encode()) for x, y, s in zip(xs, ys, cut)], bool)
        xs, ys = ([z if k else [] for z, k in zip(zs, ok.tolist())] for zs in (xs, ys))
        flat = lambda zs: np.fromiter((i for z in zs for i in z), np.int64)
        return flat(xs), flat(ys), np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64), ok

    def _spelled(self, x, y, whole: bytes) -> bool:
        x, y = (z.tolist() if isinstance(z, np.ndarray) else z for z in (x, y))
        return b"".join(map(self.a_bytes.__getitem__, x)) == whole and b"".join(map(self.b_bytes.__getitem__, y)) == whole

    def aligned(self, cut: list[str]) -> tuple[pa.Array, bool]:
        """For each segment its groups as numbers: how many, ids of the first and of the second in each, then all ids; empty if not spelled.

        Numbers are of two bytes, unless the second result says that one of these needs four.
        """
        x, y, n_x, n_y, ok = self.encoded(cut)
        end_x, end_y = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        common = np.intersect1d(end_x, end_y, assume_unique=True)  # every segment's end is among them
        in_x = np.diff(np.searchsorted(end_x, common, side="right"), prepend=0)
        in_y = np.diff(np.searchsorted(end_y, common, side="right"), prepend=0)
        last = np.searchsorted(common, np.concatenate([[0], end_x])[np.cumsum(n_x)], side="right")
        groups = np.diff(last, prepend=0)
        size = np.where(ok, 1 + 2 * groups + n_x + n_y, 0)
        begin = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.int64)
        flat[begin[ok]] = groups[ok]
        at = begin + 1
        for values, n in ((in_x, groups), (in_y, groups), (x, n_x), (y, n_y)):
            flat[_spread(at, n)] = values
            at = at + n
        wide = bool(flat.max(initial=0) >= 1 << 16)
        kind = np.dtype("<u4" if wide else "<u2")
        offsets = np.concatenate([[0], np.cumsum(size)]) * kind.itemsize
        return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.astype(kind))]), wide


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...``, ``n`` numbers for each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


@lru_cache(maxsize=1)
def _pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


class Aligned:
    """The alignments of a chunk's segments as arrays, by the number of the segment."""

    def __init__(self, blobs: pa.Array, wide: bool = False) -> None:
        n, kind = len(blobs), np.dtype("<u4" if wide else "<u2")
        offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        numbers = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
        begin = (offsets[:-1] - offsets[0]) // kind.itemsize
        self.ok = offsets[1:] > offsets[:-1]
        self.n_groups = np.zeros(n, np.int64)
        self.n_groups[self.ok] = numbers[begin[self.ok]]
        of = np.repeat(np.arange(n, dtype=np.int32), self.n_groups)  # segment of each group
        self.in_a = numbers[_spread(begin + 1, self.n_groups)].astype(np.int32)
        self.in_b = numbers[_spread(begin + 1 + self.n_groups, self.n_groups)].astype(np.int32)
        self.n_a = np.bincount(of, self.in_a, n).astype(np.int64)
        self.n_b = np.bincount(of, self.in_b, n).astype(np.int64)
        self.a = numbers[_spread(begin + 1 + 2 * self.n_groups, self.n_a)]
        self.b = numbers[_spread(begin + 1 + 2 * self.n_groups + self.n_a, self.n_b)]
        times = self.in_a.astype(np.int64) * self.in_b
        self.n_links = np.bincount(of, times, n).astype(np.int64)
        del numbers, begin
        # links: every first id of a group with every second one
        n_second = np.repeat(self.in_b, self.in_a)
        begin_b = np.repeat((np.cumsum(self.in_b) - self.in_b).astype(np.int64), self.in_a)
        key = np.repeat(self.a.astype(np.int64), n_second) << 32 | self.b[_spread(begin_b, n_second)]
        del n_second, begin_b
        self.pairs, number = np.unique(key, return_inverse=True)
        number = number.astype(np.int32)
        tall = max(len(self.pairs), 1)
        key, self.times = np.unique(np.repeat(of.astype(np.int64), times) * tall + number, return_counts=True)
        self.held = (key % tall).astype(np.int32)  # distinct pairs of each segment, as numbers of ``pairs``
        self.n_held = np.bincount(key // tall, minlength=n)

    def spelled(self) -> list[str]:
        """``a1,a2|b1;...`` of each segment."""
        out: list[str] = []
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in (self.n_groups, self.n_a, self.n_b)]
        for first in range(0, len(self.n_groups), BLOCK):
            (g, h), (i, i_end), (j, j_end) = ((e[first], e[min(first + BLOCK, len(self.n_groups))]) for e in ends)
            a, b = list(map(str, self.a[i:i_end].tolist())), list(map(str, self.b[j:j_end].tolist()))
            groups, i, j = [], 0, 0
            for m, n in zip(self.in_a[g:h].tolist(), self.in_b[g:h].tolist()):
                groups.append(f"{a[i]}|{b[j]}" if m == n == 1 else f"{','.join(a[i : i + m])}|{','.join(b[j : j + n])}")
                i, j = i + m, j + n
            at = 0
            for n in self.n_groups[first : first + BLOCK].tolist():
                out.append(";".join(groups[at : at + n]))
                at += n
        return out


def _widened(blobs: pa.Array, wide: np.ndarray) -> pa.Array:
    """Blobs of four-byte numbers, of which those in ``wide`` are so already."""
    return pa.array([b if w else np.frombuffer(b, "<u2").astype("<u4").tobytes() for b, w in zip(blobs.to_pylist(), wide.tolist())], pa.binary())


def _pack(values: pa.Array) -> list[bytes]:
    """Strings or blobs as compressed lengths and bytes."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = memoryview(values.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return [packed(np.diff(offsets)), zstandard.compress(data, 1)]


def _unpack(lengths: bytes, data: bytes, kind: pa.DataType) -> pa.Array:
    size = unpacked(lengths)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(data))])


def _chunks(docs: DataFrame, id_col: str, text_col: str, size: int, separable: bool) -> DataFrame:
    """``(chunk, ids, sizes, codes, entries, segments)``: all documents as numbers of distinct segments, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _pair.cache_clear()  # the worker may have aligned segments of another table before
        release()
        ids, sizes, parts, held = [], [], [], 0
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, names = np.concatenate(parts), pa.array(list(numbers), pa.string())
            columns = [pa.array([ids], pa.list_(batch.schema.field(0).type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed(codes)], pa.binary()), pa.array([len(names)], pa.int64()), pa.array([_pack(names)], pa.list_(pa.binary()))]
            for x in (ids, sizes, parts, numbers):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "codes", "entries", "segments"])

        batch = None
        for batch in slices(batches, "text"):
            for i, text in zip(batch.column(0).to_pylist(), texts(batch)):
                cut = (segments(" " + text) if separable else [" " + text]) if text else []
                ids.append(i)
                sizes.append(len(cut))
                parts.append(np.fromiter(map(numbers.__getitem__, cut), np.int32, len(cut)))
                held += len(text) + 64
                if held > size:
                    yield out(batch)
                    held = 0
        if ids:
            yield out(batch)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(run, f"ids array<{kind}>, sizes array<int>, codes binary, entries bigint, segments array<binary>")
    return found.withColumn("chunk", F.monotonically_increasing_id())  # for good once it is written


def _dealt(chunks: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, chunk, codes, segments)``: the dictionaries' entries, packed, by a hash of the segment."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("segments", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names = _unpack(*_row(batch, "segments", row), pa.string())
                if not len(names):
                    continue
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(x) % buckets for x in names.to_pylist()), np.int64, len(names))
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
                for first, last in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    own = order[first:last]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])]), pa.array([_row(batch, "chunk", row)]), pa.array([packed(own)], pa.binary()), pa.array([_pack(names.take(pa.array(own)))], pa.list_(pa.binary()))], schema=schema)
        release()

    return chunks.select("chunk", "segments").mapInArrow(run, "bucket bigint, chunk bigint, codes binary, segments array<binary>")


def aligned_segments(dealt: DataFrame, byte_level: str, pieces: str, at_once: int = 4000) -> DataFrame:
    """``(chunk, codes, blobs, wide)`` of ``(bucket, chunk, codes, segments)``: each distinct segment of a bucket is aligned once,
    and its alignment joined back to every dictionary that has it. Packed; ``Aligned`` reads the blobs, which are
    empty for a segment whose bytes the tokens don't spell.
    """
    schema = pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("blobs", pa.list_(pa.binary())), ("wide", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        pair = _pair(byte_level, pieces)
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        places = []
        for x in table.column("segments").to_pylist():
            names = _unpack(*x, pa.string()).to_pylist()
            places.append(np.fromiter(map(numbers.__getitem__, names), np.int64, len(names)))
        numbers.default_factory = None
        distinct, made, wides = list(numbers), [], []
        for start in range(0, len(distinct), at_once):
            blobs, wide = pair.aligned(distinct[start : start + at_once])
            made.append(blobs)
            wides.append(np.full(len(blobs), wide))
        blobs, wides = pa.concat_arrays(made), np.concatenate(wides)
        if wides.any():
            blobs = _widened(blobs, wides)
        packs = [_pack(blobs.take(pa.array(at))) for at in places]
        out = pa.Table.from_arrays([table.column("chunk"), table.column("codes"), pa.array(packs, pa.list_(pa.binary())), pa.array([bool(wides.any())] * len(packs), pa.bool_())], schema=schema)
        del numbers, places, distinct, made, blobs, wides, packs, table
        release()
        return out

    return dealt.groupBy("bucket").applyInArrow(run, "chunk bigint, codes binary, blobs array<binary>, wide boolean")


def _row(table: pa.Table | pa.RecordBatch, name: str, row: int = 0):
    return table.column(name)[row].as_py()


class Linked(NamedTuple):
    """Which segments of a chunk have tokens, and the distinct pairs of each, as numbers of ``pairs``."""

    ok: np.ndarray
    pairs: np.ndarray
    n_held: np.ndarray
    held: np.ndarray


def _linked(blobs: pa.Array, wide: bool) -> Linked:
    """A part of the segments after the other, as their links are many times what comes out."""
    parts = []
    for first in range(0, max(len(blobs), 1), PART):
        found = Aligned(blobs.slice(first, PART), wide)
        parts.append(Linked(found.ok, found.pairs, found.n_held, found.held))
    pairs = np.unique(np.concatenate([x.pairs for x in parts]))
    held = [np.searchsorted(pairs, x.pairs).astype(np.int32)[x.held] for x in parts]
    return Linked(np.concatenate([x.ok for x in parts]), pairs, np.concatenate([x.n_held for x in parts]), np.concatenate(held))


def _usable(codes: np.ndarray, sizes: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whether each document of a chunk has tokens."""
    if ok.all():
        return sizes > 0
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return (np.bincount(doc[~ok[codes]], minlength=len(sizes)) == 0) & (sizes > 0)


def _document_counts(codes: np.ndarray, sizes: np.ndarray, found: Linked) -> np.ndarray:
    """How many documents of a chunk hold each of its linked pairs."""
    good = _usable(codes, sizes, found.ok).tolist()
    counts, at = np.zeros(len(found.pairs), np.int64), np.cumsum(found.n_held) - found.n_held
    # an entry that still has its own place after all were written is the last of its kind
    segment, pair, end = np.zeros(len(found.n_held), np.int32), np.zeros(len(found.pairs), np.int32), 0
    for n, fine in zip(sizes.tolist(), good):
        end += n
        if not fine:
            continue
        own = codes[end - n : end]
        place = np.arange(n, dtype=np.int32)
        segment[own] = place
        own = own[segment[own] == place]
        numbers = found.held[_spread(at[own], found.n_held[own])]
        place = np.arange(len(numbers), dtype=np.int32)
        pair[numbers] = place
        counts[numbers[pair[numbers] == place]] += 1
    return counts


def _one_list(numbers: np.ndarray) -> pa.Array:
    """One row that holds the numbers, without a Python object for each."""
    return pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.array(numbers, pa.int64()))


_CHUNKED = "chunk bigint, ids array<{}>, sizes array<int>, codes binary, blobs array<binary>, wide boolean, pairs array<bigint>, docs array<bigint>"


def _rated(blobs: pa.Array, wide: bool, pairs: np.ndarray, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[str]]:
    """Per segment: whether it has tokens; n_a, n_b, n_groups, n_links, n_best and count_sum, from the counts of sorted pairs; its groups, spelled.

    A part of the segments after the other, as their links are many times what comes out.
    """
    ok, totals, spelled = [np.zeros(0, bool)], [[np.zeros(0, np.int64)] for _ in _COLUMNS], []
    for first in range(0, len(blobs), PART):
        found = Aligned(blobs.slice(first, PART), wide)
        at = np.minimum(np.searchsorted(pairs, found.pairs), max(len(pairs) - 1, 0))
        known = pairs[at] == found.pairs if len(pairs) else np.zeros(len(found.pairs), bool)  # others are only in texts without tokens
        last = np.cumsum(found.n_held)
        ok.append(found.ok)
        rated = []
        for x in (best, count):
            total = np.concatenate([[0], np.cumsum(found.times * np.where(known, x[at], 0)[found.held])]) if len(pairs) else np.zeros(found.n_held.sum() + 1, np.int64)
            rated.append(total[last] - total[last - found.n_held])
        for column, x in zip(totals, (found.n_a, found.n_b, found.n_groups, found.n_links, *rated)):
            column.append(x)
        spelled += found.spelled()
    return np.concatenate(ok), [np.concatenate(x) for x in totals], spelled


def _of_documents(codes: np.ndarray, sizes: np.ndarray, ok: np.ndarray, totals: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over the segments of each document of a chunk, 0 for those without tokens."""
    good, full = _usable(codes, sizes, ok), sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    out = []
    for each in totals:
        total = np.zeros(len(sizes), np.int64)
        if full.any():
            total[full] = np.add.reduceat(each[codes], begin)
        out.append(np.where(good, total, 0))
    return out


def _digests(codes: np.ndarray, sizes: np.ndarray, ok: np.ndarray, spelled: list[str]) -> list[str]:
    out, at = [], 0
    for n, fine in zip(sizes.tolist(), _usable(codes, sizes, ok).tolist()):
        out.append(hashlib.sha256(";".join([spelled[c] for c in codes[at : at + n].tolist()]).encode()).hexdigest() if fine else "")
        at += n
    return out


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def alignments(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row, over whole texts.

    ``byte_level`` is the file of a byte-level vocabulary that gets a space and the text, ``pieces`` that of a piece model
    that adds the space itself. Byte offsets where tokens of both end cut them into groups; all pairs inside a group are
    links. A pair's count is the number of rows whose text holds it linked; ``n_best`` are the links with the highest count of
    their first id. Null and empty texts, and those that the tokens don't spell byte by byte, have zeros and an empty digest.
    Repeated rows and null ids count like any others; other columns are not read; an empty table gives an empty result.
    """
    spark, field = docs.sparkSession, docs.schema[id_col].dataType
    kind, id_type = field.simpleString(), to_arrow_type(field)
    held = stored(_chunks(docs, id_col, text_col, chunk, _pair(byte_level, pieces).separable))
    buckets = 1 + (held.agg(F.sum("entries")).first()[0] or 0) // BUCKET
    placed = aligned_segments(_dealt(held, buckets), byte_level, pieces)
    chunked = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("blobs", pa.list_(pa.binary())), ("wide", pa.bool_()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
    result = pa.schema([("id", id_type), *((n, pa.int64()) for n in _COLUMNS), ("groups_sha256", pa.string())])

    def composed(sequence: pa.Table, alignment: pa.Table) -> pa.Table:
        _pair.cache_clear()  # all segments are aligned, and the worker may live on beside others
        if not sequence.num_rows:
            return chunked.empty_table()
        blobs, wide = pa.array([], pa.binary()), False
        if alignment.num_rows:
            own = [_unpack(*x, pa.binary()) for x in alignment.column("blobs").to_pylist()]
            wides = alignment.column("wide").to_pylist()
            wide = any(wides)
            if wide:
                own = [x if w else _widened(x, np.zeros(len(x), bool)) for x, w in zip(own, wides)]
            order = np.argsort(np.concatenate([unpacked(x) for x in alignment.column("codes").to_pylist()]))
            blobs = pa.concat_arrays(own).take(pa.array(order))
            del own, order
        release()  # vocabularies and packs, before arrays take their place
        found = _linked(blobs, wide)
        counts = _document_counts(unpacked(_row(sequence, "codes")), np.array(_row(sequence, "sizes"), np.int64), found)
        columns = [sequence.column(n).combine_chunks() for n in ("chunk", "ids", "sizes", "codes")]
        columns += [pa.array([_pack(blobs)], pa.list_(pa.binary())), pa.array([wide]), _one_list(found.pairs), _one_list(counts)]
        del found, blobs, counts
        release()
        return pa.Table.from_arrays(columns, schema=chunked)

    sequences = held.select("chunk", "ids", "sizes", "codes").groupBy("chunk")
    whole = stored(sequences.cogroup(placed.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(composed, _CHUNKED.format(kind)))
    dropped(held)

    each = whole.select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = stored(each.groupBy("pair").agg(F.sum("docs").alias("count")).where(F.col("count") > 0))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    rated = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))

    def rows(batch: pa.RecordBatch | pa.Table, row: int, pairs: np.ndarray, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        ok, totals, spelled = _rated(_unpack(*_row(batch, "blobs", row), pa.binary()), _row(batch, "wide", row), pairs, count, best.astype(np.int64))
        codes, sizes = unpacked(_row(batch, "codes", row)), np.array(_row(batch, "sizes", row), np.int64)
        totals = _of_documents(codes, sizes, ok, totals)
        return pa.RecordBatch.from_arrays([pa.array(_row(batch, "ids", row), id_type), *(pa.array(t, pa.int64()) for t in totals), pa.array(_digests(codes, sizes, ok, spelled), pa.string())], schema=result)

    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in _COLUMNS) + ", groups_sha256 string"
    if counts.limit(most_pairs + 1).count() <= most_pairs:
        table = rated.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(n).to_numpy() for n in ("pair", "count", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield rows(batch, row, *shared.value)
                    release()

        found = whole.select("ids", "sizes", "codes", "blobs", "wide").mapInArrow(run, schema)
    else:

        def beside(sequence: pa.Table, known: pa.Table) -> pa.Table:
            if not sequence.num_rows:
                return result.empty_table()
            order = np.argsort(known.column("pair").to_numpy())
            return pa.Table.from_batches([rows(sequence, 0, *(known.column(n).to_numpy()[order] for n in ("pair", "count", "best")))])

        own = each.join(rated, "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")
        found = whole.select("chunk", "ids", "sizes", "codes", "blobs", "wide").groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(beside, schema)
    return found.withColumnRenamed("id", id_col)
