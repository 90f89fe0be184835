"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A text up to ``chunk`` code points is encoded at once. A longer one is encoded in overlapping chunks
with offsets. Two neighbouring chunks are spliced at the first offset in their overlap where both
start a unit and which is *proven stable*:

* the left chunk's units before it ended because of text that the chunk contains, so they are those
  of the whole text, given that the left chunk started at a proven offset;
* the pre-tokenizer scans from left to right and remembers nothing but its position (for general
  texts: the offset follows white space, which neither normalisation, special strings nor pieces
  cross), so from that offset on the right chunk's units are those of the whole text.

If the overlap holds no such offset it is widened, at last to the rest of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.tables import slices, texts

#: Fixed values of the vocabulary file: its special strings and its pre-tokenizer's pieces.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: The pieces for lower-cased text of the plain characters below, where \p{L} and \p{N} are spelt out.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w \t\n\v\f\r\x85\xa0]|_)+")
#: Characters which NFC leaves alone, whose lower case is one character, and whose classes are fixed.
PLAIN = re.compile("[\x00-įı-ɏ‐-‧‰-⁞₠-₿]*")

Units = tuple[list[int], list[int]]  # start offsets, tokens of each


def splice(size: int, units: Callable[[int, int], Units], stable: Callable[[int], bool], chunk: int, overlap: int) -> int:
    """Tokens of a text of ``size`` code points; ``units(a, b)`` encodes ``text[a:b]``, offsets in the text."""
    total, start, width = 0, 0, overlap
    left, left_end = None, 0
    while True:
        if left is None:
            left_end = min(size, start + chunk + width)
            left = units(start, left_end)
        if left_end == size:
            return total + sum(left[1])
        begin = max(start + 1, left_end - width)
        right_end = min(size, begin + chunk + overlap)
        right = units(begin, right_end)
        known = {at: i for i, at in enumerate(right[0])}
        for i, at in enumerate(left[0]):
            if at > begin and at in known and stable(at):
                j = known[at]
                total += sum(left[1][:i])
                left, left_end, start, width = (right[0][j:], right[1][j:]), right_end, at, overlap
                break
        else:
            width *= 2
            left = None
            continue


class Counter:
    """Token counts as the library gives them for the vocabulary file at ``path``, specials not added."""

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 1 << 10, cache: int = 1 << 20):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.chunk, self.overlap, self.cache_size = chunk, overlap, cache
        self.cache: dict[str, int] = {}

    def _pieces(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            pass
        missing = list({p for p in pieces if p not in self.cache})
        if len(self.cache) + len(missing) > self.cache_size:
            self.cache.clear()
            missing = list(set(pieces))
        for p, e in zip(missing, self.model.encode_batch_fast(missing, add_special_tokens=False)):
            self.cache[p] = len(e.ids)
        return list(map(self.cache.__getitem__, pieces))

    def _segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """The text cut at the special strings."""
        at = 0
        for m in SPECIAL.finditer(text) if "<|" in text else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def _plain_units(self, text: str, base: int) -> Units:
        starts: list[int] = []
        tokens: list[int] = []
        for a, b, special in self._segments(text):
            if special:
                starts.append(base + a)
                tokens.append(1)
            else:
                found = list(PIECE.finditer(text[a:b].lower()))
                starts += [base + a + m.start() for m in found]
                tokens += self._pieces([m.group() for m in found])
        return starts, tokens

    def _any_units(self, text: str, base: int) -> Units:
        """By the library; a token whose offset repeats the one before counts to that unit."""
        starts: list[int] = []
        tokens: list[int] = []
        for a, _ in self.model.encode(text, add_special_tokens=False).offsets:
            if starts and base + a <= starts[-1]:
                tokens[-1] += 1
            else:
                starts.append(base + a)
                tokens.append(1)
        return starts, tokens

    def count(self, text: str) -> int:
        if not text:
            return 0
        plain = PLAIN.fullmatch(text) is not None
        if len(text) > self.chunk:
            encode = self._plain_units if plain else self._any_units
            return splice(
                len(text),
                lambda a, b: encode(text[a:b], a),
                # inside a special string no chunk may start; elsewhere a plain piece's start is enough
                (lambda at: True) if plain and "<|" not in text else (lambda at: text[at - 1] in " \t\n\r"),
                self.chunk,
                self.overlap,
            )
        if not plain:
            return len(self.model.encode(text, add_special_tokens=False).ids)
        if "<|" in text:
            return sum(self._plain_units(text, 0)[1])
        return sum(self._pieces(PIECE.findall(text.lower())))


_COUNTERS: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One counter for each Python worker and set of parameters."""
    key = (path, chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, chunk, overlap)
    return _COUNTERS[key]


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 1 << 16,
    overlap: int = 1 << 10,
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row, whole texts, one scan and no shuffle.

    ``path`` is the vocabulary file, there on every executor. Null and empty texts have 0 bytes and 0
    tokens. Repeated rows and null ids come back as given; an empty table gives an empty result.
    Columns other than the two named are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, chunk, overlap)
        for batch in slices(batches, "text"):
            found = texts(batch)
            tokens = [own.count(t) for t in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in found], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
