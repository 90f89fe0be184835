"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is a hashed embedding: the sum of the table rows that its spelling and its prefixes hash to.
Filters one to three words wide run over the whole text, each keeps its largest response, and a
logistic layer weighs those. Thresholds are calibrated by language on rows not used for training; the
language is guessed from the text's most common words, and moves the score so that 0.5 is the
threshold of every language.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.labelled import fit_in_task, fold, sample
from heatgraph.llm.tables import slices, texts

#: Most labelled rows of each class that the classifier is fitted on.
MOST_LABELLED = 3000
BUCKETS, DIMENSION, FILTERS, WIDTHS = 1 << 16, 16, 12, (1, 2, 3)
PREFIXES = (4, 5, 7)
EPOCHS = 6
#: Frequent function words by which a language is guessed.
LANGUAGES = {
    "en": "the of and to in is that it was for on are as with be this by from at or an have not which",
    "de": "der die und den von zu das mit sich des auf nicht dem ein eine als auch es an werden aus er hat dass",
    "fr": "le les et des du une dans qui que au pour pas sur plus par est ne se ce il sont la avec",
    "es": "el los las y del que en un por con no una su para es al lo como se mas o pero",
}
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Vocabulary:
    """Rows of words: their hashed table entries and the languages they speak for."""

    def __init__(self, cache: int = 150_000):
        self.cache = cache
        self.languages = [frozenset(w.split()) for w in LANGUAGES.values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.entries = array("I")  # flat, as many for each word
        self.votes = bytearray()  # a bit for each language

    def rows(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        try:
            return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in self.known:
                    self.known[t] = self._row(_EDGE.sub("", t))
            return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def _row(self, word: str) -> int:
        keys = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES)]
        self.entries.extend([xxhash.xxh64_intdigest(k.encode()) % BUCKETS for k in keys])
        self.votes.append(sum((word in s) << i for i, s in enumerate(self.languages)))
        return len(self.votes) - 1

    def added(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Table entries and votes of the words from row ``start`` on."""
        entries = np.array(self.entries[start * (1 + len(PREFIXES)) :], np.int32).reshape(-1, 1 + len(PREFIXES))
        votes = np.frombuffer(bytes(self.votes[start:]), np.uint8)
        return entries, (votes[:, None] >> np.arange(len(self.languages), dtype=np.uint8)) & np.uint8(1)


def guessed_language(votes: np.ndarray) -> int:
    """The language with most votes, the first of equals; the number of languages if there is none."""
    return int(votes.argmax()) if votes.any() else len(LANGUAGES)


class TextCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (DIMENSION, FILTERS * sum(WIDTHS))).astype(np.float32)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES) + 1, np.float32)

    def unfitted(self) -> TextCnn:
        """Without labels of both kinds nothing is known to be toxic: every text gets one score, below 0.5."""
        self.out[:], self.base = 0, np.float32(-4)
        return self

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and where it is; ``x``: embeddings, at least the widest filter long."""
        every = x @ self.filters
        top, where, at = [], [], 0
        for width in WIDTHS:
            n = len(x) - width + 1
            r = every[:n, at : at + FILTERS]
            for k in range(1, width):
                r = r + every[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            at += width * FILTERS
            best = r.argmax(axis=0)
            where.append(best)
            top.append(r[best, np.arange(FILTERS)])
        return np.concatenate(top) + self.bias, np.concatenate(where)

    @staticmethod
    def _padded(x: np.ndarray) -> np.ndarray:
        short = max(WIDTHS) - len(x)
        return np.concatenate([x, np.zeros((short, x.shape[1]), x.dtype)]) if short > 0 else x

    def logit(self, x: np.ndarray) -> float:
        pooled, _ = self._pool(self._padded(x))
        return float(np.maximum(pooled, 0) @ self.out + self.base)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """``docs``: table entries, one row for each word. Adagrad, one document at a time, words dropped at random."""
        rng = np.random.default_rng(seed)
        sums = {"filters": np.full_like(self.filters, 1e-2), "bias": np.full_like(self.bias, 1e-2), "out": np.full_like(self.out, 1e-2)}
        base_sum, table_sum = 1e-2, np.full((BUCKETS, DIMENSION), 1e-2, np.float32)
        for epoch in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                entries = docs[i]
                if len(entries):
                    entries = entries[rng.random(len(entries)) > 0.1]
                x = self._padded(self.table[entries].sum(axis=1) if len(entries) else np.zeros((0, DIMENSION), np.float32))
                pooled, where = self._pool(x)
                active = np.maximum(pooled, 0)
                z = float(active @ self.out + self.base)
                g = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                if abs(g) < 1e-3:
                    continue
                d = g * self.out * (pooled > 0)
                grad_out = g * active + 1e-5 * self.out
                sums["out"] += grad_out**2
                self.out -= 0.05 * grad_out / np.sqrt(sums["out"])
                base_sum += float(g) ** 2
                self.base -= np.float32(0.05 * float(g) / base_sum**0.5)
                sums["bias"] += d**2
                self.bias -= 0.05 * d / np.sqrt(sums["bias"])
                at = 0
                for w, width in enumerate(WIDTHS):
                    own = slice(w * FILTERS, (w + 1) * FILTERS)
                    for k in range(width):
                        cols = slice(at, at + FILTERS)
                        at += FILTERS
                        seen = where[own] + k
                        grad = x[seen].T * d[own]
                        back = (self.filters[:, cols] * d[own]).T
                        sums["filters"][:, cols] += grad**2
                        self.filters[:, cols] -= 0.03 * grad / np.sqrt(sums["filters"][:, cols])
                        real = seen < len(entries)
                        if real.any():
                            rows = entries[seen[real]].ravel()
                            step = np.repeat(back[real], entries.shape[1], axis=0)
                            np.add.at(table_sum, rows, step**2)
                            np.add.at(self.table, rows, -0.05 * step / np.sqrt(table_sum[rows]))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, language: np.ndarray, least: int = 8) -> None:
        """The threshold of best F1 of each language, of all languages where one has few rows of either label."""
        self.thresholds[:] = best_threshold(logits, labels)
        for v in range(len(self.thresholds)):
            own = language == v
            if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
                self.thresholds[v] = best_threshold(logits[own], labels[own])


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """In the middle of the gap of best F1; 0 without labels of both kinds."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # equal logits share a side
    k = int(f1.argmax())
    return float(z[k] - 1 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def train(rows: list[tuple[str, int, int]]) -> TextCnn:
    """Fit on folds 2 to 4, calibrate on fold 1 (on all if it lacks a label); unfitted if folds 2 to 4 lack a label."""
    words, model = Vocabulary(1 << 62), TextCnn()
    found = [words.rows(t).astype(np.int32) for t, _, _ in rows]
    entries, votes = words.added(0)
    labels, folds = np.array([y for _, y, _ in rows], np.int64), np.array([f for _, _, f in rows], np.int64)
    fitted = folds != 1
    if not len(rows) or labels[fitted].sum() in (0, fitted.sum()):
        return model.unfitted()
    model.fit([entries[found[i]] for i in np.nonzero(fitted)[0]], labels[fitted])
    table = model.table[entries].sum(axis=1) if len(entries) else np.zeros((0, DIMENSION), np.float32)
    held = np.nonzero(folds == 1)[0] if 0 < labels[folds == 1].sum() < (folds == 1).sum() else np.arange(len(rows))
    logits = np.array([model.logit(table[found[i]]) for i in held], np.float64)
    language = np.array([guessed_language(votes[found[i]].sum(axis=0, dtype=np.int64)) for i in held], np.int64)
    model.calibrate(logits, labels[held], language)
    return model


class Scorer:
    """Scores of whole texts; keeps the embeddings of words already seen."""

    def __init__(self, model: TextCnn):
        self.model, self.words = model, Vocabulary()
        room = 2 * self.words.cache
        self.table, self.votes = np.zeros((room, DIMENSION), np.float32), np.zeros((room, len(LANGUAGES)), np.int8)
        self.done = 0

    def _add(self) -> None:
        """Embed the new words, in room that grows by doubling."""
        new, votes = self.words.added(self.done)
        end = self.done + len(new)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        self.table[self.done : end] = self.model.table[new].sum(axis=1)
        self.votes[self.done : end] = votes
        self.done = end

    def __call__(self, text: str) -> float:
        if len(self.words.known) > self.words.cache:
            self.words.clear()
            self.done = 0
        rows = self.words.rows(text)
        if len(self.words.votes) > self.done:
            self._add()
        votes = self.votes[rows].sum(axis=0, dtype=np.int64)
        z = self.model.logit(self.table[rows]) - self.model.thresholds[guessed_language(votes)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> TextCnn:
    """Fit on at most ``most`` rows of each label, chosen by a hash of the id, none of fold 0."""
    rows = sample(docs, labels, label_col, most, id_col, text_col)
    return fit_in_task(rows, lambda held: train([(t, y, f) for _, t, y, f in held]))


def scores(docs: DataFrame, model: TextCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row, whole texts, without a shuffle.

    Null, empty and wordless texts get the score of no words. Repeated rows and null ids come back as
    given; an empty table gives an empty result; only the text goes into a score. A model that had no
    labels, or labels of one kind only, gives every text the score 0.018 and predicts 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in slices(batches, "text"):
            found = [score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: TextCnn, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below 0.5, all columns kept, without a shuffle; all rows if the model is unfitted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([score(t) < 0.5 for t in texts(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
