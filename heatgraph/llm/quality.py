"""Quality by positive-unlabelled learning with a non-negative risk.

The trusted positives are labelled good documents; the unlabelled sample is plain web text, whose
labels, if it has any, are never read. With ``p`` the class prior, ``l`` the logistic loss and ``g``
the classifier, training minimises ``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])``: the second
term is the risk on bad text, unbiased, and never let below zero. The prior is estimated before, as
the smallest ratio of unlabelled to positive rows in the upper sets of a positive-against-unlabelled
classifier, each with its sampling error added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgraph.llm.labelled import fit_in_task, fold
from heatgraph.llm.tables import slices, texts

#: Most trusted positives and most unlabelled rows that the classifier is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
THRESHOLD = 0.3
HIDDEN = 24
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t", "line": b"\n", "stop": b".!?", "comma": b",;:", "pipe": b"|",
    "hash": b"#$%&*@^~", "bracket": b"<>{}[]()", "code": b"=+_\\/`", "quote": b"\"'", "high": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
_MASK = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _i, _members in enumerate(_CLASSES.values()):
    _MASK[list(_members), _i] = 1
_MASK[_LETTERS, len(_CLASSES)] = 1
_ODD_END = re.compile(r"[^\w\s.,;:!?\"')\]»…-]$")


def features(text: str) -> np.ndarray:
    """Shares of character classes, and shapes of words and lines, of a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _MASK / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(2)] + [0, 0]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    sizes = Counter({w: c for w, c in counts.items() if not any(map(str.isalnum, w))})
    odd = sum(c for w, c in counts.items() if _ODD_END.search(w))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    per_line = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    pairs = Counter(zip(words, words[1:]))
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    more = [
        np.log1p(len(words)) / 8, lengths.mean() / 10, lengths.std() / 10, min(lengths.max(), 200) / 50,
        len(counts) / n, len(counts) / n**0.8, top[0] / n, top[1] / n, sum(sizes.values()) / n, odd / n,
        np.log1p(m) / 5, len(set(lines)) / m, np.log1p(per_line.mean()) / 6, ended / m, capital / n,
        1 - len(pairs) / max(1, len(words) - 1), sum(shares[4:6]) * 10, float(not words),
    ]
    return np.concatenate([np.sqrt(shares), more])


class Net:
    """One hidden layer over standardised features."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.weights[0] + self.weights[1])
        return hidden, (hidden @ self.weights[2] + self.weights[3])[:, 0]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self.standard(x))[1]

    def fit(self, x: np.ndarray, slope, steps: int, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam on all rows of ``x`` (standardised); ``slope(g)``: the risk's gradient by each logit."""
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        for t in range(1, steps + 1):
            hidden, g = self._forward(x)
            d = slope(g)[:, None]
            back = d @ self.weights[2].T * (1 - hidden**2)
            grads = [x.T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            for i, grad in enumerate(grads):
                grad = grad + decay * self.weights[i] * (i % 2 == 0)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                self.weights[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the smallest ratio of upper tails, with its error."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0, 0.7, 141))
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    error = np.sqrt(above_u * (1 - above_u) / len(u)) + np.sqrt(above_p * (1 - above_p) / len(p))
    return float(np.clip(((above_u + error) / above_p).min(), 0.05, 0.99))


def _crossed(good: np.ndarray, web: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of positives against unlabelled rows, each half's from a net fitted on the other half."""
    out = np.zeros(len(good)), np.zeros(len(web))
    for half in (0, 1):
        p, u = good[half::2], web[half::2]
        if not len(p) or not len(u):
            continue
        net = Net(good.shape[1], seed=5)
        net.fit(np.concatenate([p, u]), lambda g: np.concatenate([-_sigmoid(-g[: len(p)]) / len(p), _sigmoid(g[len(p) :]) / len(u)]), 300, decay=1e-2)
        for x, scores in ((good, out[0]), (web, out[1])):
            scores[1 - half :: 2] = net._forward(x[1 - half :: 2])[1]
    return out


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> tuple[Net, float]:
    """The fitted net and the class prior. Without positives or unlabelled rows every score is the prior 0.5."""
    net = Net(len(features("")))
    if not len(positive) or not len(unlabelled):
        net.weights[2][:] = 0
        return net, 0.5
    every = np.concatenate([positive, unlabelled])
    net.mean, net.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    x, n, m = net.standard(every), len(positive), len(unlabelled)
    if prior is None:
        prior = class_prior(*_crossed(x[:n], x[n:]))

    def slope(g: np.ndarray) -> np.ndarray:
        good, web = g[:n], g[n:]
        bad_risk = np.logaddexp(0, web).mean() - prior * np.logaddexp(0, good).mean()
        up = -prior * _sigmoid(-good) / n  # of p E_P[l(g)]
        bad = np.concatenate([-prior * _sigmoid(good) / n, _sigmoid(web) / m])
        if bad_risk < 0:  # step back from the overfitted part only
            return -bad
        bad[:n] += up
        return bad

    net.fit(x, slope, 600)
    return net, prior


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)``: features of the rows with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t).tolist() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return source.mapInArrow(run, f"id {kind}, x array<double>")


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", positives: int = MOST_POSITIVE, unlabelled: int = MOST_UNLABELLED) -> tuple[Net, float]:
    """Fit on at most ``positives`` trusted and ``unlabelled`` other rows, chosen by a hash of the id, none of fold 0."""
    trusted = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label = 1").where(fold("id") != 0)
    trusted = trusted.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(positives)
    web = docs.select(F.col(id_col).alias("id")).where("id is not null").where(fold("id") != 0)
    web = web.distinct().orderBy(F.xxhash64(F.lit("web"), "id"), "id").limit(unlabelled)
    good, other = (_sample(docs, ids, id_col, text_col).withColumn("trusted", F.lit(v)) for ids, v in ((trusted, True), (web, False)))

    def fit(held: list[tuple]) -> tuple[Net, float]:
        return train(*(np.array([x for _, x, t in held if t == v]) for v in (True, False)))

    return fit_in_task(good.unionByName(other), fit)


def scores(docs: DataFrame, net: Net, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row, whole texts, without a shuffle.

    Null and empty texts get the score of an empty text. Repeated rows and null ids come back as
    given; an empty table gives an empty result; only the text goes into a score. A model that was fitted without
    trusted positives says 0.5 of every text, which is over the threshold: nothing speaks against any.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _sigmoid(net.logits(np.array([features(t) for t in texts(batch)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
