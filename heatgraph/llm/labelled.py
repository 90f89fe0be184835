"""Bounded samples of labelled texts for fitting classifiers, and the fold of a row."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label, fold)`` of at most ``most`` rows of each label, never of fold 0.

    Which rows is decided by a hash of the id, so it depends neither on order nor on partitions. Rows
    with a null id or label are no labels, nor are ids with contradictory labels. The chosen ids (at
    most twice ``most``) are broadcast, so one scan of the documents finds the texts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(fold("id") != 0).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most).select("id", "label") for v in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")
    return texts.select("id", F.coalesce("text", F.lit("")).alias("text"), "label", fold("id").alias("fold"))


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """``fit`` of all rows (a bounded sample), sorted, in one task; its result comes back pickled.

    So neither texts nor training are on the driver, and a lost executor only means another try.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        held.sort(key=repr)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
