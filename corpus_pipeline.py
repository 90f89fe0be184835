"""From raw documents to training batches, in five stages of whole tables.

Every stage takes what its predecessor kept, stored as Parquet, and all but the last return the
columns they were given, so a stage's decisions are the rows (or texts) that the next one sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatgraph.llm import decontamination, packing, pii, simhash, toxicity
from heatgraph.llm.tables import read
from heatgraph.plans.lineage import dropped, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest id stays, once; rows without an id come after all others."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and place in it."""
    return packing.length_buckets(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", sanitise),
    ("packing", pack),
]

#: No stage but the last can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            if i:
                dropped(before)
    return docs
