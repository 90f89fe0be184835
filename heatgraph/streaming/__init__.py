"""Heat kept up to date from a stream of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_heat(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """``(window, node, score)``: summed value and number of events of each node in windows of event time.

    Rows later than ``delay`` behind the watermark are left out, as is the state of closed windows.
    """
    late = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = late.groupBy(F.window("ts", window), F.col("user_id").alias("node"))
    return grouped.agg(F.sum("value").alias("score"), F.count(F.lit(1)).alias("n"))


def mutation_counts(mutations: DataFrame) -> DataFrame:
    """``(gene, snvs, cnas)`` of a stream of valid mutations, in complete or update mode."""
    point = F.count_if((F.col("mut_type") == "snv") & F.col("valid"))
    copy = F.count_if(F.col("mut_type").isin("amp", "del") & F.col("valid"))
    return mutations.groupBy("gene").agg(point.alias("snvs"), copy.alias("cnas"))
