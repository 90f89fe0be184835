"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgraph.llm import alignment, chat, decontamination, html, packing, phrases, pii, quality, simhash, sketch, tokens, toxicity, urls
from heatgraph.llm.tables import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(read(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.digest(chat.formatted(chat.negative_pairs(chat.conversations(turns))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net, _ = quality.fitted(docs, read(spark, sf_dir, "labels"))
    return quality.scores(docs, net)


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.length_buckets(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.personal_data(read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(read(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_fingerprints": op2_fingerprints,
    "op3_preference_format": op3_preference_format,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_length_buckets": op6_length_buckets,
    "op7_toxicity": op7_toxicity,
    "op8_personal_data": op8_personal_data,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_collocations": op11_collocations,
    "op12_url_filters": op12_url_filters,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {"op3_preference_format": chat.sql(), "op6_length_buckets": packing.sql(), "op11_collocations": phrases.sql(), "op12_url_filters": urls.sql()}
