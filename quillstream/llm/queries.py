"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common_prefixes, cotraining, decontaminate, divergence, hard_negatives, language, language_model, mixing, quality_rules, simhash, substrings, url_filter, warc
from quillstream.llm.common import remainder, table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=10, carry=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc.doc_id", "n_words", "n_near", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.train(docs.filter(remainder("doc_id", 5) != 1), table(spark, sf_dir, "labels"))
    found = cotraining.score_documents(docs, model)
    held_out = (remainder("doc.doc_id", 5) == 1).alias("held_out")
    return found.select("doc.doc_id", held_out, "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("kept"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex64("f0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents")).filter("drawn")
    return drawn.select("doc.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 4).alias("probability"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.remove_repeats(docs, run=13, carry=["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = language_model.score_documents(docs, docs.filter(remainder("doc_id", 5) != 1))
    return found.select("doc.doc_id", (remainder("doc.doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(remainder("doc_id", 4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", (remainder("doc.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(rows, F.expr("vec_id % 50 = 0"))


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = common_prefixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), run=100, carry=["doc_id"])
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.judge_pages,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_model": op8_language_model,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_array": op13_suffix_array,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.judge_sql(),
    "op2_decontamination": decontaminate.contamination_sql(10),
    "op5_mixing": mixing.mix_sql(),
    "op6_substrings": substrings.remove_sql(13),
    "op7_quality_rules": quality_rules.judge_sql(),
    "op9_warc": warc.round_trip_sql(),
    "op11_source_divergence": divergence.audit_sql(),
    "op12_hard_negatives": hard_negatives.mine_sql(),
    "op13_suffix_array": common_prefixes.remove_sql(),
}
