"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from settlespark.llm import content, decontaminate, dialogue, jaccard, mixing, nbsvm, oracles, quality_rules, sanitise, sharding, simhash, toxicity, variants, warc
from settlespark.llm.common import table


SHARD_SEED, DRAW_SEED = 20240229, 97


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("n_toxic_words", F.size("spans")).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), seed=SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("digest")


def op5_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.extracted(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), seed=DRAW_SEED).withColumn("rate", F.round("rate", 6))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_sharding, op4_decontamination, op5_sanitisation,
                                   op6_simhash, op7_warc, op8_quality_classifier, op9_html_extraction, op10_mixing,
                                   op11_spelling_variants, op12_conversation_repair, op13_jaccard_join)}
ORACLES = {"op2_quality_rules": oracles.quality_rules(quality_rules.RULES), "op3_sharding": oracles.sharding(SHARD_SEED),
           "op4_decontamination": oracles.DECONTAMINATION, "op7_warc": oracles.WARC, "op10_mixing": oracles.mixing(mixing.POWERS, DRAW_SEED),
           "op11_spelling_variants": oracles.VARIANTS, "op12_conversation_repair": oracles.dialogue(), "op13_jaccard_join": oracles.JACCARD}
