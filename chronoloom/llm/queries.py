"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import curriculum, decontam, filter_audit, line_dedup, phrase_dedup, pii_crf, quality_rules, rule_ensemble, shard_tree, simhash_bk, site_template, token_alignment, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"), line_dedup.GROWING)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    counts = [F.col(f"_verdict.counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, F.col("_verdict.base_failed").alias("base_failed"), F.col("_verdict.kept").alias("kept"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(pii_crf.find_personal_data(_table(spark, sf_dir, "documents")))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.place_with_growth(_table(spark, sf_dir, "documents"))


def op7_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, _table(spark, sf_dir, "labels")))


def op8_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.main_text(_table(spark, sf_dir, "pages"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.withColumns({c: F.round(c, 9) for c in ("position", "again")})


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flags(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_line_edit_join": op1_line_edit_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_pii_skip_chain": op5_pii_skip_chain,
    "op6_hash_tree_sharding": op6_hash_tree_sharding,
    "op7_rule_ensemble_quality": op7_rule_ensemble_quality,
    "op8_site_template_text": op8_site_template_text,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_phrase_automata": op11_phrase_automata,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle(),
    "op3_warc_round_trip": warc.oracle(),
    "op6_hash_tree_sharding": shard_tree.oracle(),
    "op9_curriculum_mix": curriculum.oracle(),
    "op11_phrase_automata": phrase_dedup.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
