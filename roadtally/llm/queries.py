"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtally.llm import collocations, discriminant, fingerprints, line_dedup, merkle, mixing, neighbours, omh, packing, quality_rules, suffix_tree, toxicity, url_filters
from roadtally.llm.common import id_crc32, read_table


def op1_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.store_ledger(read_table(spark, sf_dir, "documents"))
    bits = F.col("rules.fail_bits")
    shown = [F.col(f"rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return docs.select("doc_id", *shown, (~quality_rules.passes(bits, "base")).alias("base_failed"), (quality_rules.passes(bits, "base") & quality_rules.passes(bits, "v1")).alias("kept"), bits.alias("fail_bits"))


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, from the stored ledger of all documents."""
    return quality_rules.ablations(quality_rules.store_ledger(read_table(spark, sf_dir, "documents")).select("rules.fail_bits"))


def ledger_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the policy against each other, from the stored ledger of all documents."""
    return quality_rules.compare_policies(quality_rules.store_ledger(read_table(spark, sf_dir, "documents")).select("rules.fail_bits"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(read_table(spark, sf_dir, "documents")).drop("digest")


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(id_crc32(F.col("doc_id")), F.lit(3))
    out = discriminant.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(id_crc32(F.col("doc_id")), F.lit(7))
    out = suffix_tree.score_documents(read_table(spark, sf_dir, "documents"), fold != 2)
    return out.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("__removed").alias("n_removed"), F.col("__removed").alias("removed_lines"), "text")


def op7_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(id_crc32(F.col("doc_id")), F.lit(5))
    out = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold != 0)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "window_score", "n_windows")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "__mix.size", "__mix.source_size", F.round("__mix.target", 6).alias("target"), "__mix.taken")


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op10_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"))


def op11_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(read_table(spark, sf_dir, "documents"))


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(read_table(spark, sf_dir, "documents"))


def op13_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def queries():
    return {f.__name__: f for f in (
        op1_bin_completion_packing, op2_quality_rules, op3_order_minhash, op4_quality_discriminant, op5_suffix_tree,
        op6_line_alignment, op7_toxicity_bigru, op8_source_mix, op9_syncmer_fingerprints, op10_url_digest_filter,
        op11_stream_collocations, op12_butterfly_manifest, op13_collision_neighbours,
        ledger_ablations, ledger_policies,
    )}


def oracle_sql():
    return {"op2_quality_rules": quality_rules.oracle_sql(), "ledger_ablations": quality_rules.ablations_sql(), "ledger_policies": quality_rules.policies_sql(), "op8_source_mix": mixing.ORACLE, "op10_url_digest_filter": url_filters.ORACLE, "op11_stream_collocations": collocations.ORACLE, "op12_butterfly_manifest": merkle.oracle_sql()}
