"""The registered query of each operator: it applies the operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boletim.llm import (
    boosted_rules,
    chunk_reuse,
    compression_toxicity,
    factorisation,
    kd_shards,
    nn_descent,
    periodic_runs,
    pfair_mix,
    prefix_trie,
    ranked_varint,
    repeated_windows,
    setsketch,
    templates,
)
from boletim.llm.common import ship, table


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op2_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = boosted_rules.fit_rules(documents, table(spark, sf_dir, "labels"))
    return boosted_rules.judge(documents, trees)


def op3_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = factorisation.fit_quality(documents, table(spark, sf_dir, "labels"))
    return factorisation.score(documents, machine).select(
        "doc_id", factorisation.held_out().alias("held_out"), "score", "predicted"
    )


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.schedule(table(spark, sf_dir, "documents"))


def op5_ranked_varint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ranked_varint.round_trip(table(spark, sf_dir, "documents"))
    return tokens.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(table(spark, sf_dir, "documents"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return kd_shards.slots(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    detector = compression_toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return compression_toxicity.score(documents, detector).select(
        "doc_id", compression_toxicity.held_out().alias("held_out"), "score", "predicted"
    )


def op10_nn_descent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(ship(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    build.__name__: _query(build)
    for build in (
        op1_template_extraction,
        op2_boosted_quality_rules,
        op3_factorisation_quality,
        op4_pfair_mix,
        op5_ranked_varint_ids,
        op6_chunk_reuse_bpe,
        op7_kd_shards,
        op8_setsketch_dedup,
        op9_compression_toxicity,
        op10_nn_descent_dedup,
        op11_repeated_windows,
        op12_periodic_runs,
        op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_pfair_mix": pfair_mix.ORACLE_SQL,
    "op11_repeated_windows": repeated_windows.ORACLE_SQL,
    "op13_conversation_trie": prefix_trie.ORACLE_SQL,
}
