"""One query per operator over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import arrow_stream, conversation_repair, decontaminate, hard_negatives, hmm, licences, packing, quality, simhash, suffix, tournament_pack, toxicity, url_filter
from tallymark.llm.common import documents, ship, table, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def shipped(build: Query) -> Query:
    """The query, with this package sent to the Python workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    return run


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(documents(table(spark, sf_dir, "documents")))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(documents(table(spark, sf_dir, "documents")))


def op7_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_arrow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_stream.round_trip(documents(table(spark, sf_dir, "documents")), tokenizer("word_bpe_49k.json"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_digests(table(spark, sf_dir, "conversations"))


def op13_tournament_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament_pack.packed_sequences(documents(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_hmm_score": shipped(op1_hmm_score),
    "op2_license_rules": op2_license_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": shipped(op5_toxicity),
    "op6_suffix_dedup": shipped(op6_suffix_dedup),
    "op7_best_fit_pack": shipped(op7_best_fit_pack),
    "op8_quality_rules": op8_quality_rules,
    "op9_arrow_stream": shipped(op9_arrow_stream),
    "op10_simhash_dedup": shipped(op10_simhash_dedup),
    "op11_hard_negatives": shipped(op11_hard_negatives),
    "op12_conversation_repair": shipped(op12_conversation_repair),
    "op13_tournament_pack": shipped(op13_tournament_pack),
}

ORACLES: dict[str, str] = {
    "op2_license_rules": licences.oracle(),
    "op3_decontaminate": decontaminate.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op8_quality_rules": quality.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op12_conversation_repair": conversation_repair.oracle(),
}
