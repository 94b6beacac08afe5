"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import exact, langid, mixing, packing, pseudo, quality, secrets, simhash, substrings, tokens
from lorekeep.llm.common import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.scores(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_exact_dedup,
        op3_quality_rules,
        op4_token_output,
        op5_substring_dedup,
        op6_secret_scan,
        op7_language_id,
        op8_simhash_near_dedup,
        op9_best_fit_packing,
        op10_lm_scoring,
        pipeline,
    )
}

ORACLES: dict[str, str] = {}
