"""The registered queries of this subpackage and, where SQL can say it, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common as C


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.rlz import dedup_substrings

    return dedup_substrings(C.table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_rules import apply_rules

    return apply_rules(C.table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.jaccard import similarity_groups

    return similarity_groups(C.table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.spm import digests

    return digests(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.media import media_columns

    return media_columns(C.table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_model import score_quality

    return score_quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.idcodec import round_trip

    return round_trip(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import score_toxicity

    return score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.boilerplate import extract

    return extract(C.table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import pack

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_jaccard_join, op4_sentencepiece, op5_media_columns, op6_quality_classifier, op7_token_output, op8_toxicity, op9_html_extraction, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from graphloom.llm import quality_rules

    return {"op2_quality_rules": quality_rules.oracle()}
