"""The operators as registered queries over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellarline.llm import (
    decontaminate,
    embeddings,
    langid,
    licenses,
    lines,
    packing,
    phrases,
    pieces,
    quality,
    secrets,
    simhash,
    spelling,
    substrings,
)
from cellarline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.held_out_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op2_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.embedding_links(read(spark, folder, "embeddings"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded_documents(read(spark, folder, "documents"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_notices(read(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(read(spark, folder, "documents"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_digest(read(spark, folder, "documents"))


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_digest(read(spark, folder, "documents"))


def op8_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_digest(read(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.held_out_languages(read(spark, folder, "documents"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocation_digest(read(spark, folder, "documents"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(read(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_digest(read(spark, folder, "documents"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_embeddings": op2_embeddings,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_licenses": op4_licenses,
        "op5_secrets": op5_secrets,
        "op6_simhash": op6_simhash,
        "op7_substrings": op7_substrings,
        "op8_contamination": op8_contamination,
        "op9_lines": op9_lines,
        "op10_language": op10_language,
        "op11_phrases": op11_phrases,
        "op12_packing": op12_packing,
        "op13_spelling": op13_spelling,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op2_embeddings": embeddings.SQL,
        "op7_substrings": substrings.SQL,
        "op9_lines": lines.SQL,
        "op11_phrases": phrases.SQL,
    }
