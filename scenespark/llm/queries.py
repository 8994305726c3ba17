"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenespark.llm.bpe import bpe_digest
from scenespark.llm.decontam import contamination
from scenespark.llm.imatch import imatch_query
from scenespark.llm.langid import language_query
from scenespark.llm.licenses import license_query, license_sql
from scenespark.llm.pii import pii_query
from scenespark.llm.simhash import near_duplicates
from scenespark.llm.toxicity import toxicity_query
from scenespark.llm.urlfilter import judge_urls
from scenespark.llm.warc import WARC_SQL, warc_query
from scenespark.session import table

#: The vocabulary file of op10 and of the pipeline's last stage; a parameter, never copied here.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_query(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(spark, table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_query(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_query(spark, table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_query(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(spark, table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_imatch": op3_imatch,
        "op4_decontamination": op4_decontamination,
        "op5_urlfilter": op5_urlfilter,
        "op6_language": op6_language,
        "op7_pii": op7_pii,
        "op8_warc": op8_warc,
        "op9_licenses": op9_licenses,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": WARC_SQL, "op9_licenses": license_sql()}
