"""Registered queries of the subpackage: ``name -> (spark_fn, oracle_sql | None)``.

Each applies one operator with its production parameters to the whole table.
Two have oracle SQL; the others have none: DuckDB has no byte-pair merges, no
crc32, no iterated graph scores, no models, and the exact similarity join is too
slow there on whole tables.  Their tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontam import leaks
from .fingerprints import with_edits
from .html_text import main_texts
from .lm import lm_scores
from .near_dup import near_duplicates
from .packing import pack_documents
from .pii import personal_data_report
from .quality import quality_scores
from .secret_scan import secret_report
from .sql import SUBSTRING_SQL, vector_codes_sql
from .spelling import spelling_variants
from .substring_dedup import substring_report
from .token_counts import token_counts
from .vector_codes import vector_codes


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"), window=50)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), one_in=199)


QUERIES: dict = {f.__name__: (f, None) for f in (
    op1_fingerprints, op2_lm_scores, op3_near_duplicates, op4_token_counts, op5_main_text, op6_personal_data, op7_secrets, op8_decontamination, op9_quality, op10_packing,
    op13_spelling_variants)}
QUERIES |= {"op11_substring_dedup": (op11_substring_dedup, SUBSTRING_SQL), "op12_vector_codes": (op12_vector_codes, vector_codes_sql())}
