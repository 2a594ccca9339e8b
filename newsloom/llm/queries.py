"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    bpe,
    chunk_fingerprints,
    grid_join,
    licenses,
    lm_scoring,
    merkle,
    mixing,
    quality,
    sharding,
    simhash,
    spelling,
    sql,
    suffix_dedup,
    url_filters,
)
from newsloom.session import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = oracle
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> tuple[str, str]:
    """Path and pattern of a public vocabulary; both are parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(documents(spark, sf_dir), shards=24, seed=42)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.document_tokens(documents(spark, sf_dir), *vocabulary())


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.document_repeats(documents(spark, sf_dir))


@query("op5_url_filters", sql.URL_FILTERS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.page_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked_documents(documents(spark, sf_dir))


@query("op7_quality_rules", sql.QUALITY_RULES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(quality.measured(quality.texts_of(documents(spark, sf_dir))).drop("text"), "quality")
    judged = quality.judge(counts, quality.fences(counts))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_license_scans", sql.LICENSE_SCANS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(documents(spark, sf_dir))


@query("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, sf_dir), limit=4.0, seed=42)


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprints.document_fingerprints(documents(spark, sf_dir))


@query("op11_merkle_manifest", sql.MERKLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))


@query("op12_spelling_variants", sql.SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(documents(spark, sf_dir))


@query("op13_embedding_dedup", sql.GRID_JOIN)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.linked_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
