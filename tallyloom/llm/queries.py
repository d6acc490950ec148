"""The operators of this folder as queries over whole tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe import encode_documents
from tallyloom.llm.chaining import repeated_passages
from tallyloom.llm.cover_lloyd import vector_codes
from tallyloom.llm.fingerprints import fingerprint_with_edits
from tallyloom.llm.html_extract import fit_pages, page_texts
from tallyloom.llm.ngram_join import JaccardRule, linked_sets
from tallyloom.llm.oracle import ORACLE_SQL
from tallyloom.llm.quality import quality_scores
from tallyloom.llm.quotes import chat_texts
from tallyloom.llm.repair import repair_digests
from tallyloom.llm.secret_scan import secret_digest
from tallyloom.llm.suffix_dedup import without_repeats
from tallyloom.llm.tables import table
from tallyloom.llm.tiling import benchmark_leaks
from tallyloom.llm.token_files import token_digests

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents", "doc_id", "text"), VOCABULARY)


def op2_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return chat_texts(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(table(spark, folder, "documents", "doc_id", "text"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_leaks(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    )


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents", "doc_id", "text"))


def op6_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality")
    )


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return linked_sets(docs, JaccardRule(words=4, num=85, den=100)).withColumnRenamed("n", "n_shingles")


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return page_texts(pages, fit_pages(pages)).select("page_id", "url", "text", "n_chars")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, folder, "documents", "doc_id", "text"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_digests(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    return vector_codes(vectors.withColumnRenamed("embedding", "vector"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents", "doc_id", "text"), BYTE_VOCABULARY, END_ID)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_quote_links": op2_quote_links,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chained_passages": op6_chained_passages,
    "op7_quality": op7_quality,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_text": op9_html_text,
    "op10_fingerprints": op10_fingerprints,
    "op11_repair": op11_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}
